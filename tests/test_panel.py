"""Fixed effects against dense least squares with dummies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators.numbering import placed
from tallyframe.operators.panel import absorbed, fixed_effects, group_gap


def table(n=160, seed=3):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b = rnd.choice("pqrstuv"), rnd.choice("klm") if rnd.random() < 0.8 else "k"
        x, z = rnd.gauss(ord(a) % 3, 1), rnd.random() + (b == "k")
        rows.append((a, b, x, z, 2 * x - z + ord(a) % 5 + ord(b) % 4 + rnd.gauss(0, 1)))
    return rows


def dense(rows, groups, xs, y, cluster):
    cols = [np.array([r[i] for r in rows], float) for i in xs]
    for k, g in enumerate(groups):
        levels = sorted({r[g] for r in rows})
        cols += [np.array([r[g] == v for r in rows], float) for v in levels[(k > 0) :]]
    x, target = np.stack(cols, 1), np.array([r[y] for r in rows])
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ target
    score = x * (target - x @ beta)[:, None]
    names = sorted({r[cluster] for r in rows})
    sums = np.stack([score[[r[cluster] == c for r in rows]].sum(0) for c in names])
    n, k, m = *x.shape, len(names)
    cov = m / (m - 1) * (n - 1) / (n - k) * inverse @ sums.T @ sums @ inverse
    return beta[: len(xs)], np.sqrt(np.diag(cov))[: len(xs)]


@pytest.mark.parametrize("groups", [("a", "b"), ("a",)])
def test_unbalanced_panel_equals_a_dense_solve(spark, groups):
    rows = table()
    df = spark.createDataFrame([*rows, ("p", None, 1.0, 1.0, 1.0) if "b" in groups else ("p", "k", None, 1.0, 1.0)], "a string, b string, x double, z double, y double")
    got = fixed_effects(df, groups, "y", ["x", "z"], "a").collect()
    beta, error = dense(rows, [0, 1][: len(groups)], [2, 3], 4, 0)
    assert [g.term for g in got] == ["x", "z"] and {g.n for g in got} == {len(rows)}
    assert np.allclose([g.estimate for g in got], beta, atol=1e-7) and np.allclose([g.cluster_error for g in got], error, atol=1e-7)


def test_absorbed_columns_have_no_group_means(spark):
    df = spark.createDataFrame(table(), "a string, b string, x double, z double, y double")
    left = absorbed(df, ["a", "b"], ["x"], ["y"])
    assert left.columns == ["a", "b", "y", "x"]
    for g in ("a", "b"):
        assert all(abs(r.m) < 1e-7 for r in left.groupBy(g).agg(F.avg("x").alias("m")).collect())


def test_gap_with_code_effects(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("xyz"), rnd.choice([-1, 0, 1]), rnd.gauss(0, 1), f"d{i % 9}") for i in range(120)]
    df = spark.createDataFrame(rows, "party string, gold int, error double, doc string")
    got = {r.term: (r.estimate, r.cluster_error) for r in group_gap(df, "party", ["y", "z"], "gold", F.col("error"), "doc").collect()}
    wide = [(r[1], float(r[0] == "y"), float(r[0] == "z"), r[2], r[3]) for r in rows]
    beta, error = dense(wide, [0], [1, 2], 3, 4)
    assert np.allclose([got["party=y"], got["party=z"]], list(zip(beta, error, strict=True)), atol=1e-8)


@pytest.mark.parametrize("by", [(), ("g",)])
def test_places_of_any_key(spark, by):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot", "hot", "a", None]), f"k{i:05d}", i) for i in range(3000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, name string, pos2 long").repartition(7)
    got = {r.name: r.pos for r in placed(df, ["name"], by).collect()}
    groups = {}
    for g, name, _ in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(g if by else 0, []).append(name)
    assert got == {name: i for names in groups.values() for i, name in enumerate(names)}
    assert placed(df.limit(0), ["name"], by).collect() == []
