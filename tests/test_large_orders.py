"""Skylines, as-of lookups and quantiles of many rows, and the plans that make them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import ranking as k
from tallyframe.operators.quantiles import exact_quantiles
from tallyframe.plans import catalog

from .compare import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def dominated(a, b):
    """Rows of a that some row of b beats."""
    out = np.zeros(len(a), bool)
    for start in range(0, len(a), 2_000):
        mine = a[start : start + 2_000, None]
        out[start : start + 2_000] = ((b >= mine).all(2) & (b > mine).any(2)).any(1)
    return out


def test_skyline_of_100_000_rows(spark):
    u = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 10
    rows = spark.range(100_000).select(F.col("id").alias("model"), u(1).alias("x"), u(2).alias("y"), u(3).alias("z"), F.lit("kept").alias("extra"))
    front = k.pareto_front(rows, ["x", "y"], ["z"])
    assert "NestedLoop" not in plan(front) and "Cartesian" not in plan(front)
    assert front.columns == rows.columns
    points = np.array([(r.x, r.y, -r.z) for r in rows.collect()])
    found = sorted(r.model for r in front.collect())
    best = points[found]
    assert not dominated(best, best).any()
    assert dominated(np.delete(points, found, 0), best).all()


def test_skyline_keeps_equal_rows_and_one_criterion(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0), ("c", 1.0, 1.0), ("d", 0.5, None)], "model string, x double, y double")
    assert sorted(r.model for r in k.pareto_front(rows, ["x"]).collect()) == ["a", "b", "c"]
    assert sorted(r.model for r in k.pareto_front(rows.filter("y IS NOT NULL"), ["x", "y"]).collect()) == ["a", "b"]
    assert k.pareto_front(rows.limit(0), ["x"]).collect() == []


@pytest.mark.parametrize("spread", [1, 5])
def test_lag_by_force(spark, spread):
    rnd = random.Random(spread)
    rows = [(f"m{i:03d}", rnd.choice("fl"), f"2024-01-{rnd.randint(1, 20):02d}", rnd.choice([None, *range(12)])) for i in range(300)] + [("m999", "f", None, 3)]
    df = spark.createDataFrame(rows, "model string, kind string, day string, score int").withColumn("day", F.col("day").cast("date"))
    found = k.lag_behind(df, F.col("kind") == "f", F.col("kind") == "l", "day", "score", spread)
    assert "NestedLoop" not in plan(found)
    want = {}
    for model, kind, day, score in rows:
        if kind == "f":
            hits = [(d, m) for m, kd, d, s in rows if kd == "l" and s is not None and score is not None and day and d <= day and s >= score]
            want[model] = min(hits)[1] if hits else None
    assert {r.model: r.leader for r in found.collect()} == want


@pytest.mark.parametrize("name", ["pareto_models", "open_model_lag", "whole_cluster_bootstrap", "paired_bootstrap"])
def test_no_nested_loop_over_rows(spark, name):
    assert "BroadcastNestedLoopJoin" not in plan(catalog.QUERIES[name](spark, SF))


def test_quantiles_without_gathering_a_group(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["hot", "hot", "hot", "b", None]), rnd.choice([None, 1.5, rnd.random(), float(rnd.randint(0, 5))])) for _ in range(4000)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    found = exact_quantiles(df, ["g"], "v", {"low": 0.0, "mid": 0.5, "high": 0.93})
    assert "percentile" not in plan(found)
    for r in found.filter("g IS NOT NULL").collect():
        values = [v for g, v in rows if g == r.g and v is not None]
        assert np.allclose([r.low, r.mid, r.high], np.quantile(values, [0, 0.5, 0.93])) if values else r.mid is None
    whole = exact_quantiles(df, [], "v", {"mid": 0.5}).first().mid
    assert whole == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.5))
