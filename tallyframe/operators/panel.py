"""Least squares with fixed effects of several groups on unbalanced tables, with errors clustered."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

NORMAL_95 = 1.959963984540054


def _less_effects(rows: DataFrame, effects: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """The columns less the effects of each group; the larger side of each join can be split, the effects are one row a level."""
    for i, effect in effects.items():
        rows = rows.join(effect.select(f"_{i}", *(F.col(c).alias(f"_m{c}") for c in columns)), f"_{i}")
        rows = rows.withColumns({c: F.col(c) - F.col(f"_m{c}") for c in columns}).drop(*(f"_m{c}" for c in columns))
    return rows


def absorbed(rows: DataFrame, groups: Sequence[str], columns: Sequence[str], keep: Sequence[str] = (), close: float = 1e-10, rounds: int = 1000) -> DataFrame:
    """``groups``, ``keep`` and ``columns`` as doubles, less the effects of all groups: what least squares on one dummy for each level leaves.

    By alternating projections: each round sets the effects of one group after the other to the means of what the
    others leave, until no effect changes by more than ``close`` times the largest effect or value. Effects, one row for each level, go from
    round to round and meet cells, one row with sizes and means for each combination of levels; the rows themselves move only at the end. Rows with a null group or column must be filtered before. Raises if ``rounds`` don't suffice.
    """
    numbered = {str(i): g for i, g in enumerate(groups)}
    rows = rows.select(*(F.col(g).alias(f"_{i}") for i, g in numbered.items()), *(F.col(k).alias(f"_k{j}") for j, k in enumerate(keep)), *(F.col(c).cast("double").alias(f"v{j}") for j, c in enumerate(columns)))
    rows = written(rows, "panel")
    names = [f"v{j}" for j in range(len(columns))]
    scale = rows.agg(F.max(F.greatest(F.lit(1e-300), *(F.abs(c) for c in names), *([F.lit(0.0)] if len(names) == 1 else [])))).first()[0] or 1.0
    keys = [f"_{i}" for i in numbered]
    cells = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.avg(c).alias(c) for c in names))
    cells = written(cells.repartitionByRange(*keys).sortWithinPartitions(*keys), "cells")  # a level's cells lie together, a large level's in several tasks
    mean = lambda c: (F.sum(F.col("_n") * F.col(c)) / F.sum("_n")).alias(c)
    effects: dict[str, DataFrame] = {}
    for _ in range(rounds):
        change = 0.0
        for i in numbered:
            others = {k: v for k, v in effects.items() if k != i}
            new = written(_less_effects(cells, others, names).groupBy(f"_{i}").agg(*map(mean, names)), "effects")
            if i in effects:
                old = effects[i].select(f"_{i}", *(F.col(c).alias(f"_o{c}") for c in names))
                gap = F.greatest(*(F.abs(F.col(c) - F.col(f"_o{c}")) for c in names), F.lit(0.0))
                change = max(change, new.join(old, f"_{i}").agg(F.max(gap)).first()[0] or 0.0)
            else:
                change = float("inf")
            effects[i] = new
        if len(groups) == 1 or change <= close * scale:
            out = _less_effects(rows, effects, names)
            return out.select(*(F.col(f"_{i}").alias(g) for i, g in numbered.items()), *(F.col(f"_k{j}").alias(k) for j, k in enumerate(keep)), *(F.col(f"v{j}").alias(c) for j, c in enumerate(columns)))
    raise RuntimeError(f"effects still change by {change} after {rounds} rounds")


def fixed_effects(rows: DataFrame, groups: Sequence[str], y: str, xs: Sequence[str], cluster: str, small_sample: bool = True) -> DataFrame:
    """Coefficients of ``xs`` with fixed effects of all ``groups``, and errors clustered by ``cluster``.

    Returns ``term, estimate, cluster_error, low, high, n, clusters``. Cells may be missing or repeated. The sandwich's middle is the sum over
    clusters of squared scores; with ``small_sample`` it is scaled by G / (G - 1) * (N - 1) / (N - K), K counting the effects too (of
    a connected table). Rows with a null anywhere are left out. Effects of 100 or 10 million levels are alike: the
    system solved on the driver has as many rows as ``xs``. Collinear terms have the shortest solution.
    """
    rows = rows.dropna(subset=[*groups, y, *xs, cluster]).select(*dict.fromkeys([*groups, y, *xs]), F.col(cluster).alias("_cluster"))
    left = written(absorbed(rows, groups, [y, *xs], ["_cluster"]), "absorbed")
    k = len(xs)
    x, outcome = [F.col(c) for c in xs], F.col(y)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    levels = [F.count_distinct(g).alias(f"g{i}") for i, g in enumerate(groups)]
    sums = left.agg(*(F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i, j in pairs), *(F.sum(x[i] * outcome).alias(f"y{i}") for i in range(k)), F.count("*").alias("n"), *levels).first()
    bread = np.zeros((k, k))
    for i, j in pairs:
        bread[i, j] = bread[j, i] = sums[f"x{i}_{j}"] or 0.0
    inverse = np.linalg.pinv(bread, rcond=1e-12)
    beta = inverse @ np.array([sums[f"y{i}"] or 0.0 for i in range(k)])
    error = outcome - sum((x[i] * float(beta[i]) for i in range(k)), F.lit(0.0))
    scores = left.groupBy("_cluster").agg(*(F.sum(x[i] * error).alias(f"s{i}") for i in range(k)))
    found = scores.agg(*(F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in pairs), F.count("*").alias("clusters")).first()
    meat = np.zeros((k, k))
    for i, j in pairs:
        meat[i, j] = meat[j, i] = found[f"m{i}_{j}"] or 0.0
    n, clusters = sums["n"], found["clusters"]
    used = k + sum(sums[f"g{i}"] for i in range(len(groups))) - len(groups) + 1
    scale = clusters / (clusters - 1) * (n - 1) / (n - used) if small_sample and clusters > 1 and n > used else 1.0
    errors = np.sqrt(np.maximum(np.diag(scale * inverse @ meat @ inverse), 0))
    out = [(t, float(b), float(e), float(b - NORMAL_95 * e), float(b + NORMAL_95 * e), n, clusters) for t, b, e in zip(xs, beta, errors, strict=True)]
    return rows.sparkSession.createDataFrame(out, "term string, estimate double, cluster_error double, low double, high double, n long, clusters long")


def dummies(rows: DataFrame, column: str, values: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Adds a 0/1 column for each of the values, and their names."""
    names = {f"{column}={v}": (F.col(column).eqNullSafe(F.lit(v))).cast("double") for v in values}
    return rows.withColumns(names), list(names)


def group_gap(rows: DataFrame, group: str, values: Sequence[str], gold: str, error: Column, cluster: str) -> DataFrame:
    """Differences in signed error between each of the group's ``values`` and its others, with an effect for every gold code."""
    rows, names = dummies(rows.withColumn("_error", error), group, values)
    plain = {n: f"d{i}" for i, n in enumerate(names)}
    found = fixed_effects(rows.withColumnsRenamed(plain), [gold], "_error", list(plain.values()), cluster)
    back = F.create_map(*(F.lit(v) for n, d in plain.items() for v in (d, n)))
    return found.withColumn("term", back[F.col("term")])
