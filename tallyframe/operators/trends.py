"""Slopes, correlations and decompositions over groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import average_rank, pearson
from .numbering import counted_up


def slope(x: Column, y: Column) -> Column:
    """Least-squares slope from moments; null for fewer than two places."""
    on = x.isNotNull() & y.isNotNull()
    a, b = F.when(on, x.cast("double")), F.when(on, y.cast("double"))
    return F.try_divide(F.count(a) * F.sum(a * b) - F.sum(a) * F.sum(b), F.count(a) * F.sum(a * a) - F.sum(a) ** 2)


def time_slopes(rows: DataFrame, by: Sequence[str], date: str, value: str) -> DataFrame:
    """Points of 100 per year in each group."""
    days = F.datediff(date, F.lit("2000-01-01").cast("date")) / 365.25
    return rows.groupBy(*by).agg((slope(days, F.col(value)) * 100).alias("points_per_year"), F.count("*").alias("n"))


def leave_one_out_slopes(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """The range of slopes when one row is left out, by subtraction from the moments."""
    from pyspark.sql import Window as W

    w = W.partitionBy(F.lit(1))
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    rest = lambda v: F.sum(v).over(w) - v
    n = F.count("*").over(w) - 1
    s = F.try_divide(n * rest(a * b) - rest(a) * rest(b), n * rest(a * a) - rest(a) ** 2)
    return rows.select(key, s.alias("_s")).agg(F.min("_s").alias("low"), F.max("_s").alias("high"))


def leave_one_out_correlations(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """The range of rank correlations when one row is left out; ranks are made anew each time."""
    left_out = rows.select(F.col(key).alias("_out"))
    rest = rows.crossJoin(F.broadcast(left_out)).filter(F.col(key) != F.col("_out"))
    ranked = rest.select("_out", average_rank(x, ["_out"]).alias("_x"), average_rank(y, ["_out"]).alias("_y"))
    each = ranked.groupBy("_out").agg(pearson(F.col("_x"), F.col("_y")).alias("_r"))
    return each.agg(F.min("_r").alias("low"), F.max("_r").alias("high"))


def with_ranks(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``rank_`` and the name for each column: the average rank among all rows, by counts of equal values and their running sums over ranges."""
    for c in columns:
        counts = rows.groupBy(c).agg(F.count("*").alias("_n"))
        ranks = counted_up(counts, [c], [], "_n", "_upto").select(c, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(f"rank_{c}"))
        rows = rows.join(ranks, c)
    return rows


def partial_rank_correlation(rows: DataFrame, x: str, y: str, control: str) -> DataFrame:
    """Correlation of ranks with a third rank held fixed, from the three plain ones."""
    full = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(control).isNotNull())
    ranked = with_ranks(full.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(control).alias("z")), ["x", "y", "z"])
    r = ranked.agg(*(pearson(F.col(f"rank_{a}"), F.col(f"rank_{b}")).alias(a + b) for a, b in ("xy", "xz", "yz")))
    xy, xz, yz = F.col("xy"), F.col("xz"), F.col("yz")
    return r.select(xy.alias("rank_correlation"), F.try_divide(xy - xz * yz, F.sqrt((1 - xz**2) * (1 - yz**2))).alias("partial"))


def within_group_slope(rows: DataFrame, groups: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope with fixed effects of one group, from each group's moments."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    g = rows.groupBy(*groups).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * b).alias("xy"), F.sum(a * a).alias("xx"))
    n = F.col("n")
    return g.agg(F.try_divide(F.sum(F.col("xy") - F.col("sx") * F.col("sy") / n), F.sum(F.col("xx") - F.col("sx") ** 2 / n)).alias("slope"), F.sum("n").alias("n"))


def two_way_slope(rows: DataFrame, first: str, second: str, x: str, y: str) -> DataFrame:
    """Slope with fixed effects of both groups of a balanced table, with errors clustered by the first."""
    from pyspark.sql import Window as W

    a, b, one = W.partitionBy(first), W.partitionBy(second), W.partitionBy(F.lit(1))
    centred = lambda c: F.col(c) - F.avg(c).over(a) - F.avg(c).over(b) + F.avg(c).over(one)
    rows = rows.select(F.col(first).alias("_c"), centred(x).alias("_x"), centred(y).alias("_y"))
    beta = rows.agg(F.try_divide(F.sum(F.col("_x") * F.col("_y")), F.sum(F.col("_x") ** 2)).alias("slope"), F.sum(F.col("_x") ** 2).alias("_xx"))
    score = rows.crossJoin(F.broadcast(beta)).groupBy("_c", "slope", "_xx").agg(F.sum(F.col("_x") * (F.col("_y") - F.col("slope") * F.col("_x"))).alias("_s"))
    return score.groupBy("slope").agg(F.sqrt(F.sum(F.col("_s") ** 2) / F.max("_xx") ** 2).alias("cluster_error"), F.count("*").alias("clusters"))


def error_decomposition(rows: DataFrame, by: Sequence[str], gold: str, pred: str) -> DataFrame:
    """Mean error (shift) and how far answers are pulled to the middle (1 - slope of answer on gold)."""
    g, p = F.col(gold), F.col(pred)
    return rows.groupBy(*by).agg(F.avg(p - g).alias("shift"), (1 - slope(g, p)).alias("pull"), F.avg((p - g) ** 2).alias("mse"))


def least_squares(rows: DataFrame, y: str, xs: Sequence[str]) -> dict[str, float]:
    """Coefficients with an intercept. Sums of products are made in one pass; the small system is solved here."""
    import numpy as np

    names = ["intercept", *xs]
    value = {"intercept": F.lit(1.0)} | {x: F.col(x).cast("double") for x in xs}
    aggs = [F.sum(value[a] * value[b]).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)]
    aggs += [F.sum(value[a] * F.col(y).cast("double")).alias(f"y_{i}") for i, a in enumerate(names)]
    got = rows.dropna(subset=[y, *xs]).agg(*aggs).first()
    k = len(names)
    a = np.array([[got[f"{i}_{j}"] for j in range(k)] for i in range(k)], float)
    return dict(zip(names, np.linalg.lstsq(a, np.array([got[f"y_{i}"] for i in range(k)], float), rcond=None)[0].tolist(), strict=True))


def validity_levels(sample: DataFrame, full: DataFrame, unit: str, place: str, x: str, y: str) -> DataFrame:
    """Correlations of ``x`` with the reference ``y`` at three levels, one row.

    ``r_row``: rows of the sample; ``r_same``: means of units, both sides from the sample; ``r_all``: means of
    units against the reference's means over ``full``; ``r_ceiling``: the reference's sample means against its
    full means, which no ``x`` can be asked to beat; ``r_place``: means of places. Fewer than three pairs, or a
    constant side, give null.
    """
    means = lambda by: sample.groupBy(by).agg(F.avg(x).alias("_x"), F.avg(y).alias("_y"))
    units = means(unit).join(full.groupBy(unit).agg(F.avg(y).alias("_f")), unit, "left")
    r = lambda a, b, name: pearson(F.col(a), F.col(b)).alias(name)
    out = sample.agg(r(x, y, "r_row"))
    for part in (units.agg(r("_x", "_y", "r_same"), r("_x", "_f", "r_all"), r("_y", "_f", "r_ceiling")), means(place).agg(r("_x", "_y", "r_place"))):
        out = out.crossJoin(F.broadcast(part))  # each side is one row
    return out
