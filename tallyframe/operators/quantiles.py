"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import counted_up


def exact_quantiles(rows: DataFrame, by: Sequence[str], value: str, levels: Mapping[str, float]) -> DataFrame:
    """``by`` and a column for each named level, linear between neighbours in order, over the values that are not null.

    Equal values are counted before anything moves; the counts are sorted by sampled ranges of group and value and summed
    up, so neither a group's rows nor its distinct values meet in one task. Groups without a value,
    and a null group, have nulls.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    upto = counted_up(counts, ["_v"], by, "_n", "_upto")
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    at = {name: p * (F.col("_all") - 1) for name, p in levels.items()}
    placed = upto.join(total, list(by)) if by else upto.crossJoin(F.broadcast(total))  # one row without groups
    picks = []
    for i, h in enumerate(at.values()):
        picks += [F.min(F.when(F.col("_upto") > F.floor(h), F.col("_v"))).alias(f"_low{i}"), F.min(F.when(F.col("_upto") > F.ceil(h), F.col("_v"))).alias(f"_high{i}"), F.max(h - F.floor(h)).alias(f"_part{i}")]
    found = placed.groupBy(*by).agg(*picks)
    out = found.select(*by, *((F.col(f"_low{i}") + F.col(f"_part{i}") * (F.col(f"_high{i}") - F.col(f"_low{i}"))).alias(name) for i, name in enumerate(at)))
    return rows.select(*by).distinct().join(out, list(by), "left") if by else out
