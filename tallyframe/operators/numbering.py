"""Dense numbers in a global order without a global sort in one task.

``placed`` takes keys of any kind. ``numbered`` and ``running_sum`` need no written table, but their ranges are of equal
width, so they suit whole numbers that lie close together: few rows to a range mean many ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written

#: Values of the order column that share a window.
WIDTH = 65_536


def numbered(rows: DataFrame, order: str, by: Sequence[str] = (), outer: Sequence[str] = (), name: str = "pos", width: int = WIDTH) -> DataFrame:
    """Adds the 0-based place of each row in its group ``by``, ordered by ``outer`` and then ``order`` (a whole number).

    Rows are numbered inside ranges of the order column; the sizes of the ranges, one row each, are summed up and added.
    """
    keys = [*by, *outer]
    ranged = rows.withColumn("_range", F.floor(F.col(order) / width))
    inside = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(order)) - 1
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*(by or [F.lit(1)])).orderBy(*outer, "_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    out = ranged.withColumn("_inside", inside).join(offsets, [*keys, "_range"])
    return out.withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_range", "_inside", "_before")


def running_sum(rows: DataFrame, order: str, value: str, name: str, width: int = WIDTH) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to each one by ``order`` (a whole number), by ranges as in ``numbered``."""
    ranged = rows.withColumn("_range", F.floor(F.col(order) / width))
    inside = F.sum(value).over(W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    earlier = W.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(F.sum(value).alias("_s")).select("_range", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    return ranged.withColumn("_inside", inside).join(offsets, "_range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


def _ranged(rows: DataFrame, order: Sequence[str], by: Sequence[str], weight: Column, name: str) -> DataFrame:
    """Adds the sum of ``weight`` up to each row of its group in order, that row included.

    Rows are dealt out by sampled bounds of group and order, so that a large group spreads over many tasks, and summed up
    inside their task. What is added up to offsets is one sum for each group and task. The sorted rows are written once.
    """
    ranged = rows.withColumn("_weight", weight).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    ranged = written(ranged.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)), "ranged")
    inside = F.sum("_weight").over(W.partitionBy(*by, "_part").orderBy("_row").rowsBetween(W.unboundedPreceding, 0))
    counts = ranged.groupBy(*by, "_part").agg(F.sum("_weight").alias("_sum"))
    upto = F.sum("_sum").over(W.partitionBy(*(by or [F.lit(1)])).orderBy("_part"))
    before = counts.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_part").alias("_in"), (upto - F.col("_sum")).alias("_before"))
    same = F.col("_part") == F.col("_in")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return ranged.withColumn("_inside", inside).join(before, same).withColumn(name, F.col("_before") + F.col("_inside")).select(*rows.columns, name)


def placed(rows: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """Adds the 0-based place of each row in its group ``by``, ordered by ``order``, columns of any sortable kind.

    Rows that tie are placed in any order, which is kept. Null groups and null keys come first.
    """
    return _ranged(rows, order, by, F.lit(1).cast("long"), name).withColumn(name, F.col(name) - 1)


def counted_up(rows: DataFrame, order: Sequence[str], by: Sequence[str], weight: str, name: str) -> DataFrame:
    """Adds the sum of a whole number ``weight`` over the rows of the group up to and with each one."""
    return _ranged(rows, order, by, F.col(weight).cast("long"), name)
