"""Human votes and coder agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def vote_baseline(counts: DataFrame, unit: str, label: str, n: str) -> DataFrame:
    """How one voter does against the unit's majority: every vote is a decision, counted with its weight.

    ``counts`` has a row for each unit and label with ``n`` votes. Ties of the majority go to the lowest label.
    """
    top = F.max_by(label, F.struct(F.col(n), F.lit(0))).over(W.partitionBy(unit))
    ranked = counts.withColumn("_r", F.row_number().over(W.partitionBy(unit).orderBy(F.desc(n), label))).withColumn("_top", top)
    gold = ranked.filter("_r = 1").select(unit, F.col(label).alias("_gold"))
    rows = counts.join(gold, unit)
    right = F.when(F.col(label) == F.col("_gold"), F.col(n)).otherwise(0)
    sides = F.inline(F.array(F.struct(F.col("_gold").alias("label"), F.col(n).alias("g"), F.lit(0).cast("long").alias("p"), right.cast("long").alias("tp")), F.struct(F.col(label).alias("label"), F.lit(0).cast("long").alias("g"), F.col(n).alias("p"), F.lit(0).cast("long").alias("tp"))))
    each = rows.select(sides).groupBy("label").agg(F.sum("g").alias("gold_n"), F.sum("p").alias("pred_n"), F.sum("tp").alias("tp"))
    return each.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("gold_n") + F.col("pred_n")), F.lit(0.0)))


def share_summary(shares: DataFrame, share: str, by: str) -> DataFrame:
    """Mean, median, quartiles and the unanimous part of majority shares."""
    q = F.percentile(share, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return shares.groupBy(by).agg(F.avg(share).alias("mean"), q[0].alias("lower_quartile"), q[1].alias("median"), q[2].alias("upper_quartile"), F.avg((F.col(share) == 1).cast("double")).alias("unanimous"), F.count("*").alias("n"))


def label_set_votes(codes: DataFrame, unit: str, coder: str, label: str) -> DataFrame:
    """Coders who give several labels vote for the set: how many of each unit's coders share its most frequent set."""
    sets = codes.groupBy(unit, coder).agg(F.array_join(F.sort_array(F.collect_set(label)), "+").alias("_set"))
    n = sets.groupBy(unit, "_set").agg(F.count("*").alias("_n"))
    return n.groupBy(unit).agg(F.max("_n").alias("top"), F.sum("_n").alias("coders")).withColumn("share", F.col("top") / F.col("coders"))


def domain_majority(codes: DataFrame, unit: str, domain: str, code: str, named: str) -> DataFrame:
    """Units that over half of their codes place in one domain: the modal code (ties drop the unit) and the mean code."""
    rows = codes.withColumn("_share", F.avg((F.col(domain) == named).cast("double")).over(W.partitionBy(unit))).filter((F.col("_share") > 0.5) & (F.col(domain) == named))
    n = rows.groupBy(unit, "_share", code).agg(F.count("*").alias("_n"))
    top = n.withColumn("_r", F.rank().over(W.partitionBy(unit).orderBy(F.desc("_n")))).filter("_r = 1")
    mode = top.groupBy(unit, F.col("_share").alias("share")).agg(F.count("*").alias("_k"), F.max(code).alias("mode_code")).filter("_k = 1").drop("_k")
    return mode.join(rows.groupBy(unit).agg(F.avg(code).alias("mean_code")), unit)


def rating_summary(rows: DataFrame, unit: str, value: str) -> DataFrame:
    """Mean, median, deviation, ratings given and rows of each unit."""
    return rows.groupBy(unit).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("sd"), F.count(value).alias("ratings"), F.count("*").alias("size"))
