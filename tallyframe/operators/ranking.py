"""Ranks, tiers, frontiers and comparisons of models over tasks.

Frames here have a row for each (task, model), or a row for each model: far fewer than the decisions they sum up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def model_means(scores: DataFrame, value: str = "f1", tasks: int | None = None) -> DataFrame:
    """Mean over tasks and its rank (ties share the smallest). With ``tasks``, a model without all of them has no mean."""
    mean = F.avg(value) if tasks is None else F.when(F.countDistinct("task") == tasks, F.avg(value))
    rows = scores.groupBy("model").agg(mean.alias("mean"), F.countDistinct("task").alias("tasks"))
    return rows.withColumn("rank", F.rank().over(W.orderBy(F.desc_nulls_last(F.round("mean", 9)))))


def leave_one_out_ranks(scores: DataFrame, value: str = "f1") -> DataFrame:
    """Best and worst rank of each model when one task is left out, by subtraction from the sums."""
    w = W.partitionBy("model")
    rest = (F.sum(value).over(w) - F.col(value)) / (F.count("*").over(w) - 1)
    ranked = scores.withColumn("_rest", F.round(rest, 9)).withColumn("_rank", F.rank().over(W.partitionBy("task").orderBy(F.desc("_rest"))))
    return ranked.groupBy("model").agg(F.min("_rank").alias("best_rank"), F.max("_rank").alias("worst_rank"))


def trimmed_means(scores: DataFrame, k: int = 1, value: str = "f1") -> DataFrame:
    """Mean without each model's k lowest and k highest tasks."""
    low = F.row_number().over(W.partitionBy("model").orderBy(value, "task"))
    high = F.row_number().over(W.partitionBy("model").orderBy(F.desc(value), F.desc("task")))
    return scores.withColumn("_l", low).withColumn("_h", high).filter(f"_l > {k} AND _h > {k}").groupBy("model").agg(F.avg(value).alias("trimmed_mean"))


def demeaned(scores: DataFrame, value: str = "f1") -> DataFrame:
    """Each score less the mean of its task."""
    return scores.withColumn("demeaned", F.col(value) - F.avg(value).over(W.partitionBy("task")))


def weighted_means(scores: DataFrame, widths: DataFrame, value: str = "f1") -> DataFrame:
    """Means with tasks weighted by the inverse variance that their interval widths imply."""
    weight = widths.groupBy("task").agg((1 / F.avg(((F.col("high") - F.col("low")) / 3.92) ** 2)).alias("_w"))
    rows = scores.join(F.broadcast(weight), "task")
    return rows.groupBy("model").agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias("weighted_mean"))


def two_level_mean(rows: DataFrame, group: str, value: str, by: list[str]) -> DataFrame:
    """Mean within groups, then over groups, so each group counts the same."""
    return rows.groupBy(*by, group).agg(F.avg(value).alias("_m")).groupBy(*by).agg(F.avg("_m").alias("equal_group_mean"))


def ordered_pairs(scores: DataFrame, value: str = "f1") -> DataFrame:
    """Every model against every other on the same tasks: mean difference and counts of better, tied and worse.

    The join is on the task; only the models of one task meet.
    """
    a = scores.select("task", F.col("model").alias("model"), F.col(value).alias("_a"))
    b = scores.select("task", F.col("model").alias("reference"), F.col(value).alias("_b"))
    rows = a.join(b, "task").filter("model <> reference").withColumn("_d", F.round(F.col("_a") - F.col("_b"), 12))
    return rows.groupBy("model", "reference").agg(F.avg("_d").alias("difference"), F.count_if(F.col("_d") > 0).alias("better"), F.count_if(F.col("_d") == 0).alias("tied"), F.count_if(F.col("_d") < 0).alias("worse"))


def _skyline(points: np.ndarray, chunk: int = 512) -> np.ndarray:
    """Places of the points that no other has in all places at least and in one place more."""
    order = np.lexsort([*points.T, points.sum(1)])[::-1]  # a point can only be dominated by one before it
    kept = np.empty(0, np.int64)
    for start in range(0, len(order), chunk):
        some = order[start : start + chunk]
        rival = points[np.concatenate([kept, some])]
        mine = points[some][:, None]
        beaten = ((rival >= mine).all(2) & (rival > mine).any(2)).any(1)
        kept = np.concatenate([kept, some[~beaten]])
    return np.sort(kept)


def pareto_front(rows: DataFrame, maximise: Sequence[str] = (), minimise: Sequence[str] = (), key: str = "model", fan: int = 8) -> DataFrame:
    """Rows that no other row dominates. A criterion with any null is ignored for every row.

    Each task keeps its own front as rows stream by, then the fronts of ``fan`` tasks at a time are merged until one is left. What
    a dropped row dominates, the row that dropped it dominates too, so no row is compared with the whole table. The front itself must fit a task.
    """
    names = [*maximise, *minimise]
    nulls = rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in names)).first()
    used = [c for c in names if not nulls[c]]
    if not used:
        return rows
    # ties of sums that rounding hides are settled by the order of the places themselves
    signs = [F.col(c).cast("double") * (1.0 if c in maximise else -1.0) for c in used]
    marked = rows.select("*", F.array(*signs).alias("_point"))

    def front(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if found is None else pa.concat_tables([found, table])
            points = table["_point"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(used))
            found = table.take(pa.array(_skyline(points)))
        if found is not None:
            yield from found.combine_chunks().to_batches()

    parts = rows.sparkSession.sparkContext.defaultParallelism
    out = marked.mapInArrow(front, marked.schema)
    while parts > 1:
        parts = -(-parts // fan)
        out = out.repartition(parts).mapInArrow(front, marked.schema)
    return out.drop("_point")


def running_frontier(rows: DataFrame, series: str, date: str, value: str, eligible: Column | None = None) -> DataFrame:
    """The best eligible value before each row and whether the row sets a new one; a tie doesn't."""
    ok = F.lit(True) if eligible is None else eligible
    past = W.partitionBy(series).orderBy(date, "model").rowsBetween(W.unboundedPreceding, -1)
    before = F.max(F.when(ok, F.col(value))).over(past)
    sets = ok & (before.isNull() | (F.col(value) > before))
    return rows.withColumn("frontier_before", before).withColumn("sets_frontier", sets).withColumn("frontier", F.greatest("frontier_before", F.when(ok, F.col(value))))


def staircase(rows: DataFrame, series: str, date: str, value: str) -> DataFrame:
    """Running maximum by date and the step it takes at each row."""
    w = W.partitionBy(series).orderBy(date, "model")
    top = F.max(value).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("running_max", top).withColumn("step", F.col("running_max") - F.coalesce(F.lag("running_max").over(w), F.lit(0.0)))


def promotion(rows: DataFrame, series: str, date: str, value: str, limit: float = 0.05) -> DataFrame:
    """Why a model is promoted or not: reliability first, then the frontier that stood before it."""
    reliable = F.col("malformed_rate") <= limit
    out = running_frontier(rows, series, date, value, reliable)
    reasons = F.array(F.when(~reliable, "unreliable"), F.when(reliable & F.col("frontier_before").isNull(), "first"), F.when(reliable & (F.col(value) > F.col("frontier_before")), "above"), F.when(reliable & (F.col(value) <= F.col("frontier_before")), "not above"))
    return out.withColumn("promoted", F.col("sets_frontier")).withColumn("reason", F.array_join(F.filter(reasons, lambda r: r.isNotNull()), "; "))


def lag_behind(rows: DataFrame, follower: Column, leader: Column, date: str, value: str, spread: int = 32) -> DataFrame:
    """For each follower, the earliest leader dated on or before it with at least its score, and the months between.

    In order of date and name, that leader is always one whose score is above all before it, so these records alone are looked up: their
    scores rise with their dates. Followers and records, the latter once for each of ``spread`` parts, are put in one order by score, and each follower
    takes the last record that it passes. The only window over all leaders is one row a day.
    """
    a = rows.filter(leader).select(F.col("model").alias("leader"), F.col(date).alias("_d"), F.col(value).alias("_v")).filter("_d IS NOT NULL AND _v IS NOT NULL")
    days = a.groupBy("_d").agg(F.max("_v").alias("_top"))
    days = days.select("_d", F.max("_top").over(W.orderBy("_d").rowsBetween(W.unboundedPreceding, -1)).alias("_past"))
    earlier = F.max("_v").over(W.partitionBy("_d").orderBy("leader").rowsBetween(W.unboundedPreceding, -1))
    records = a.withColumn("_same", earlier).join(days, "_d").filter("(_past IS NULL OR _v > _past) AND (_same IS NULL OR _v > _same)")
    hit = F.struct("_d", "leader").alias("_h")
    records = records.select(F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("_part"), F.col("_v").alias("value"), hit, F.lit(0).alias("_order"))
    own = rows.filter(follower).select("model", F.col(date).alias("date"), F.col(value).alias("value"))
    both = own.withColumn("_part", F.pmod(F.xxhash64("model"), F.lit(spread)).cast("int")).withColumn("_order", F.lit(1)).unionByName(records, allowMissingColumns=True)
    passed = F.last("_h", ignorenulls=True).over(W.partitionBy("_part").orderBy(F.desc("value"), "_order").rowsBetween(W.unboundedPreceding, 0))
    out = both.withColumn("_h", passed).filter("_order = 1")
    known = F.col("value").isNotNull() & (F.col("_h._d") <= F.col("date"))
    return out.select("model", F.when(known, F.col("_h.leader")).alias("leader"), F.when(known, F.datediff("date", F.col("_h._d")) / 30.4375).alias("lag_months"))


def best_by_date(rows: DataFrame, dates: DataFrame, group: str, date: str, value: str) -> DataFrame:
    """For each date of a calendar, the best value of each group up to then: a running maximum over the union."""
    spine = dates.select(F.col("date")).distinct().crossJoin(F.broadcast(rows.select(group).distinct())).withColumn("_v", F.lit(None).cast("double"))
    all_rows = rows.select(F.col(date).alias("date"), group, F.col(value).cast("double").alias("_v")).withColumn("_spine", F.lit(False)).unionByName(spine.withColumn("_spine", F.lit(True)))
    upto = W.partitionBy(group).orderBy("date").rangeBetween(W.unboundedPreceding, 0)
    return all_rows.withColumn("best", F.max("_v").over(upto)).filter("_spine").select(group, "date", "best")


def task_winners(scores: DataFrame, value: str = "f1") -> DataFrame:
    """Models with the best score of a task, ties included."""
    return scores.withColumn("_top", F.max(value).over(W.partitionBy("task"))).filter(F.col(value) == F.col("_top")).drop("_top")


def interaction_share(scores: DataFrame, value: str = "f1") -> DataFrame:
    """Part of the total sum of squares that neither task nor model means explain, and theirs."""
    x, task, model, all_ = F.col(value), F.avg(value).over(W.partitionBy("task")), F.avg(value).over(W.partitionBy("model")), F.avg(value).over(W.partitionBy(F.lit(1)))
    rows = scores.select(((x - task - model + all_) ** 2).alias("_i"), ((task - all_) ** 2).alias("_t"), ((model - all_) ** 2).alias("_m"), ((x - all_) ** 2).alias("_all"))
    return rows.agg(*(F.try_divide(F.sum(c), F.sum("_all")).alias(n) for c, n in (("_i", "interaction"), ("_t", "task"), ("_m", "model"))))


def eta_squared(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Between-group share of the sum of squares, from moments."""
    g = rows.groupBy(group).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) ** 2).alias("q"))
    total = F.sum("q") - F.sum("s") ** 2 / F.sum("n")
    return g.agg(F.try_divide(F.sum(F.col("s") ** 2 / F.col("n")) - F.sum("s") ** 2 / F.sum("n"), total).alias("eta_squared"))


def greedy_tiers(means: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tiers from the top: a model that the interval sets below the tier's first model starts a new tier.

    Each step depends on the one before, so the ordered list of models (not of rows) goes through one group.
    ``means`` has model and rank; ``pairs`` has model, reference and high, the upper end of model - reference.
    """
    rows = means.select("model", "rank").join(pairs.select("model", "reference", "high"), "model", "left").withColumn("_all", F.lit(1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf[["model", "rank"]].drop_duplicates().sort_values(["rank", "model"])
        high = {(a, b): h for a, b, h in zip(pdf["model"], pdf["reference"], pdf["high"], strict=True)}
        out, tier, leader = [], 0, None
        for model in order["model"]:
            h = high.get((model, leader))
            if leader is None or (h is not None and h < 0):
                tier, leader = tier + 1, model
            out.append((model, tier, leader))
        return pd.DataFrame(out, columns=["model", "tier", "leader"])

    return rows.groupBy("_all").applyInPandas(run, "model string, tier int, leader string")


def lineage_change(rows: DataFrame, group: str, date: str, value: str) -> DataFrame:
    """First and last model of each family by date, and the change of the value."""
    return rows.groupBy(group).agg(
        F.min_by("model", F.struct(date, "model")).alias("first_model"), F.max_by("model", F.struct(date, "model")).alias("last_model"),
        (F.max_by(value, F.struct(date, "model")) - F.min_by(value, F.struct(date, "model"))).alias("change"),
    )


def selection_value(scores: DataFrame, model_class: DataFrame, value: str = "f1") -> DataFrame:
    """What choosing the best model per task is worth: the best of each class per task, the gap, and the means."""
    rows = scores.join(F.broadcast(model_class), "model")
    return rows.groupBy("task").agg(
        F.max(F.when(F.col("compute_class") == "local", F.col(value))).alias("best_local"),
        F.max(F.when(F.col("compute_class") == "api", F.col(value))).alias("best_api"),
        F.avg(F.when(F.col("compute_class") == "local", F.col(value))).alias("mean_local"),
        F.avg(F.when(F.col("compute_class") == "api", F.col(value))).alias("mean_api"),
        F.max(value).alias("oracle"),
        F.max_by("model", F.struct(F.round(value, 9), F.col("model"))).alias("winner"),
    )


def standardised_mean(rows: DataFrame, columns: Sequence[str], name: str = "proxy") -> DataFrame:
    """Mean of the z-scores (population deviation) of log(1 + column); a constant column gives 0."""
    logs = {c: F.log1p(F.col(c).cast("double")) for c in columns}
    facts = rows.agg(*(f(x).alias(f"_{n}_{c}") for c, x in logs.items() for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = F.lit(0.0)
    for c, x in logs.items():
        out = out + F.coalesce(F.try_divide(x - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0))
    return rows.crossJoin(F.broadcast(facts)).withColumn(name, out / len(columns)).select(*rows.columns, name)  # one row of facts


def speed_up(rows: DataFrame, by: Sequence[str], batch_size: str, seconds: str) -> DataFrame:
    """Adds ``speed_up`` and ``delta`` of each batch size against single calls of its group; null without any."""
    one = F.max(F.when(F.col(batch_size) == 1, F.col(seconds))).over(W.partitionBy(*by))
    return rows.withColumns({"speed_up": F.try_divide(one, F.col(seconds)), "delta": F.col(seconds) - one})


def stacked(rows: DataFrame, dimensions: Sequence[Sequence[str]], value: str) -> DataFrame:
    """Mean and size of ``value`` in every cell of every list of dimensions, in one pass: ``dimension, cell, mean, n``."""
    every = list(dict.fromkeys(c for d in dimensions for c in d))
    own = {c: f"_d{i}" for i, c in enumerate(every)}
    rows = rows.select(*(F.col(c).alias(n) for c, n in own.items()), F.col(value).alias("_value"))
    sets = [[F.col(own[c]) for c in d] for d in dimensions]
    found = rows.groupingSets(sets, *own.values()).agg(F.avg("_value").alias("mean"), F.count("_value").alias("n"), F.grouping_id().alias("_set"))
    number = {sum((c not in d) << (len(every) - 1 - i) for i, c in enumerate(every)): d for d in dimensions}
    name, cell = F.lit(None).cast("string"), F.lit(None).cast("string")
    for mark, d in number.items():
        name = F.when(F.col("_set") == mark, F.lit("+".join(d) or "all")).otherwise(name)
        parts = F.concat_ws("/", *(F.coalesce(F.col(own[c]).cast("string"), F.lit("null")) for c in d)) if d else F.lit("all")
        cell = F.when(F.col("_set") == mark, parts).otherwise(cell)
    return found.select(name.alias("dimension"), cell.alias("cell"), "mean", "n")
