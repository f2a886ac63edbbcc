"""The reports: summary, batched summary, release, comparison, coverage and inventory."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .operators import cost as h
from .operators import metrics as m
from .operators import ranking as k
from .operators import resample as b
from .operators.quantiles import exact_quantiles
from .operators.reshape import coverage as _coverage
from .sources.shared import written

CELL = ["task", "kind", "model"]


def summarize(decisions: DataFrame, label_def: DataFrame, models: DataFrame, on_malformed: str = "drop", support_only: bool = True, iterations: int = 0, score_range: tuple[float, float] = (0.0, 100.0)) -> DataFrame:
    """A row for each task and model: sizes, parse rates, latency, every metric of the task's kind, and costs.

    ``decisions`` has ``latency_s``. Labels are counted once, as pairs of gold and answer, and all their metrics come from these counts. With ``iterations``, an interval of the headline F1 is added.
    """
    pairs = written(m.label_pairs(decisions), "label_pairs")
    scored = m.with_policy(pairs, on_malformed)
    bad = m.malformed(F.col("parse_error"))
    base = decisions.groupBy(*CELL).agg(
        F.count("*").alias("n"), F.count_if(~bad).alias("parse_ok"), F.avg(bad.cast("double")).alias("parse_err_rate"), F.avg("latency_s").alias("mean_latency_s")
    )
    out = base.join(exact_quantiles(decisions, CELL, "latency_s", {"median_latency_s": 0.5}), CELL, "left")
    for part in (m.headline_f1(scored, label_def, support_only, weight="n"), m.accuracy(scored, "n"), m.mcc(scored.filter("kind IN ('binary', 'categorical')"), weight="n")):
        out = out.join(part, CELL, "left")
    ordinal = m.ordinal_metrics(scored, label_def, "n").select("task", "model", "weighted_kappa", F.col("mae_steps"))
    numeric = m.score_metrics(decisions, *score_range).select("task", "model", "pearson_r", "spearman_r", "mae")
    out = out.join(ordinal, ["task", "model"], "left").join(numeric, ["task", "model"], "left")
    if iterations:
        reps = b.f1_replicates(m.with_policy(decisions, on_malformed).filter("kind <> 'score'"), label_def, iterations)
        out = out.join(reps.groupBy("task", "model").agg(*b.interval(F.col("f1"), "ci_")), ["task", "model"], "left")
    out = out.join(F.broadcast(models.select("model", "compute_class", "cost_per_call_usd")), "model", "left")
    usd = h.usd_per_1000(F.col("cost_per_call_usd"))
    return out.withColumns({"gpu_hours_per_1000": h.gpu_hours_per_1000(F.col("median_latency_s"), F.col("compute_class")), "usd_per_1000": usd, "usd_per_1000_correct": h.cost_per_1000_correct(usd, F.col("accuracy"))})


def batch_agreement(decisions: DataFrame) -> DataFrame:
    """Share of items on which each batch size answers as single calls do; 1 for single calls, null without pairs.

    Rows meet in windows of an item's few answers to a field; those dealt by item and task (``reshape.dealt``) aren't moved again.
    """
    key = ["item_id", "task", "model", "label_field"]
    single, alike = F.col("batch_size") == 1, W.partitionBy(*key)
    ones = {"_low": F.min(F.when(single, F.col("pred"))), "_high": F.max(F.when(single, F.col("pred"))), "_void": F.count_if(single & F.col("pred").isNull())}
    rows = decisions.withColumns({name: value.over(alike) for name, value in ones.items()})
    paired = functools.reduce(Column.__and__, (F.col(c).isNotNull() for c in [*key, "pred", "_low"])) & (F.col("_void") == 0)
    same = F.when(paired, ((F.col("pred") == F.col("_low")) & (F.col("pred") == F.col("_high"))).cast("double"))  # as all single calls, if several
    item = rows.groupBy("task", "model", "batch_size", "item_id").agg(F.when(F.count(same) == F.count("*"), F.min(same)).alias("_s"))
    out = item.groupBy("task", "model", "batch_size").agg(F.avg("_s").alias("agreement"), F.count("_s").alias("compared"))
    return out.withColumn("agreement", F.when(F.col("batch_size") == 1, 1.0).otherwise(F.col("agreement")))


def release(decisions: DataFrame, label_def: DataFrame, categories: DataFrame, iterations: int = 200) -> dict[str, DataFrame]:
    """Five tables: models, tasks, classes, categories and pairs. Malformed answers are wrong.

    Means and differences have two intervals: over items drawn within tasks (``item_ci_``), and over tasks drawn for all
    models alike (``task_ci_``), in a category over its own tasks. Replicates of items are written once for all tables.
    """
    decisions = decisions.filter("kind <> 'score'")
    scored = m.with_policy(decisions, "wrong")
    tasks = m.headline_f1(scored, label_def).withColumnRenamed("headline_f1", "f1")
    reps = written(b.f1_replicates(scored, label_def, iterations), "replicates")
    cat = F.broadcast(categories.select("task", "category"))
    over_tasks = lambda rows, value, by, within=None: b.mean_interval(rows, "task", value, iterations, by, within=within).select(*by, F.col("low").alias("task_ci_low"), F.col("high").alias("task_ci_high"))
    bad = m.malformed(F.col("parse_error")) | F.col("pred").isNull()
    items = decisions.groupBy("task", "model", "item_id").agg(F.max(bad.cast("int")).alias("_bad"))
    rates = [F.count("*").alias("n"), F.sum("_bad").alias("malformed"), F.avg("_bad").alias("malformed_rate")]
    shares = m.decision_accuracy(scored).join(m.mcc(scored, undefined=None).select("task", "model", "mcc"), ["task", "model"], "left")
    task_table = tasks.join(shares, ["task", "model"]).join(items.groupBy("task", "model").agg(*rates), ["task", "model"])
    task_table = task_table.join(cat, "task", "left").join(reps.groupBy("task", "model").agg(*b.interval(F.col("f1"), "item_ci_")), ["task", "model"])
    over_items = reps.groupBy("model", "b").agg(F.avg("f1").alias("mean")).groupBy("model").agg(*b.interval(F.col("mean"), "item_ci_"))
    models = k.model_means(tasks).join(items.groupBy("model").agg(*rates), "model").join(over_items, "model").join(over_tasks(tasks, "f1", ["model"]), "model")
    in_category = tasks.join(cat, "task")
    by_category = in_category.groupBy("model", "category").agg(F.avg("f1").alias("mean_task_f1"), F.count("*").alias("tasks"))
    cat_reps = reps.join(cat, "task").groupBy("model", "category", "b").agg(F.avg("f1").alias("mean")).groupBy("model", "category").agg(*b.interval(F.col("mean"), "item_ci_"))
    by_category = by_category.join(cat_reps, ["model", "category"]).join(over_tasks(in_category, "f1", ["model", "category"], "category"), ["model", "category"])
    pair = ["model", "reference"]
    d = b.paired_replicates(reps).groupBy(*pair).agg(*b.interval(F.col("d"), "item_ci_"))
    gaps = b.paired_replicates(tasks.select("task", F.lit(0).alias("b"), "model", "f1"), by_task=True)
    pairs = k.ordered_pairs(tasks).join(d, pair).join(over_tasks(gaps, "d", pair), pair)
    return {"models": models, "tasks": task_table, "classes": m.class_mcc(scored, label_def), "categories": by_category, "pairs": pairs}


def compare(decisions: DataFrame, label_def: DataFrame, baseline: str, iterations: int = 200) -> DataFrame:
    """Each model against a baseline: mean difference over tasks with its interval."""
    tasks = m.headline_f1(m.with_policy(decisions, "wrong"), label_def)
    base = tasks.filter(F.col("model") == baseline).select("task", F.col("headline_f1").alias("_b"))
    d = tasks.filter(F.col("model") != baseline).join(F.broadcast(base), "task").withColumn("d", F.col("headline_f1") - F.col("_b"))
    return b.mean_interval(d, "task", "d", iterations, ["model"])


def coverage(rows: DataFrame, models: DataFrame, tasks: DataFrame) -> DataFrame:
    return _coverage(rows, models, tasks)


def inventory(rows: DataFrame) -> DataFrame:
    """Rows, tasks, models and cells."""
    return rows.agg(F.count("*").alias("rows"), F.countDistinct("task").alias("tasks"), F.countDistinct("model").alias("models"), F.countDistinct(F.struct("task", "model")).alias("cells"))
