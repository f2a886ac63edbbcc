"""Run ledgers and resuming, for frames at rest. ``tallyframe.streaming`` has the same fold for streams."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Events that end a run, and the bucket of each last event.
FINAL = ("finish", "fail")
BUCKETS = {"start": "active", "update": "active", "finish": "completed", "fail": "failed", "table": "tabled"}


def latest_runs(events: DataFrame, key: str = "run_id", order: str = "timestamp", event: str = "event", fields: Sequence[str] = (), final: Sequence[str] = FINAL) -> DataFrame:
    """Fold events to a row for each run: later values that are there win, first and last times are kept."""
    aggs = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    return events.groupBy(key).agg(
        F.min(order).alias("started_at"), F.max(order).alias("updated_at"), F.max(F.when(F.col(event).isin(*final), F.col(order))).alias("ended_at"), F.max_by(event, F.struct(order, event)).alias("last_event"), F.count("*").alias("events"), *aggs
    )


def status_board(runs: DataFrame, key: str = "run_id", most: int = 12) -> DataFrame:
    """Runs by bucket, newest first, ``most`` in each."""
    bucket = F.coalesce(F.create_map(*(F.lit(x) for kv in BUCKETS.items() for x in kv))[F.col("last_event")], F.lit("other"))
    rows = runs.withColumn("bucket", bucket)
    return rows.withColumn("place", F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("updated_at"), key))).filter(F.col("place") <= most)


def unfinished(expected: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """What is left to do."""
    return expected.join(done.select(*key).distinct(), list(key), "left_anti")


def reusable_keys(expected: DataFrame, done: DataFrame, key: Sequence[str], usable: Column) -> DataFrame:
    """The keys of ``expected``, each once, and whether ``done`` has a usable row of it (``reusable``); a key with a null has none.

    One grouping of both, without a join. Frames that are dealt alike by some of the key (``reshape.dealt``) aren't moved again.
    """
    whole = functools.reduce(Column.__and__, (F.col(k).isNotNull() for k in key))
    due = expected.select(*key, F.lit(True).alias("_due"), F.lit(False).alias("_ready"))
    ready = done.filter(usable & whole).select(*key, F.lit(False).alias("_due"), F.lit(True).alias("_ready"))
    both = due.unionAll(ready).groupBy(*key).agg(F.bool_or("_due").alias("_due"), F.bool_or("_ready").alias("reusable"))
    return both.filter("_due").select(*key, "reusable")


def split_reusable(expected: DataFrame, done: DataFrame, key: Sequence[str], usable: Column) -> tuple[DataFrame, DataFrame]:
    """What is done already and may be used again, and the keys that must still be made; together they are ``expected``, each key once."""
    keys = expected.select(*key).distinct()
    kept = done.filter(usable).dropDuplicates(list(key)).join(keys, list(key), "left_semi")
    return kept, reusable_keys(expected, done, key, usable).filter("NOT reusable").select(*key)


def complete_cells(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Cells whose rows, distinct items and fingerprint are those of the manifest."""
    n = rows.groupBy("task", "model").agg(F.count("*").alias("rows"), F.countDistinct("item_id").alias("items"), F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high"))
    m = manifest.select("task", F.col("n").alias("want"), F.col("fingerprint").alias("_f"))
    ok = (F.col("rows") == F.col("want")) & (F.col("items") == F.col("want")) & (F.col("low") == F.col("_f")) & (F.col("high") == F.col("_f"))
    return n.join(F.broadcast(m), "task").select("task", "model", ok.alias("complete"))


def merge_into(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows replace old ones of the same key; columns of either side stay, the old ones first."""
    as_text = lambda df: df.withColumns({k: F.col(k).cast("string") for k in key})
    old, new = as_text(old), as_text(new)
    return old.join(new.select(*key).distinct(), list(key), "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def run_summary(rows: DataFrame, by: Sequence[str], neutral: Sequence[str] = ()) -> DataFrame:
    """Items, distinct gold labels, share of malformed answers, tokens, and the share of neutral labels among answers."""
    plain = F.when(F.col("pred").isNotNull(), F.lower("pred").isin(*neutral).cast("double"))
    return rows.groupBy(*by).agg(F.count("*").alias("items"), F.countDistinct("gold").alias("labels"), F.avg(F.col("parse_error").isNotNull().cast("double")).alias("malformed"), F.sum("tokens").alias("tokens"), F.avg(plain).alias("neutral"))


def stages(rows: DataFrame, by: Sequence[str], pilot: str, done: str, limit: float) -> DataFrame:
    """What each cell does next: its pilot, nothing because the gate stopped it, nothing because it is done, or its remainder."""
    is_pilot = F.col(pilot)
    bad = F.avg(F.when(is_pilot, F.col("parse_error").isNotNull().cast("double")))
    stage = F.when(F.count_if(is_pilot) == 0, "pilot").when(bad > limit, "stopped").when(F.count_if(F.col(done)) > 0, "done").otherwise("remainder")
    return rows.groupBy(*by).agg(stage.alias("stage"))


def fingerprint(settings: Mapping[str, Column]) -> Column:
    """A digest of named settings, whatever their order."""
    return F.sha2(F.concat_ws("|", *(F.concat(F.lit(f"{k}="), settings[k].cast("string")) for k in sorted(settings))), 256)


def pool_and_test(rows: DataFrame, test_keys: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows split into those that may train and those of the test, by key."""
    keys = test_keys.select(*key).distinct()
    return rows.join(keys, list(key), "left_anti"), rows.join(keys, list(key), "left_semi")
