"""``python -m tallyframe.cli``: run models over items, sum up predictions, and keep a ledger of runs. All tables are Parquet folders."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .functions.parse import AnswerSpec, parsed
from .operators import inference as i
from .operators import state as s
from .operators.concurrent import answer_concurrently
from .sources import sinks
from .sources.manifests import label_table, model_table, task_table

EVENT = "run_id string, timestamp string, event string, status string, rows_written long, note string"
FINAL = ("completed", "failed", "cancelled")


def _made(name: str) -> Callable[[], i.Client]:
    """``module:function``, a function that makes a client."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _chosen(df: DataFrame, column: str, names: list[str] | None) -> DataFrame:
    if not names:
        return df
    if lost := set(names) - {r[0] for r in df.select(column).collect()}:
        raise SystemExit(f"no such {column}: {', '.join(sorted(lost))}")
    return df.filter(F.col(column).isin(names))


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Ask every chosen model for every chosen item, one at a time or in batches, and write predictions.

    With ``--merge-into`` cells that are asked replace those of an earlier table; with ``--resume`` items that it has without an error are
    not asked again. ``--dry-run`` only counts calls.
    """
    tasks, models = _chosen(task_table(spark, tree=args.tasks, active_only=not args.only_task), "name", args.only_task), _chosen(model_table(spark, tree=args.models), "name", args.only_model)
    items = spark.read.parquet(args.items).join(F.broadcast(tasks.select(F.col("name").alias("task"), "kind")), "task").withColumn("item_id", F.col("item_id").cast("string"))
    models = models.select(F.col("name").alias("model"))
    skip = spark.createDataFrame([tuple(x.split("/", 1)) for x in args.skip], "model string, task string") if args.skip else None
    old = spark.read.parquet(args.merge_into) if args.merge_into and _there(spark, args.merge_into) else None
    done = old.filter("parse_error IS NULL") if args.resume and old is not None else None
    cells = i.plan_cells(items, models, skip, done)
    if args.dry_run:
        return cells.groupBy("model", "task").agg(F.count("*").alias("calls"))
    out = None
    for size in args.batch_sizes:
        for task in tasks.collect():
            mine = cells.filter(F.col("task") == task.name)
            spec = AnswerSpec(task.kind, tuple(task.labels) if task.kind == "multi_binary" else (task.label_key,), tuple(task.labels))
            if size == 1:
                answers = answer_concurrently(mine, _made(args.client), task.prompt or "", args.open_calls, calls_per_second=args.calls_per_second)
                found = answers.withColumn("_r", parsed(F.col("raw_content"), spec)).select("task", "model", "item_id", "raw_content", "latency_s", F.coalesce("parse_error", "_r.parse_error").alias("parse_error"), F.col("_r.pred").alias("pred"))
            else:
                found = _in_batches(mine, task, spec, size, args)
            found = found.withColumn("batch_size", F.lit(size))
            out = found if out is None else out.unionByName(found)
    if old is not None:
        keys = ["task", "model", "item_id", "batch_size"]
        out = s.merge_into(old, out, keys).withColumn("batch_size", F.col("batch_size").cast("int"))
    out.write.mode("errorifexists").parquet(args.output)
    return spark.read.parquet(args.output).groupBy("model", "task", "batch_size").agg(F.count("*").alias("rows"), F.count("parse_error").alias("malformed"))


def _in_batches(cells: DataFrame, task, spec: AnswerSpec, size: int, args: argparse.Namespace) -> DataFrame:  # noqa: ANN001
    """Several items a call; each gets its share of the call's time, and all of them the error of a batch that can't be read."""
    from .functions.parse import parsed_batch

    rows = cells.withColumn("_order", F.xxhash64("item_id"))
    groups = i.batches(rows, size, "_order").withColumn("item_id", F.concat_ws("|", "item_ids"))
    answers = answer_concurrently(groups, _made(args.client), task.prompt or "", args.open_calls, calls_per_second=args.calls_per_second)
    both = groups.join(answers.select("task", "model", "item_id", "raw_content", "latency_s", F.col("parse_error").alias("_error")), ["task", "model", "item_id"])
    results = i.join_batch_answers(both, parsed_batch(F.col("raw_content"), F.col("n"), spec))
    share = both.select("task", "model", "batch", "raw_content", "_error", (F.col("latency_s") / F.col("n")).alias("latency_s"))
    out = results.join(share, ["task", "model", "batch"])
    return out.select("task", "model", "item_id", "raw_content", "latency_s", F.coalesce("_error", "parse_error").alias("parse_error"), "pred")


def long_form(predictions: DataFrame, items: DataFrame, tasks: DataFrame) -> DataFrame:
    """Predictions and gold maps (``gold``) of items as decisions, one row for each label field."""
    kinds = tasks.select(F.col("name").alias("task"), "kind")
    rows = predictions.join(items.select("task", F.col("item_id").cast("string").alias("item_id"), "gold"), ["task", "item_id"]).join(F.broadcast(kinds), "task")
    rows = rows.select("task", "kind", "model", "batch_size", "item_id", "latency_s", "parse_error", "pred", F.explode("gold").alias("label_field", "_g"))
    value = F.col("pred")[F.col("label_field")]
    score = F.col("kind") == "score"
    return rows.select("task", "kind", "model", "batch_size", "item_id", "label_field", F.col("_g").alias("gold"), value.alias("pred"), F.when(score, F.col("_g").try_cast("double")).alias("gold_num"), F.when(score, value.try_cast("double")).alias("pred_num"), "parse_error", "latency_s", F.col("item_id").alias("id"))


def summary(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """A row for each task, model and batch size; with several sizes, how far each agrees with single calls."""
    tasks, models = task_table(spark, tree=args.tasks), model_table(spark, tree=args.models).withColumnRenamed("name", "model")
    rows = long_form(spark.read.parquet(args.predictions), spark.read.parquet(args.items), tasks)
    found = None
    for size in sorted(r[0] for r in rows.select("batch_size").distinct().collect()):
        one = api.summarize(rows.filter(F.col("batch_size") == size), label_table(tasks), models, args.on_malformed, not args.all_labels, args.iterations).withColumn("batch_size", F.lit(size))
        found = one if found is None else found.unionByName(one)
    agreement = api.batch_agreement(rows).select("task", "model", "batch_size", "agreement")
    found = found.join(agreement, ["task", "model", "batch_size"], "left")
    found.write.mode("errorifexists").parquet(args.output)
    return spark.read.parquet(args.output).orderBy("task", "model", "batch_size")


def ledger(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Add an event to the ledger, or show the latest state of each run and the bucket it is in."""
    if args.event != "status":
        status = args.status or {"start": "running", "update": "running", "finish": "completed", "fail": "failed"}[args.event]
        if args.event == "finish" and status not in FINAL:
            raise SystemExit(f"a run ends as {', '.join(FINAL)}, not {status}")
        now = args.at or datetime.now(timezone.utc).isoformat(timespec="seconds")
        event = "fail" if status == "failed" else args.event
        row = spark.createDataFrame([(args.run_id, now, event, status, args.rows_written, args.note)], EVENT)
        sinks.append_events(row, args.ledger)
    events = spark.read.schema(EVENT).option("mode", "FAILFAST").json(args.ledger)
    latest = events.groupBy("run_id").agg(F.max_by(F.struct("timestamp", "event", "status", "note"), F.struct("timestamp", F.col("status").isin(*FINAL))).alias("_l"), F.min("timestamp").alias("started_at"), F.max_by("rows_written", F.when(F.col("rows_written").isNotNull(), F.col("timestamp"))).alias("rows_written"), F.count("*").alias("events"))
    bucket = F.when(F.col("_l.status").isin("failed", "cancelled"), "failed").when(F.col("_l.status") == "completed", "done").otherwise("active")
    return latest.select("run_id", "started_at", F.col("_l.timestamp").alias("updated_at"), F.col("_l.status").alias("status"), bucket.alias("bucket"), "rows_written", F.col("_l.note").alias("note"), "events").orderBy("bucket", F.desc("updated_at"), "run_id")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tallyframe", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    r = commands.add_parser("run", help=run.__doc__)
    for name in ("--items", "--tasks", "--models"):
        r.add_argument(name, required=True)
    r.add_argument("--client", help="module:function that makes a client")
    r.add_argument("--output")
    r.add_argument("--only-model", action="append")
    r.add_argument("--only-task", action="append")
    r.add_argument("--skip", action="append", metavar="MODEL/TASK")
    r.add_argument("--merge-into")
    r.add_argument("--resume", action="store_true")
    r.add_argument("--batch-sizes", type=lambda x: [int(n) for n in x.split(",")], default=[1])
    r.add_argument("--open-calls", type=int, default=8)
    r.add_argument("--calls-per-second", type=float)
    r.add_argument("--dry-run", action="store_true")
    u = commands.add_parser("summary", help=summary.__doc__)
    for name in ("--predictions", "--items", "--tasks", "--models", "--output"):
        u.add_argument(name, required=True)
    u.add_argument("--on-malformed", choices=("drop", "wrong"), default="drop")
    u.add_argument("--all-labels", action="store_true")
    u.add_argument("--iterations", type=int, default=0)
    g = commands.add_parser("ledger", help=ledger.__doc__)
    g.add_argument("event", choices=("start", "update", "finish", "fail", "status"))
    g.add_argument("--ledger", required=True)
    g.add_argument("--run-id")
    g.add_argument("--status")
    g.add_argument("--rows-written", type=int)
    g.add_argument("--note")
    g.add_argument("--at")
    for p in (r, u, g):
        p.add_argument("--json", action="store_true", help="print rows as JSON lines and not as a table")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[dict]:
    args = parser().parse_args(argv)
    if args.command == "ledger" and args.event != "status" and not args.run_id:
        raise SystemExit("--run-id is needed")
    if args.command == "run" and not args.dry_run and not (args.client and args.output):
        raise SystemExit("--client and --output are needed, but for a dry run")
    spark = spark or SparkSession.builder.appName("tallyframe").getOrCreate()
    found = {"run": run, "summary": summary, "ledger": ledger}[args.command](spark, args)
    rows = [r.asDict(True) for r in found.limit(1_000).collect()]  # what a terminal shows; the tables are whole
    print("\n".join(json.dumps(r, default=str) for r in rows) if args.json else sinks.markdown(found, 1_000))
    return rows


if __name__ == "__main__":
    main(sys.argv[1:])
