"""Calls of a labelling model as an operator: requests in, raw answers out, errors as rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered

#: A client takes (model, system text, user text) and returns the answer.
Client = Callable[[str, str, str], str]
ANSWER = "task string, model string, item_id string, raw_content string, latency_s double, parse_error string"


def flatten_requests(items: DataFrame, tasks: DataFrame) -> DataFrame:
    """Requests in a fixed order: by the order of the task, then of the item; ``request_index`` starts at 0."""
    rows = items.join(F.broadcast(tasks.select("task", "task_order")), "task")
    return numbered(rows, "pos", outer=["task_order"], name="request_index")


def plan_cells(items: DataFrame, models: DataFrame, skip: DataFrame | None = None, done: DataFrame | None = None) -> DataFrame:
    """Items with every model, without cells to skip and without answers that are there already."""
    rows = items.crossJoin(F.broadcast(models.select("model")))
    if skip is not None:
        rows = rows.join(F.broadcast(skip.select("model", "task")), ["model", "task"], "left_anti")
    if done is not None:
        rows = rows.join(done.select("task", "model", "item_id"), ["task", "model", "item_id"], "left_anti")
    return rows


def too_long(requests: DataFrame, limit: int, text: str = "user_content") -> DataFrame:
    """Requests over a limit of characters; nothing is ever cut."""
    return requests.filter(F.length(text) > limit)


def answer(requests: DataFrame, make_client: Callable[[], Client], system: str = "") -> DataFrame:
    """Call the client for each request; an exception becomes an error in its row."""
    rows = requests.select("task", "model", "item_id", "user_content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for part in parts:
            out = []
            for task, model, item, text in part.itertuples(index=False):
                began = time.perf_counter()
                try:
                    raw, error = client(model, system, text), None
                except Exception as e:  # noqa: BLE001  any failure of a call is a row
                    raw, error = None, f"{type(e).__name__}: {e}"[:200]
                out.append((task, model, item, raw, time.perf_counter() - began, error))
            yield pd.DataFrame(out, columns=["task", "model", "item_id", "raw_content", "latency_s", "parse_error"])

    return rows.mapInPandas(run, ANSWER)


def batches(requests: DataFrame, size: int, order: str, wrap: Sequence[str] = ("", "")) -> DataFrame:
    """Requests grouped ``size`` at a time in ``order`` (a whole number): the batch's ids and one numbered prompt."""
    rows = numbered(requests, order, by=["task", "model"], name="_i").withColumn("batch", F.floor(F.col("_i") / size))
    groups = rows.groupBy("task", "model", "batch").agg(F.sort_array(F.collect_list(F.struct("_i", "item_id", "user_content"))).alias("_rows"))
    lines = F.transform("_rows", lambda r: F.concat((r["_i"] % size + 1).cast("string"), F.lit(". "), F.lit(wrap[0]), r["user_content"], F.lit(wrap[1])))
    return groups.select("task", "model", "batch", F.col("_rows.item_id").alias("item_ids"), F.size("_rows").alias("n"), F.array_join(lines, "\n").alias("user_content"))


def join_batch_answers(groups: DataFrame, results: Column) -> DataFrame:
    """Items of a batch with the results at their positions."""
    rows = groups.withColumn("_r", results)
    return rows.select("task", "model", "batch", F.inline(F.arrays_zip("item_ids", "_r"))).select("task", "model", "batch", F.col("item_ids").alias("item_id"), F.col("_r.pred").alias("pred"), F.col("_r.parse_error").alias("parse_error"))


def with_responses(requests: DataFrame, results: DataFrame, key: str = "custom_id", order: str = "batch_seq") -> DataFrame:
    """Each request with its latest result; a request without one is a failure."""
    value = F.struct(*(c for c in results.columns if c not in (key, order)))
    last = results.groupBy(key).agg(F.max_by(value, order).alias("_r"))
    return requests.join(last, key, "left").select(*requests.columns, "_r.*", F.when(F.col("_r").isNull(), "missing").alias("failure"))


def dry_run(items: DataFrame, models: DataFrame) -> DataFrame:
    """Calls that a run would make, by task."""
    n = models.count()
    return items.groupBy("task").agg((F.count("*") * n).alias("calls"))


def newest_per_key(rows: DataFrame, key: Sequence[str], completed: str, source: str) -> DataFrame:
    """The newest row of each key; ties go to the last source by name."""
    pick = F.max_by(F.struct(*rows.columns), F.struct(completed, source))
    return rows.groupBy(*(F.col(k).alias(f"_g_{k}") for k in key)).agg(pick.alias("_row")).select("_row.*")


def request_rows(rows: DataFrame) -> DataFrame:
    """Requests with what tells them apart and how long they are: ``custom_id`` of model, task and item, and ``prompt_bytes``."""
    return rows.withColumns({"custom_id": F.sha2(F.concat_ws("|", "model", "task", "item_id"), 256), "prompt_bytes": F.octet_length("user_content")})


def decoded(rows: DataFrame) -> DataFrame:
    """Adds ``content``, ``tokens`` and ``failure`` from a provider's ``status`` and JSON ``body``."""
    kind = "struct<choices: array<struct<message: struct<content: string>>>, usage: struct<completion_tokens: long>>"
    rows = rows.withColumn("_b", F.from_json("body", kind))
    content = F.get("_b.choices", F.lit(0))["message"]["content"]
    failure = F.when(F.col("status") != 200, F.concat(F.lit("http "), F.col("status").cast("string"))).when(F.col("_b").isNull(), "no JSON").when(content.isNull(), "no content")
    return rows.withColumns({"content": content, "tokens": F.col("_b.usage.completion_tokens"), "failure": failure}).drop("_b")
