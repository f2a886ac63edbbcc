"""Long to wide and back; rows dealt to tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a task where rows are dealt by key.
SHARE = 100_000


def dealt(rows: DataFrame, by: Sequence[str], share: int | None = None) -> DataFrame:
    """Rows of equal ``by`` in one task, in as many tasks as cores, or more so that none has many more than ``share`` (``SHARE``) rows.

    Joins and groupings by these columns and others need no further exchange, also after rows were added to each one.
    Rows are counted first.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // (share or SHARE)))
    return rows.repartition(tasks, *by)


def score_matrix(rows: DataFrame, index: str, columns: str, value: str, names: Sequence[str]) -> DataFrame:
    """One column for each name; naming them saves a pass over the data."""
    return rows.groupBy(index).pivot(columns, list(names)).agg(F.first(value))


def long_form(rows: DataFrame, keys: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return rows.unpivot(list(keys), list(values), name, value)


def wide_predictions(decisions: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A ``gt_`` and a ``pred_`` column for each field, filled only for its own task."""
    aggs = [F.max(F.when(F.col("label_field") == f, F.col(src))).alias(f"{p}_{f}") for f in fields for p, src in (("gt", "gold"), ("pred", "pred"))]
    return decisions.groupBy("task", "model", "item_id").agg(*aggs, F.max("parse_error").alias("parse_error"))


def long_predictions(wide: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The rows of ``wide_predictions`` with a gold label, one for each field."""
    one = lambda f: F.struct(F.lit(f).alias("label_field"), F.col(f"gt_{f}").alias("gold"), F.col(f"pred_{f}").alias("pred"))
    return wide.select("task", "model", "item_id", "parse_error", F.inline(F.array(*map(one, fields)))).filter("gold IS NOT NULL")


def coverage(rows: DataFrame, models: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every model and task: which sources have rows, how many, and how many usable ones."""
    n = rows.groupBy("model", "task").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("n"), F.count_if(F.col("parse_error").isNull()).alias("usable"))
    grid = models.select("model").crossJoin(F.broadcast(tasks.select("task")))
    return grid.join(n, ["model", "task"], "left").fillna({"sources": "", "n": 0, "usable": 0})


def one_hot(rows: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    return rows.withColumns({f"{column}_{n}": (F.col(column) == n).cast("int") for n in names})


def columns_in_order(df: DataFrame, first: Sequence[str], prefixes: Sequence[str], rest: bool = True) -> DataFrame:
    """The named columns, then those of each prefix in the frame's order, then the others unless ``rest`` is false. Each comes once."""
    groups = [[c for c in df.columns if c.startswith(p)] for p in prefixes]
    names = dict.fromkeys([*first, *(c for g in groups for c in g), *(df.columns if rest else ())])
    return df.select(*(F.col(f"`{c}`") for c in names))


def pivot_mean(rows: DataFrame, index: Sequence[str], columns: str, value: str, names: Sequence[str]) -> DataFrame:
    """A wide table of means: one row for each index, one column for each name, null where there is no row."""
    return rows.groupBy(*index).pivot(columns, list(names)).agg(F.avg(value))
