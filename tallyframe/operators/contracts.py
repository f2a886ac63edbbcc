"""Data contracts: each returns the rows that break it, and ``require`` stops where there are any."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Rows break a contract."""


def require(broken: DataFrame, message: str) -> None:
    """Raise with a few of the rows that break a contract."""
    rows = broken.limit(5).collect()
    if rows:
        raise ContractError(f"{message}: {[r.asDict() for r in rows]}")


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")


def repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def uncovered(actual: DataFrame, expected: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys on one side only: ``side`` is missing or unexpected."""
    a, b = actual.select(*key).distinct(), expected.select(*key).distinct()
    return b.join(a, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(b, key, "left_anti").withColumn("side", F.lit("unexpected")))


def unequal_gold(a: DataFrame, b: DataFrame, key: Sequence[str], gold: str = "gold") -> DataFrame:
    rows = a.select(*key, F.col(gold).alias("_a")).join(b.select(*key, F.col(gold).alias("_b")), key)
    return rows.filter(~F.col("_a").eqNullSafe(F.col("_b")))


def outside(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def loss_share(before: DataFrame, after: DataFrame) -> float:
    """Share of rows that a cleaning step dropped."""
    n = before.count()
    return 1 - after.count() / n if n else 0.0


def require_loss(before: DataFrame, after: DataFrame, most: float = 0.2) -> None:
    if (share := loss_share(before, after)) > most:
        raise ContractError(f"{share:.1%} of the rows were dropped, more than {most:.0%}")


def checked_join(left: DataFrame, right: DataFrame, key: Sequence[str], validate: str, how: str = "left") -> DataFrame:
    """A join that first checks which sides have each key once: one_to_one, many_to_one or one_to_many."""
    if validate.startswith("one"):
        require(repeated_keys(left, key), "the left side repeats keys")
    if validate.endswith("one"):
        require(repeated_keys(right, key), "the right side repeats keys")
    return left.join(right, list(key), how)


def within_gate(rate: Column, limit: float = 0.05) -> Column:
    """The bound itself passes."""
    return rate <= limit


def wrong_sizes(df: DataFrame, expected: DataFrame, by: str) -> DataFrame:
    """Groups whose row count differs from the declared ``n``; groups on one side only count too."""
    n = df.groupBy(by).agg(F.count("*").alias("found"))
    return n.join(expected.select(by, F.col("n").alias("declared")), by, "full").filter(~F.col("found").eqNullSafe(F.col("declared")))


def apart(a: DataFrame, b: DataFrame, key: Sequence[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    rows = a.select(*key, F.col(value).alias("_a")).join(b.select(*key, F.col(value).alias("_b")), key, "full")
    return rows.filter(~(F.col("_a").eqNullSafe(F.col("_b")) | F.coalesce(F.abs(F.col("_a") - F.col("_b")) <= tolerance, F.lit(False))))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one frame only, repeats counted."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def malformed_response(fields: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """One field with a null or a value that isn't allowed taints the row."""
    bad = F.lit(False)
    for name, allowed in fields:
        bad = bad | F.col(name).isNull() | ~F.coalesce(F.col(name).isin(*allowed), F.lit(False))
    return bad


def is_full_range(df: DataFrame, index: str) -> DataFrame:
    """Whether an index is exactly 1 to N."""
    n, i = F.count("*"), F.col(index)
    return df.agg(((n == F.count_distinct(i)) & (F.coalesce(F.min(i), F.lit(1)) == 1) & (F.coalesce(F.max(i), F.lit(0)) == n)).alias("full_range"), n.alias("n"))


def returned_model_ok(requested: Column, returned: Column) -> Column:
    """The same name, or a dated version of an alias."""
    dated = requested.rlike(r"\d{4}-?\d{2}-?\d{2}$")
    return (requested == returned) | (~dated & F.startswith(returned, F.concat(requested, F.lit("-"))))


def require_usable(df: DataFrame) -> None:
    """At least one clean answer."""
    if df.filter("parse_error IS NULL").isEmpty():
        raise ContractError("no usable answer")


def usable_cells(rows: DataFrame, by: Sequence[str], error: str = "parse_error") -> DataFrame:
    """``by`` and whether the cell is ``usable``: it has a clean answer."""
    return rows.groupBy(*by).agg((F.count_if(F.col(error).isNull()) > 0).alias("usable"))


def audited(raw: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stored predictions against those parsed again from the raw answers (``pred`` on both sides).

    Returns keys with a ``finding``: mismatch, not stored, or no raw answer.
    """
    a, b = raw.select(*key, F.col("pred").alias("_a"), F.lit(True).alias("_raw")), stored.select(*key, F.col("pred").alias("_b"), F.lit(True).alias("_stored"))
    found = F.when(F.col("_stored").isNull(), "not stored").when(F.col("_raw").isNull(), "no raw answer").when(~F.col("_a").eqNullSafe(F.col("_b")), "mismatch")
    return a.join(b, list(key), "full").select(*key, found.alias("finding")).filter("finding IS NOT NULL")


def broken_cells(rows: DataFrame, panel: DataFrame, panel_hash: str, models: DataFrame | None = None) -> DataFrame:
    """Cells of a checkpoint (``task, model, item_id, panel_hash``) that don't hold exactly the panel's items (``task, item_id``).

    With ``models``, a cell of a model and a task of the panel that has no row at all is broken too. Rows and panel that are dealt by
    ``item_id`` and ``task`` (``reshape.dealt``) aren't moved again.
    """
    known = panel.select("task", "item_id").distinct().withColumn("_known", F.lit(True))
    item = rows.join(known, ["item_id", "task"], "left").groupBy("task", "model", "item_id")
    item = item.agg(F.count("*").alias("_n"), F.bool_and(F.col("panel_hash") == panel_hash).alias("_same"), F.bool_or("_known").alias("_known"))
    cells = item.groupBy("task", "model").agg(F.sum("_n").alias("rows"), F.bool_and("_same").alias("same_panel"), F.count_if("_known").alias("matched"))
    sizes = panel.groupBy("task").agg(F.count("*").alias("panel"))
    if models is not None:
        due = sizes.select("task").crossJoin(F.broadcast(models.select("model").distinct()))  # tasks by models
        cells = due.join(cells, ["task", "model"], "full")
    out = cells.join(F.broadcast(sizes), "task", "left").fillna(0, ["rows", "matched", "panel"]).fillna(False, ["same_panel"])
    return out.filter("NOT same_panel OR rows <> panel OR matched <> panel").select("task", "model", "rows", "matched", "panel", "same_panel")


def unequal_cells(a: DataFrame, b: DataFrame, key: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Cells that differ between two frames, by key and column; numbers may differ by ``tolerance``."""
    columns = [c for c in a.columns if c not in key]
    joined = a.select(*key, F.struct(*columns).alias("_a")).join(b.select(*key, F.struct(*columns).alias("_b")), list(key), "full")
    def differs(c: str) -> Column:
        x, y = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        same = x.eqNullSafe(y)
        if dict(a.dtypes)[c] in ("double", "float"):
            same = same | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))
        return F.when(~same, F.lit(c))

    return joined.select(*key, F.explode(F.array_compact(F.array(*map(differs, columns)))).alias("column"))


def next_stage(pilot: bool, remainder: bool, gate_passed: bool | None) -> str:
    """What a run does next: the pilot, the gate, the remainder if the gate passed, or nothing."""
    if not pilot:
        return "pilot"
    if gate_passed is None:
        return "gate"
    return "stopped" if not gate_passed else "done" if remainder else "remainder"


def answer_findings(answers: DataFrame, expected: DataFrame, limits: DataFrame, key: Sequence[str] = ("task", "item_id")) -> DataFrame:
    """What is wrong with the answers of a stage, by key: ``stage, key, finding``.

    ``answers`` has ``stage``, the key, ``prompt_tokens``, ``output_tokens`` and ``finish_reason``; ``expected`` the stage and key of every due answer;
    ``limits`` by stage ``context`` and ``max_output``. Findings: ``missing``, ``not expected``, ``repeated``, ``no usage``, ``output over limit``,
    ``over context``, ``truncated`` (stopped by length, or as many tokens as the limit allows).
    """
    names = ["stage", *key]
    have = answers.groupBy(*names).agg(F.count("*").alias("_n"), F.max("prompt_tokens").alias("_in"), F.max("output_tokens").alias("_out"), F.max((F.col("finish_reason") == "length").cast("int")).alias("_cut"), F.count_if(F.col("prompt_tokens").isNull() | F.col("output_tokens").isNull()).alias("_void"))
    both = expected.select(*names).distinct().withColumn("_due", F.lit(True)).join(have, names, "full").join(F.broadcast(limits.select("stage", "context", "max_output")), "stage", "left")
    found = {
        "missing": F.col("_n").isNull(),
        "not expected": F.col("_due").isNull(),
        "repeated": F.col("_n") > 1,
        "no usage": F.col("_void") > 0,
        "output over limit": F.col("_out") > F.col("max_output"),
        "over context": F.col("_in") + F.col("_out") > F.col("context"),
        "truncated": (F.col("_cut") == 1) | (F.col("_out") == F.col("max_output")),
    }
    marks = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in found.items())))
    return both.select(*names, F.explode(marks).alias("finding"))


def stage_coverage(answers: DataFrame, expected: DataFrame, limits: DataFrame, key: Sequence[str] = ("task", "item_id")) -> DataFrame:
    """By stage: ``due``, ``answered``, findings of each kind as a map, and whether the stage ``passed`` without any."""
    findings = answer_findings(answers, expected, limits, key).groupBy("stage", "finding").agg(F.count("*").alias("_n"))
    kinds = findings.groupBy("stage").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("finding", "_n")))).alias("findings"))
    due = expected.select("stage", *key).distinct().groupBy("stage").agg(F.count("*").alias("due"))
    got = answers.select("stage", *key).distinct().groupBy("stage").agg(F.count("*").alias("answered"))
    out = due.join(got, "stage", "full").join(kinds, "stage", "left").fillna(0, ["due", "answered"])
    return out.withColumn("passed", F.col("findings").isNull())
