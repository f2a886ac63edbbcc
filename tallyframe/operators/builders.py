"""Corpus builders as recipes: what a source is turned into is declared, and one plan carries it out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, mapped_or_fail, underscored
from .contracts import ContractError, repeated_keys, require, require_columns, require_loss
from .corpus import first_per_key, majority_of_three, top_per_key, without_conflicts
from .numbering import numbered


@dataclass(frozen=True)
class Recipe:
    """How the rows of one or more sources become the items of a task.

    ``text`` are columns that are joined by ``between``. ``gold`` is one column, or several 0/1 columns of a
    multi-label task. ``agree`` keeps rows where two coders agree and ``majority`` takes three ratings as gold.
    ``labels`` maps codes to names; a code without one stops the build, or drops the row with ``known_only``.
    ``conflicts`` says what happens to texts with several golds: drop them, stop with an error, or keep them.
    """

    task: str
    ids: tuple[str, ...]
    text: tuple[str, ...]
    gold: tuple[str, ...]
    order: str
    between: str = " "
    labels: Mapping[str, str] = field(default_factory=dict)
    known_only: bool = False
    exclude: tuple[str, ...] = ()
    agree: tuple[str, str] | None = None
    majority: tuple[str, str, str] | None = None
    pair: tuple[str, ...] = ()
    conflicts: str = "drop"
    dedup: bool = True
    most_lost: float | None = None


def build(recipe: Recipe, sources: Mapping[str, DataFrame]) -> DataFrame:
    """Items of a task: ``task, item_id, source, text``, the columns of ``pair`` and of gold.

    Sources are unioned with their name as provenance. Rows without a text or a gold go; renaming comes before
    excluding. Item ids must be unique in the end.
    """
    needed = {*recipe.ids, *recipe.text, *recipe.pair, recipe.order, *(recipe.majority or recipe.gold), *(recipe.agree or ())}
    for df in sources.values():
        require_columns(df, sorted(needed))
    rows = reduce(DataFrame.unionByName, (df.select(*sorted(needed), F.lit(name).alias("source")) for name, df in sources.items()))
    before = rows
    if recipe.agree:
        rows = rows.filter(F.col(recipe.agree[0]) == F.col(recipe.agree[1]))
    golds: dict[str, Column] = {g: F.col(g) for g in recipe.gold}
    if recipe.majority:
        golds = {recipe.gold[0]: majority_of_three(*map(F.col, recipe.majority))[0]}
    if recipe.labels:
        code = golds[recipe.gold[0]].cast("string")
        if recipe.known_only:
            rows, known = rows.filter(code.isin(*recipe.labels)), recipe.labels
        else:
            known = recipe.labels
        golds = {recipe.gold[0]: mapped_or_fail(code, known)}
    item_id = F.concat(F.lit(f"{recipe.task}_"), F.concat_ws("_", *(underscored(F.col(c).cast("string")) for c in recipe.ids)))
    text = clean_text(F.concat_ws(recipe.between, *map(F.col, recipe.text)))
    rows = rows.select(F.lit(recipe.task).alias("task"), item_id.alias("item_id"), "source", F.col(recipe.order).alias("_order"), text.alias("text"), *recipe.pair, *(c.alias(g) for g, c in golds.items()))
    rows = rows.filter("text <> ''").dropna(subset=list(recipe.gold))
    if recipe.exclude:
        rows = rows.filter(~F.col(recipe.gold[0]).isin(*recipe.exclude))
    key = ["text", *recipe.pair]
    if recipe.conflicts == "drop":
        rows = without_conflicts(rows, key, list(recipe.gold))
    elif recipe.conflicts == "error":
        several = rows.groupBy(*key).agg(F.count_distinct(F.struct(*recipe.gold)).alias("golds")).filter("golds > 1")
        require(several, "texts with several golds")
    if recipe.dedup:
        rows = first_per_key(rows, [*key, *recipe.gold], ["_order", "item_id"])
    if recipe.most_lost is not None:
        require_loss(before, rows, recipe.most_lost)
    require(repeated_keys(rows, ["item_id"]), "item ids repeat")
    return rows.drop("_order")


def aligned(frames: Sequence[DataFrame], order: str) -> DataFrame:
    """Frames zipped by row: the n-th row by ``order`` (a whole number) of each; frames of other lengths are an error."""
    sizes = [df.count() for df in frames]
    if len(set(sizes)) > 1:
        raise ContractError(f"row-aligned sources have {sizes} rows")
    out = numbered(frames[0], order, name="_at")
    for df in frames[1:]:
        out = out.join(numbered(df, order, name="_at").drop(order), "_at")
    return out.drop("_at")


def label_sets(rows: DataFrame, key: Sequence[str], label: str, none: str = "none", several: str = "mixed") -> DataFrame:
    """One label for each key: its only one, ``several`` where there are more, ``none`` where all are null."""
    found = F.collect_set(label)
    return rows.groupBy(*key).agg(F.when(F.size(found) == 0, none).when(F.size(found) > 1, several).otherwise(found[0]).alias(label))


def modal_code(codings: DataFrame, unit: str, coder: str, order: str, domain: str, code: str) -> DataFrame:
    """Units whose domain has more than half of the coders, with their modal code and mean code; ties are dropped.

    Only the earliest coding of each coder and unit counts.
    """
    first = first_per_key(codings, [unit, coder], [order])
    n = first.groupBy(unit, domain).agg(F.count("*").alias("_n"))
    whole = n.groupBy(F.col(unit).alias("_u")).agg(F.sum("_n").alias("coders"), F.max_by(domain, "_n").alias("_d"), F.max("_n").alias("_top")).filter("2 * _top > coders")
    inside = first.join(whole, (F.col(unit) == F.col("_u")) & (F.col(domain) == F.col("_d")))
    codes = inside.groupBy(unit, domain, "coders", code).agg(F.count("*").alias("_n"))
    best = codes.groupBy(unit, domain, "coders").agg(F.max("_n").alias("_m"), F.max_by(code, "_n").alias(code), (F.sum(F.col(code) * F.col("_n")) / F.sum("_n")).alias("mean_code"))
    tied = codes.groupBy(F.col(unit).alias("_u"), F.col("_n").alias("_k")).agg(F.count("*").alias("_codes"))
    out = best.join(tied, (F.col(unit) == F.col("_u")) & (F.col("_m") == F.col("_k"))).filter("_codes = 1")
    return out.select(unit, domain, "coders", code, "mean_code")


def voted_items(votes: DataFrame, unit: str, label: str, least: int = 3) -> DataFrame:
    """Units with at least ``least`` votes of which one label has more than half: ``unit, gold, n_votes, share``."""
    n = votes.groupBy(unit, label).agg(F.count("*").alias("_n"))
    out = n.groupBy(unit).agg(F.max_by(label, "_n").alias("gold"), F.max("_n").alias("_top"), F.sum("_n").alias("n_votes")).filter(f"n_votes >= {least} AND 2 * _top > n_votes")
    return out.select(unit, "gold", "n_votes", (F.col("_top") / F.col("n_votes")).alias("share"))


def class_take(rows: DataFrame, label: str, key: str, n: int, seed: str) -> DataFrame:
    """At most ``n`` rows of each class by digest order."""
    from .corpus import digest_order

    return top_per_key(rows, [label], [digest_order(seed, key), F.col(key)], n)


def gold_of(kind: str, fields: Mapping[str, Column]) -> Column:
    """Gold by kind of label: a number, a text, or for several labels a map from name to 0 or 1."""
    if kind == "multi_binary":
        return F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(c.cast("int") for c in fields.values())))
    (only,) = fields.values()
    return only.cast({"binary": "int", "score": "double"}.get(kind, "string"))


def answer_schema(kind: str, fields: Sequence[str], labels: Sequence[str] = (), low: float = 0, high: float = 100) -> dict:
    """The JSON schema of an answer: an object with exactly these fields."""
    one = {"categorical": {"type": "string", "enum": list(labels)}, "score": {"type": "number", "minimum": low, "maximum": high}}.get(kind, {"type": "integer", "enum": [0, 1]})
    return {"type": "object", "properties": dict.fromkeys(fields, one), "required": list(fields), "additionalProperties": False}
