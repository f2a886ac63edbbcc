"""From raw sources to item tables: cleaning, conflicts, duplicates, samples and splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_text, relabelled
from .numbering import numbered


def digest_order(seed: str, *key: str) -> Column:
    """An order that looks random and is the same everywhere."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in key)), 256)


def without_conflicts(rows: DataFrame, key: Sequence[str], gold: Sequence[str]) -> DataFrame:
    """Drop every key whose rows disagree on gold (a null is a value of its own)."""
    facts = F.struct(*(F.col(g) for g in gold))
    bad = rows.groupBy(*key).agg((F.min(facts) != F.max(facts)).alias("_bad")).filter("_bad").select(*(F.col(k).alias(f"_k_{k}") for k in key))
    cond = F.lit(True)
    for k in key:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(bad, cond, "left_anti")


def conflicts(rows: DataFrame, key: Sequence[str], gold: Sequence[str]) -> DataFrame:
    """The keys that ``without_conflicts`` drops, for sources where a conflict is an error."""
    facts = F.struct(*(F.col(g) for g in gold))
    return rows.groupBy(*key).agg(F.countDistinct(facts).alias("versions")).filter("versions > 1")


def first_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by an explicit order."""
    first = F.min(F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], F.struct(*map(F.col, rows.columns)).alias("_row")))
    return rows.groupBy(*(F.col(k).alias(f"_g_{k}") for k in key)).agg(first.alias("_first")).select("_first._row.*")


def top_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def both_ends(rows: DataFrame, key: Sequence[str], order: str, tie: str, n: int) -> DataFrame:
    """The first and last n of each group."""
    low, high = (top_per_key(rows, key, o, n) for o in ([F.asc(order), F.asc(tie)], [F.desc(order), F.desc(tie)]))
    return low.unionByName(high).dropDuplicates([*key, tie])


def median_and_longest(rows: DataFrame, by: str, length: str, key: str) -> DataFrame:
    """Of each group the item at the lower median of (length, key) and the longest; ``length`` is a whole number.

    The median's length comes from counts by length; then only items of that length are ordered by key.
    """
    counts = rows.groupBy(by, length).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(by).orderBy(length).rowsBetween(W.unboundedPreceding, 0))
    counts = counts.select(by, length, (upto - F.col("_n")).alias("_before"), upto.alias("_upto"), F.sum("_n").over(W.partitionBy(by)).alias("_all"))
    middle = F.floor((F.col("_all") + 1) / 2)
    at = counts.filter((F.col("_before") < middle) & (middle <= F.col("_upto"))).select(by, length, (middle - F.col("_before") - 1).alias("_place"))
    median = numbered(rows.join(at, [by, length]), key, by=[by], name="_pos").filter("_pos = _place").select(*rows.columns)
    longest = rows.groupBy(F.col(by).alias("_by")).agg(F.max_by(F.struct(*rows.columns), F.struct(length, key)).alias("_row")).select("_row.*")
    return median.unionByName(longest).distinct()


def with_first(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the least value of the whole table, one row that goes to all others."""
    return rows.crossJoin(F.broadcast(rows.agg(F.min(value).alias(name))))


def sampled(rows: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """n rows by digest order."""
    return rows.orderBy(digest_order(seed, key), key).limit(n)


def stratified(rows: DataFrame, by: Sequence[str], n: int, seed: str, key: str) -> DataFrame:
    """n rows of each stratum by digest order."""
    return top_per_key(rows, by, [digest_order(seed, key), F.col(key)], n)


def two_stage_sample(rows: DataFrame, n_first: int, n_second: int, seed: str, pos: str) -> DataFrame:
    """Two disjoint samples by digest order, the first block before the second, each in row order: ``block, ordinal``."""
    first = sampled(rows, n_first, seed, pos).withColumn("block", F.lit(1))
    rest = sampled(rows.join(first.select(pos), pos, "left_anti"), n_second, f"{seed}+1", pos).withColumn("block", F.lit(2))
    out = first.unionByName(rest)
    return out.withColumn("ordinal", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("block", pos)) - 1)


def unique_ids(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Repeats of an id get ``__dup1``, ``__dup2``, ... in order."""
    n = F.row_number().over(W.partitionBy(key).orderBy(order)) - 1
    return rows.withColumn("_n", n).withColumn(key, F.when(F.col("_n") > 0, F.concat(F.col(key).cast("string"), F.lit("__dup"), F.col("_n").cast("string"))).otherwise(F.col(key).cast("string"))).drop("_n")


def class_preserving_draw(rows: DataFrame, label: str, n: int, seed: str, key: str) -> DataFrame:
    """One row of every class, then others by digest order up to n."""
    order = digest_order(seed, key)
    first = top_per_key(rows, [label], [order, F.col(key)], 1)
    rest = rows.join(F.broadcast(first.select(key)), key, "left_anti").select(*rows.columns)
    ranked = first.withColumn("_first", F.lit(True)).unionByName(rest.withColumn("_first", F.lit(False)))
    return ranked.orderBy(F.desc("_first"), order, key).limit(n).drop("_first")


def split_parts(rows: DataFrame, key: str, seed: str, shares: Mapping[str, float]) -> DataFrame:
    """Adds ``part``: named shares of a hash of the key."""
    u = F.conv(F.substring(digest_order(seed, key), 1, 8), 16, 10).cast("double") / 2**32
    part, low = None, 0.0
    for name, share in shares.items():
        low += share
        part = F.when(u < low, name) if part is None else part.when(u < low, name)
    return rows.withColumn("part", part.otherwise(list(shares)[-1]))


def prefix_split(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """Adds ``pilot``: the first n of each group by an order without ties."""
    first = top_per_key(rows.select(by, order), [by], [F.col(order)], n).withColumn("pilot", F.lit(True))
    return rows.join(first, [by, order], "left").withColumn("pilot", F.coalesce("pilot", F.lit(False)))


def keep_named_and_share(rows: DataFrame, named: Column, share: float, seed: str, key: str) -> DataFrame:
    """All rows that match and a share of the others."""
    u = F.conv(F.substring(digest_order(seed, key), 1, 8), 16, 10).cast("double") / 2**32
    return rows.filter(named | (u < share))


def build_items(source: DataFrame, task: str, id_col: str, text_col: str, gold_col: str, order_col: str, labels: Mapping[str, str] | None = None, exclude: Sequence[str] = (), allowed: Sequence[str] | None = None, dedup: bool = True) -> DataFrame:
    """The skeleton of a corpus builder: clean, rename, exclude, check the domain, drop conflicts, drop repeats.

    Renaming comes before excluding. Rows without text or gold go. A label outside ``allowed`` stops the query.
    """
    gold = relabelled(F.col(gold_col).cast("string"), labels or {})
    rows = source.select(F.lit(task).alias("task"), F.concat(F.lit(f"{task}_"), F.col(id_col).cast("string")).alias("item_id"), F.col(order_col).alias("_order"), clean_text(text_col).alias("text"), gold.alias("gold"))
    rows = rows.filter("text <> '' AND gold IS NOT NULL")
    if exclude:
        rows = rows.filter(~F.col("gold").isin(*exclude))
    if allowed is not None:
        ok = F.col("gold").isin(*allowed)
        rows = rows.withColumn("gold", F.when(ok, F.col("gold")).otherwise(F.raise_error(F.concat(F.lit("label not allowed: "), F.col("gold"))).cast("string")))
    rows = without_conflicts(rows, ["text"], ["gold"])
    if dedup:
        rows = first_per_key(rows, ["text", "gold"], ["_order", "item_id"])
    return rows.drop("_order")


def majority_votes(votes: DataFrame, unit: str, label: str) -> DataFrame:
    """Vote counts by unit: the majority label, its share, and whether it has more than half; ties go to the lowest."""
    n = votes.groupBy(unit, label).agg(F.count("*").alias("n"))
    out = n.groupBy(unit).agg(F.max_by(label, F.struct(F.col("n"), F.lit(0))).alias("_any"), F.max("n").alias("top"), F.sum("n").alias("n_votes"), F.sort_array(F.collect_list(F.struct(F.col("n").alias("n"), F.col(label).cast("string").alias("l")))).alias("_all"))
    winners = F.filter("_all", lambda x: x["n"] == F.col("top"))
    return out.select(unit, F.array_min(F.transform(winners, lambda x: x["l"])).alias("majority"), (F.col("top") / F.col("n_votes")).alias("share"), "n_votes", (2 * F.col("top") > F.col("n_votes")).alias("strict"), (F.size(winners) > 1).alias("tied"))


def vote_pivot(votes: DataFrame, unit: str, label: str, labels: Sequence[str]) -> DataFrame:
    """One count column for each label, zeros filled."""
    return votes.groupBy(unit).agg(*(F.count_if(F.col(label) == x).alias(f"votes_{x}") for x in labels))


def majority_of_three(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Majority of three 0/1 ratings, and whether all agree."""
    n = a + b + c
    return (n >= 2).cast("int"), n.isin(0, 3)


def pairs_under_both(rows: DataFrame, entity: str, condition: str, value: str, order: str | None = None) -> DataFrame:
    """Entities seen under both conditions, with the mean of each (rounded half to even) and their difference.

    With ``order``, doubles are added up in that order, so that means next to a half are rounded alike however rows are dealt out.
    """
    side = lambda want: F.col(condition) if want else ~F.col(condition)
    mean = lambda want: F.avg(F.when(side(want), F.col(value)))
    if order:
        upto = W.partitionBy(entity, condition).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        rows = rows.withColumn("_upto", F.sum(value).over(upto))
        mean = lambda want: F.max_by(F.when(side(want), F.col("_upto")), F.when(side(want), F.col(order))) / F.count(F.when(side(want), F.col(value)))
    out = rows.groupBy(entity).agg(F.countDistinct(condition).alias("_c"), mean(True).alias("shown"), mean(False).alias("hidden")).filter("_c = 2")
    return out.select(entity, F.bround("shown", 0).alias("shown"), F.bround("hidden", 0).alias("hidden"), (F.col("shown") - F.col("hidden")).alias("effect"))


def disagreement_sample(decisions: DataFrame, deltas: DataFrame, first: str, second: str, ends: int, per_task: int, seed: str) -> DataFrame:
    """Items that exactly one of two models has right in all labels: ``task, id, first_right, second_right``.

    Only tasks at either end of ``deltas`` (``task, delta``: one row for each task) take part; of each task at
    most ``per_task`` items stay, by digest order.
    """
    chosen = both_ends(deltas.select("task", "delta", F.lit(1).alias("_all")), ["_all"], "delta", "task", ends).select("task")
    right = F.coalesce(F.col("gold") == F.col("pred"), F.lit(False))
    of = lambda model: F.bool_and(F.when(F.col("model") == model, right))
    rows = decisions.filter(F.col("model").isin(first, second)).join(F.broadcast(chosen), "task", "left_semi")
    apart = rows.groupBy("task", "id").agg(of(first).alias("first_right"), of(second).alias("second_right")).filter("first_right <> second_right")
    return top_per_key(apart, ["task"], [digest_order(seed, "task", "id"), F.col("id")], per_task)


def active_tasks(tasks: DataFrame, named: Sequence[str] = ()) -> DataFrame:
    """Tasks whose ``status`` isn't excluded, and those that are named."""
    return tasks.filter((F.coalesce("status", F.lit("active")) != "excluded") | F.col("task").isin(*named))


def after_baseline(rows: DataFrame, by: Sequence[str], order: str, n: int) -> DataFrame:
    """Items after the first n of each group by ``order`` (a whole number): those that a later version added."""
    return numbered(rows, order, by=by, name="_at").filter(F.col("_at") >= n).select(*rows.columns)


def most_eligible(rows: DataFrame, by: Sequence[str], group: str) -> DataFrame:
    """Of each key the group with most rows; ties go to the lowest: the key, ``group`` and ``n``."""
    n = rows.groupBy(*by, group).agg(F.count("*").alias("_n"))
    best = n.groupBy(*by).agg(F.max("_n").alias("n"))
    return n.join(best, [*by]).filter("_n = n").groupBy(*by, "n").agg(F.min(group).alias(group)).select(*by, group, "n")


def smallest(rows: DataFrame, where: Column, order: Sequence[str], n: int) -> DataFrame:
    """The n first rows that a condition leaves, by several columns with nulls last; each task keeps n before any row moves."""
    return rows.filter(where).orderBy(*(F.asc_nulls_last(c) for c in order)).limit(n)


def keys_of_both(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct keys that both frames have; columns are matched by place, and nulls match."""
    return left.intersect(right)


def with_item_texts(sample: DataFrame, items: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """The rows to read with their item's text; a row whose item has none keeps a null."""
    return sample.join(items.select(*key, text), list(key), "left")
