"""Resampling with draws that a hash decides, so that any engine repeats them.

Replicate b of a task with n items takes, in slot j, the item that a hash of (seed, task, b, j) names; one SHA-256
serves eight slots. Draws are shared by all models of a task, which pairs the comparisons. ``codes.replicate_counts``
counts patterns of answers where draws are made, ``draws.weighted_sums`` brings draws and values together, so no replicate is ever scored row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .codes import replicate_counts
from .draws import SLOTS, weighted_sums
from .numbering import placed

LEVELS = (0.025, 0.975)


def hash_draw(n: Column, *parts: Column | str) -> Column:
    """A number from 0 to n - 1 that the parts decide."""
    text = F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long"), n)


def slots(sizes: DataFrame, iterations: int, seed: str = "boot") -> DataFrame:
    """The position that each slot of each replicate draws: ``task, b, pos``. ``sizes`` has task and n.

    Replicates are dealt to as many partitions as there are cores, so a few large tasks don't stay in one.
    """
    parts = sizes.sparkSession.sparkContext.defaultParallelism
    rows = sizes.select("task", F.col("n").cast("long").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("b")).repartition(parts, "task", "b")
    rows = rows.select("task", "b", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SLOTS))).alias("c"))
    rows = rows.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(seed), "task", F.col("b").cast("string"), F.col("c").cast("string")), 256))
    drawn = F.array(*(F.pmod(F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("long"), F.col("n")) for i in range(SLOTS)))
    return rows.select("task", "b", F.explode(F.slice(drawn, F.lit(1), F.least(F.lit(SLOTS), (F.col("n") - F.col("c") * SLOTS)).cast("int"))).alias("pos"))


def item_weights(sizes: DataFrame, iterations: int, seed: str = "boot") -> DataFrame:
    """How often each item position is drawn: ``task, b, pos, w``. ``sizes`` has task and n."""
    return slots(sizes, iterations, seed).groupBy("task", "b", "pos").agg(F.count("*").alias("w"))


def label_replicates(decisions: DataFrame, labels: DataFrame, iterations: int, seed: str = "boot") -> DataFrame:
    """F1 of each label (``task, label``) in every replicate: ``task, model, b, label, f1``; labels that a replicate lacks have no row.

    Items have a place in their task by id. Labels that don't count are one, so there are no more sums than pairs of labels.
    """
    names = F.broadcast(labels.select("task", "label").distinct().withColumn("_known", F.col("label")))
    rows = decisions.select("task", "id", "model", "gold", "pred")
    for side in ("gold", "pred"):
        rows = rows.join(names.withColumnRenamed("label", side), ["task", side], "left").drop(side).withColumnRenamed("_known", side)
    cells = replicate_counts(rows, iterations, seed, "task", "id", ["model", "gold", "pred"])
    right = F.coalesce(F.col("gold") == F.col("pred"), F.lit(False))
    side = lambda label, g, p, tp: F.struct(label.alias("label"), g.cast("int").alias("g"), p.cast("int").alias("p"), tp.cast("int").alias("tp"))
    rows = cells.select("task", "model", "b", "w", F.inline(F.array(side(F.col("gold"), F.lit(1), right, right), side(F.col("pred"), F.lit(0), ~right, F.lit(0)))))
    rows = rows.filter("g + p > 0 AND label IS NOT NULL")
    sums = rows.groupBy("task", "model", "b", "label").agg(F.sum(F.col("w") * F.col("tp")).alias("tp"), F.sum(F.col("w") * (F.col("g") + F.col("p"))).alias("gp"))
    return sums.filter("gp > 0").select("task", "model", "b", "label", (2 * F.col("tp") / F.col("gp")).alias("f1"))


def f1_replicates(decisions: DataFrame, label_def: DataFrame, iterations: int, seed: str = "boot") -> DataFrame:
    """Headline F1 of every replicate: ``task, model, b, f1``. Labels are those with support in the full data."""
    seen = decisions.select("task", F.col("gold").alias("label")).distinct()
    labels = label_def.select("task", "label").distinct().join(F.broadcast(seen), ["task", "label"], "left_semi")
    per_model = label_replicates(decisions, labels, iterations, seed).groupBy("task", "model", "b").agg(F.sum("f1").alias("_s"))
    n = labels.groupBy("task").agg(F.count("*").alias("_k"))
    return per_model.join(F.broadcast(n), "task").select("task", "model", "b", (F.col("_s") / F.col("_k")).alias("f1"))


def interval(value: Column, name: str = "") -> list[Column]:
    """Percentile interval of replicates, linear between order statistics."""
    p = F.percentile(value, F.array(*map(F.lit, LEVELS)))
    return [p[0].alias(f"{name}low"), p[1].alias(f"{name}high")]


def _unit_sums(rows: DataFrame, unit: str, iterations: int, by: list[str], values: dict[str, Column], seed: str, within: str | None = None) -> DataFrame:
    """Sums of ``values`` in every replicate of resampled units such as tasks, models or clusters: ``by, b`` and the sums.

    Units are placed by name, in each group ``within`` if given, and draws are shared by the groups ``by``.
    """
    group = F.lit("u") if within is None else F.col(within).cast("string")
    named = rows.withColumn("_group", group)
    places = placed(named.select("_group", unit).distinct(), [unit], by=["_group"], name="_pos")
    sizes = places.groupBy(F.col("_group").alias("task")).agg(F.count("*").alias("n"))
    return weighted_sums(named.join(places, ["_group", unit]), sizes, iterations, seed, "_group", "_pos", by, values)


def mean_replicates(rows: DataFrame, unit: str, value: str, iterations: int, by: list[str], seed: str = "mean", within: str | None = None) -> DataFrame:
    """Replicate means over resampled units: ``by, b, mean``. Units are placed by name; draws are shared by groups.

    With ``within``, the units of each such group are drawn by themselves. A replicate that draws none of a group's units has no row.
    """
    v = F.col(value).cast("double")
    sums = _unit_sums(rows, unit, iterations, by, {"_s": F.coalesce(v, F.lit(0.0)), "_w": v.isNotNull().cast("double")}, seed, within)
    return sums.filter("_w > 0").select(*by, "b", (F.col("_s") / F.col("_w")).alias("mean"))


def mean_interval(rows: DataFrame, unit: str, value: str, iterations: int, by: list[str], seed: str = "mean", within: str | None = None) -> DataFrame:
    """The plain mean and the interval of its replicates; also the share of replicates above 0."""
    reps = mean_replicates(rows, unit, value, iterations, by, seed, within)
    out = reps.groupBy(*by).agg(*interval(F.col("mean")), F.avg((F.col("mean") > 0).cast("double")).alias("share_positive"))
    return rows.groupBy(*by).agg(F.avg(value).alias("mean")).join(out, by)


def permuted(rows: DataFrame, key: str, value: str, draws: int, seed: str = "perm") -> DataFrame:
    """``draw, key, value`` with the values dealt anew: place i gets the value at place i of a hash order."""
    w = W.partitionBy("draw")
    base = rows.select(F.col(key).alias("_key"), F.col(value).alias("_value")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col("draw").cast("string"), F.col("_key").cast("string")), 256)
    keys = base.select("draw", F.col("_key").alias(key), F.row_number().over(w.orderBy("_key")).alias("_i"))
    values = base.select("draw", F.col("_value").alias(value), F.row_number().over(w.orderBy(order, "_key")).alias("_i"))
    return keys.join(values, ["draw", "_i"]).drop("_i")


def binomial_tail(k: Column, n: Column) -> Column:
    """P(X >= k) of n fair coins, as a sum of terms from logs of factorials."""
    log_choose = lambda i: F.aggregate(F.sequence(F.lit(1), F.greatest(i, F.lit(1))), F.lit(0.0), lambda a, j: a + F.when(i > 0, F.ln((n - i + j).cast("double")) - F.ln(j.cast("double"))).otherwise(0.0))
    terms = F.transform(F.sequence(k.cast("int"), n.cast("int")), lambda i: F.exp(log_choose(i) - n * F.ln(F.lit(2.0))))
    return F.when(k <= n, F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def moments(x: Column, y: Column) -> dict[str, Column]:
    """What sums of a slope and a correlation need, of rows with both values."""
    x, y = x.cast("double"), y.cast("double")
    known = x.isNotNull() & y.isNotNull()
    return {name: F.when(known, v).otherwise(0.0) for name, v in {"_n": F.lit(1.0), "_x": x, "_y": y, "_xy": x * y, "_xx": x * x, "_yy": y * y}.items()}


def slope_of(n: Column, x: Column, y: Column, xy: Column, xx: Column) -> Column:
    return F.try_divide(n * xy - x * y, n * xx - x * x)


def slope_interval(rows: DataFrame, unit: str, x: str, y: str, iterations: int, seed: str = "mean") -> DataFrame:
    """Least-squares slope and the interval of its replicates over resampled units; weighted moments give each one."""
    parts = moments(F.col(x), F.col(y))
    of = slope_of(*map(F.col, ("_n", "_x", "_y", "_xy", "_xx")))
    reps = _unit_sums(rows, unit, iterations, [], parts, seed).select(of.alias("s")).agg(*interval(F.col("s")))
    real = rows.agg(*(F.sum(v).alias(c) for c, v in parts.items())).select(of.alias("slope"))
    return real.crossJoin(F.broadcast(reps))


def slope_against(rows: DataFrame, unit: str, x: str, y: str, iterations: int, null: float = 0.0, seed: str = "mean") -> DataFrame:
    """How far a slope is from the one expected: ``slope, difference``, the interval of the replicates' differences, and ``p_value``.

    The p-value is twice the lesser share of replicates on either side of ``null``, one replicate added to each.
    """
    parts = moments(F.col(x), F.col(y))
    of = slope_of(*map(F.col, ("_n", "_x", "_y", "_xy", "_xx")))
    apart = (F.col("_slope") - null).alias("_d")
    reps = _unit_sums(rows, unit, iterations, [], parts, seed).select(of.alias("_slope")).filter("_slope IS NOT NULL").select(apart)
    side = F.least(F.count_if(F.col("_d") <= 0), F.count_if(F.col("_d") >= 0))
    spread = reps.agg(*interval(F.col("_d")), F.least(F.lit(1.0), 2 * (1 + side) / (F.count("*") + 1)).alias("p_value"))
    real = rows.agg(*(F.sum(v).alias(c) for c, v in parts.items())).select(of.alias("slope")).withColumn("difference", F.col("slope") - null)
    return real.crossJoin(F.broadcast(spread))  # one row each


def calibrated_interval(rows: DataFrame, unit: str, value: str, iterations: int, by: str, intercept: float, slope: float, residuals: DataFrame, seed: str = "mean") -> DataFrame:
    """Interval of a calibrated mean: replicate means go through the line and get a drawn residual (``pos, residual``)."""
    n = residuals.count()
    reps = mean_replicates(rows, unit, value, iterations, [by], seed)
    reps = reps.withColumn("pos", hash_draw(F.lit(n), F.lit("residual"), by, "b")).join(F.broadcast(residuals), "pos")
    out = reps.groupBy(by).agg(*interval(intercept + slope * F.col("mean") + F.col("residual")))
    return rows.groupBy(by).agg((intercept + slope * F.avg(value)).alias("calibrated")).join(out, by)


def permutation_eta(rows: DataFrame, key: str, group: str, value: str, draws: int, seed: str = "perm") -> DataFrame:
    """One-sided permutation test of eta squared: ``eta_squared, p_value``. ``key`` tells the rows apart.

    A permutation keeps all values, so their total sum of squares is that of the real table and only the sums of
    the groups are made anew.
    """
    total = rows.agg((F.sum(F.col(value) ** 2) - F.sum(value) ** 2 / F.count(value)).alias("_total"))

    def shares(df: DataFrame, by: list[str]) -> DataFrame:
        sums = df.groupBy(*by, group).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
        between = F.sum(F.col("_s") ** 2 / F.col("_n")) - F.sum("_s") ** 2 / F.sum("_n")
        return sums.groupBy(*by).agg(between.alias("_b")).crossJoin(F.broadcast(total)).select(*by, F.try_divide("_b", "_total").alias("eta"))

    real = shares(rows, []).withColumnRenamed("eta", "real")
    drawn = shares(permuted(rows, key, value, draws, seed).join(rows.select(key, group), key), ["draw"])
    over = F.count_if(F.round("eta", 9) >= F.round("real", 9))
    return drawn.crossJoin(F.broadcast(real)).agg(F.max("real").alias("eta_squared"), ((1 + over) / (F.count("*") + 1)).alias("p_value"))


def symmetric_replicates(decisions: DataFrame, label_def: DataFrame, iterations: int, seed: str = "boot") -> DataFrame:
    """Headline F1 over declared labels and symmetric F1 over all labels in gold, from the same draws: ``task, model, b, f1, symmetric``."""
    declared = label_def.select("task", "label").distinct().withColumn("_head", F.lit(1))
    labels = decisions.select("task", F.col("gold").alias("label")).distinct().join(F.broadcast(declared), ["task", "label"], "left").fillna(0, ["_head"])
    n = labels.groupBy("task").agg(F.count("*").alias("_all"), F.sum("_head").alias("_heads"))
    each = label_replicates(decisions, labels.select("task", "label"), iterations, seed).join(F.broadcast(labels), ["task", "label"])
    sums = each.groupBy("task", "model", "b").agg(F.sum("f1").alias("_s"), F.sum(F.col("f1") * F.col("_head")).alias("_h"))
    return sums.join(F.broadcast(n), "task").select("task", "model", "b", F.try_divide("_h", "_heads").alias("f1"), (F.col("_s") / F.col("_all")).alias("symmetric"))


def cluster_interval(rows: DataFrame, cluster: str, value: str, iterations: int, by: list[str], seed: str = "mean") -> DataFrame:
    """Interval of a mean when whole clusters are drawn with all their rows; a cluster's sums stand for its rows."""
    sums = rows.groupBy(*by, cluster).agg(F.sum(value).alias("_sum"), F.count(value).alias("_rows"))
    reps = _unit_sums(sums, cluster, iterations, by, {"_s": F.coalesce(F.col("_sum").cast("double"), F.lit(0.0)), "_n": F.col("_rows").cast("double")}, seed)
    reps = reps.select(*by, F.try_divide("_s", "_n").alias("_m"))
    return rows.groupBy(*by).agg(F.avg(value).alias("mean")).join(reps.groupBy(*by).agg(*interval(F.col("_m"))), by)


def mean_interval_within(rows: DataFrame, unit: str, value: str, group: str, iterations: int, seed: str = "mean") -> DataFrame:
    """Mean, interval and size of each group, whose own units are drawn."""
    reps = mean_replicates(rows, unit, value, iterations, [group], seed, within=group)
    out = reps.groupBy(group).agg(*interval(F.col("mean")))
    return rows.groupBy(group).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).join(out, group)


def pooled_slope(rows: DataFrame, unit: str, x: str, y: str, group: str, iterations: int, seed: str = "mean") -> DataFrame:
    """Standardised slope, averaged over groups that count alike, with the interval of its draws."""
    parts = moments(F.col(x), F.col(y))
    n, sx, sy, xy, xx, yy = map(F.col, parts)
    va, vb = n * xx - sx * sx, n * yy - sy * sy
    slope = F.when((va > 1e-9) & (vb > 1e-9), F.try_divide(n * xy - sx * sy, F.sqrt(va) * F.sqrt(vb))).alias("_slope")
    drawn = _unit_sums(rows, unit, iterations, [group], parts, seed, within=group)
    reps = drawn.select("b", slope).groupBy("b").agg(F.avg("_slope").alias("_slope"))
    real = rows.groupBy(group).agg(*(F.sum(v).alias(c) for c, v in parts.items())).select(slope)
    real = real.agg(F.avg("_slope").alias("slope"), F.count("*").alias("groups"))
    return real.crossJoin(F.broadcast(reps.agg(*interval(F.col("_slope")))))


def fixed_effect_interval(rows: DataFrame, cluster: str, x: str, y: str, iterations: int, seed: str = "mean") -> DataFrame:
    """Slope with one effect for each cluster, and its interval when clusters are drawn; a cluster drawn twice is two clusters.

    The slope is a ratio of sums of each cluster's centred moments, so a weight stands for copies with effects of their own.
    """
    a, b, n = F.col(x).cast("double"), F.col(y).cast("double"), F.count("*")
    own = rows.groupBy(cluster).agg((F.sum(a * b) - F.sum(a) * F.sum(b) / n).alias("_xy"), (F.sum(a * a) - F.sum(a) ** 2 / n).alias("_xx"))
    ratio = F.try_divide("_xy", "_xx")
    reps = _unit_sums(own, cluster, iterations, [], {c: F.coalesce(c, F.lit(0.0)) for c in ("_xy", "_xx")}, seed).select(ratio.alias("_r"))
    real = own.agg(F.sum("_xy").alias("_xy"), F.sum("_xx").alias("_xx"), F.count("*").alias("clusters")).select(ratio.alias("slope"), "clusters")
    return real.crossJoin(F.broadcast(reps.agg(*interval(F.col("_r")))))


def paired_replicates(reps: DataFrame, ordered: bool = True, by_task: bool = False) -> DataFrame:
    """Mean difference over tasks, or the one of each task, of each pair of models in each replicate: ``model, reference, b, d``.

    A replicate's models meet in one list of a task, as many as there are models, and not in a join of all replicates. With
    ``ordered`` both directions of a pair come out, else the one whose model is first by name.
    """
    lists = reps.groupBy("task", "b").agg(F.collect_list(F.struct("model", "f1")).alias("_m"))
    ways = lists.select("task", "b", F.explode("_m").alias("_l"), "_m").select("task", "b", "_l", F.explode("_m").alias("_r"))
    wanted = F.col("_l.model") != F.col("_r.model") if ordered else F.col("_l.model") < F.col("_r.model")
    rows = ways.filter(wanted).select("task", F.col("_l.model").alias("model"), F.col("_r.model").alias("reference"), "b", (F.col("_l.f1") - F.col("_r.f1")).alias("d"))
    return rows if by_task else rows.groupBy("model", "reference", "b").agg(F.avg("d").alias("d"))


def model_delta(scores: DataFrame, reps: DataFrame, model: str, reference: str, points: float = 100.0) -> DataFrame:
    """By task, how far a model is above another in points, with the interval of paired draws and the share of draws above 0.

    ``scores`` has task, model and f1, ``reps`` also b. Returns ``task, model_f1, reference_f1, delta, low, high, share_better``.
    """
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("f1")))
    gap = reps.groupBy("task", "b").agg((of(model) - of(reference)).alias("_d")).filter("_d IS NOT NULL")
    low, high = interval(points * F.col("_d"))
    spread = gap.groupBy("task").agg(low, high, F.avg((F.col("_d") > 0).cast("double")).alias("share_better"))
    plain = scores.groupBy("task").agg(of(model).alias("model_f1"), of(reference).alias("reference_f1"))
    return plain.withColumn("delta", points * (F.col("model_f1") - F.col("reference_f1"))).join(spread, "task")


def task_sensitivity(tasks: DataFrame, reps: DataFrame, model: str, reference: str, iterations: int) -> DataFrame:
    """How a mean difference of two models holds: one row with the interval over items, the share of draws above 0,
    the interval over tasks, and the range when each task is left out. ``tasks`` has task, model, f1; ``reps`` also b."""
    def gap(df: DataFrame, keys: list[str]) -> DataFrame:
        of = lambda m: F.max(F.when(F.col("model") == m, F.col("f1")))
        return df.filter(F.col("model").isin(model, reference)).groupBy(*keys).agg((of(model) - of(reference)).alias("d"))

    real = gap(tasks, ["task"])
    total = real.agg(F.sum("d").alias("_s"), F.count("*").alias("_n"))
    without = real.crossJoin(F.broadcast(total)).select(((F.col("_s") - F.col("d")) / (F.col("_n") - 1)).alias("_d"))
    items = gap(reps, ["task", "b"]).groupBy("b").agg(F.avg("d").alias("_m"))
    items = items.agg(*interval(F.col("_m"), "item_"), F.avg((F.col("_m") > 0).cast("double")).alias("share_positive"))
    over = mean_interval(real.withColumn("_one", F.lit(1)), "task", "d", iterations, ["_one"]).select(F.col("mean").alias("difference"), F.col("low").alias("task_low"), F.col("high").alias("task_high"))
    return over.crossJoin(F.broadcast(items)).crossJoin(F.broadcast(without.agg(F.min("_d").alias("without_low"), F.max("_d").alias("without_high"))))


def group_change(group: str, groups: tuple[str, str], condition: str, conditions: tuple[str, str], value: str) -> Column:
    """Mean of the first condition less that of the second, in the first group less in the second, as an aggregate."""
    cell = lambda g, c: F.avg(F.when((F.col(group) == g) & (F.col(condition) == c), F.col(value)))
    first, second = (cell(g, conditions[0]) - cell(g, conditions[1]) for g in groups)
    return first - second
