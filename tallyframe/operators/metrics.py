"""Agreement metrics of labelled decisions, as aggregates over label counts.

A decision has ``task, kind, model, label_field, item_id, gold, pred, gold_num, pred_num, parse_error``. Two rules
treat malformed answers: ``drop`` leaves them out, ``wrong`` counts them as misses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MISS = "__malformed__"
CELL = ["task", "kind", "model"]


def ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def safe_ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(ratio(a, b), F.lit(0.0))


def malformed(error: Column) -> Column:
    return F.trim(F.coalesce(error, F.lit(""))) != ""


def malformed_text(error: Column) -> Column:
    """As ``malformed``, where a text of ``nan`` or ``None`` also says that there is no error."""
    return ~F.trim(F.coalesce(error, F.lit(""))).isin("", "nan", "None")


def with_policy(decisions: DataFrame, on_malformed: str = "wrong", domain: DataFrame | None = None) -> DataFrame:
    """Apply a rule for malformed answers. Binary misses take the other label, categorical ones a label of their own.

    With ``domain`` (task, label_field, label), a label outside it counts as malformed too.
    """
    if on_malformed not in ("drop", "wrong"):
        raise ValueError(f"on_malformed must be drop or wrong, not {on_malformed}")
    bad = malformed(F.col("parse_error")) | F.col("pred").isNull()
    rows = decisions
    if domain is not None:
        known = domain.select("task", "label_field", F.col("label").alias("pred"), F.lit(True).alias("_known")).distinct()
        zero = domain.filter("label = '1'").select("task", "label_field", F.lit("0").alias("pred"), F.lit(True).alias("_known"))
        rows = rows.join(F.broadcast(known.unionByName(zero).distinct()), ["task", "label_field", "pred"], "left")
        bad = bad | (F.col("_known").isNull() & (F.col("kind") != "score"))
    if on_malformed == "drop":
        return rows.filter(~bad).drop("_known")
    miss = F.when(F.col("kind").isin("binary", "multi_binary"), F.when(F.col("gold") == "1", "0").otherwise("1")).when(F.col("kind") == "categorical", MISS)
    return rows.withColumn("pred", F.when(bad, miss).otherwise(F.col("pred"))).drop("_known")


def times(weight: str | None) -> Column:
    """How many decisions a row stands for: its ``weight``, or 1."""
    return F.lit(1).cast("long") if weight is None else F.col(weight)


def label_pairs(decisions: DataFrame, name: str = "n") -> DataFrame:
    """Decisions by cell, field, labels and error, and how many of each there are; a row of the result weighs as many decisions."""
    return decisions.filter("kind <> 'score'").groupBy(*CELL, "label_field", "gold", "pred", "parse_error").agg(F.count("*").alias(name))


def label_counts(decisions: DataFrame, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Per label: ``gold_n``, ``pred_n``, ``tp``. One pass: a row gives its gold label and, if other, its answer.

    With ``weight``, here and below, a row stands for that many equal decisions (``label_pairs``).
    """
    by = by or [*CELL, "label_field"]
    right = F.coalesce(F.col("gold") == F.col("pred"), F.lit(False))
    one = lambda label, g, p, tp: F.struct(label.alias("label"), g.cast("long").alias("g"), p.cast("long").alias("p"), tp.cast("long").alias("tp"))
    sides = F.array(one(F.col("gold"), F.lit(1), right, right), one(F.col("pred"), F.lit(0), ~right, F.lit(0)))
    rows = decisions.filter("kind <> 'score'").select(*by, times(weight).alias("_w"), F.inline(sides)).filter("label IS NOT NULL")
    return rows.groupBy(*by, "label").agg(*(F.sum(F.col(c) * F.col("_w")).alias(name) for c, name in (("g", "gold_n"), ("p", "pred_n"), ("tp", "tp"))))


def scored_labels(decisions: DataFrame, label_def: DataFrame, support_only: bool = True) -> DataFrame:
    """The labels that count for each task, fixed once over all models."""
    declared = label_def.select("task", "label_field", "label").distinct()
    if not support_only:
        return declared
    seen = decisions.filter("gold IS NOT NULL").select("task", "label_field", F.col("gold").alias("label")).distinct()
    return declared.join(seen, ["task", "label_field", "label"], "left_semi")


def per_class(decisions: DataFrame, label_def: DataFrame, support_only: bool = True, weight: str | None = None) -> DataFrame:
    """F1, precision and recall of each scored label in each cell; a label nobody answered has F1 0."""
    labels = F.broadcast(scored_labels(decisions, label_def, support_only))
    cells = decisions.filter("kind <> 'score'").select(*CELL, "label_field").distinct()
    grid = cells.join(labels, ["task", "label_field"])
    counts = label_counts(decisions, weight=weight).drop("kind")
    rows = grid.join(counts, ["task", "model", "label_field", "label"], "left").fillna(0, ["gold_n", "pred_n", "tp"])
    return rows.select(*CELL, "label_field", "label", "gold_n", "pred_n", "tp", safe_ratio(2 * F.col("tp"), F.col("gold_n") + F.col("pred_n")).alias("f1"), ratio(F.col("tp"), F.col("pred_n")).alias("precision"), ratio(F.col("tp"), F.col("gold_n")).alias("recall"))


def headline_f1(decisions: DataFrame, label_def: DataFrame, support_only: bool = True, pinned: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """Binary: F1 of the positive class; categorical: mean over scored labels; several binary fields: their mean."""
    rows = per_class(decisions, label_def, support_only, weight)
    if pinned is not None:
        rows = rows.join(F.broadcast(pinned), ["task", "label_field", "label"], "left_semi")
    return rows.groupBy(*CELL).agg(F.avg("f1").alias("headline_f1"))


def accuracy(decisions: DataFrame, weight: str | None = None) -> DataFrame:
    """Share of equal labels among rows that have both."""
    both, w = F.col("gold").isNotNull() & F.col("pred").isNotNull(), times(weight)
    right = F.sum(F.when(both, F.when(F.col("gold") == F.col("pred"), w).otherwise(0)))
    return decisions.filter("kind IN ('binary', 'categorical')").groupBy(*CELL).agg(ratio(right, F.sum(F.when(both, w))).alias("accuracy"))


def decision_accuracy(decisions: DataFrame) -> DataFrame:
    """Share of right answers among all label decisions, an item of several binary fields giving one for each."""
    right = F.coalesce(F.col("gold") == F.col("pred"), F.lit(False)).cast("double")
    return decisions.filter("kind <> 'score' AND gold IS NOT NULL").groupBy("task", "model").agg(F.avg(right).alias("accuracy"))


def mcc(decisions: DataFrame, undefined: float | None = 0.0, weight: str | None = None) -> DataFrame:
    """Matthews correlation of any number of classes, from label counts."""
    rows = decisions.filter("gold IS NOT NULL AND pred IS NOT NULL")
    c = label_counts(rows, weight=weight).groupBy(*CELL).agg(
        F.sum("tp").alias("c"), F.sum("gold_n").alias("s"), F.sum(F.col("gold_n") * F.col("pred_n")).alias("pt"), F.sum(F.col("gold_n") ** 2).alias("tt"), F.sum(F.col("pred_n") ** 2).alias("pp")
    )
    s2 = F.col("s").cast("double") ** 2
    value = F.try_divide(F.col("c").cast("double") * F.col("s") - F.col("pt"), F.sqrt((s2 - F.col("pp")) * (s2 - F.col("tt"))))
    return c.select(*CELL, F.coalesce(value, F.lit(undefined).cast("double")).alias("mcc"))


def class_mcc(decisions: DataFrame, label_def: DataFrame) -> DataFrame:
    """One label against the rest: Matthews correlation (null where undefined), precision, recall, support, calls."""
    n = decisions.filter("kind <> 'score'").groupBy(*CELL).agg(F.count("*").alias("n"))
    rows = per_class(decisions, label_def, support_only=False).join(n, CELL)
    tp, fp, fn = F.col("tp").cast("double"), (F.col("pred_n") - F.col("tp")).cast("double"), (F.col("gold_n") - F.col("tp")).cast("double")
    tn = F.col("n") - tp - fp - fn
    value = F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return rows.select(*CELL, "label", value.alias("mcc"), "precision", "recall", F.col("gold_n").alias("support"), F.col("pred_n").alias("calls"))


def pearson(x: Column, y: Column, least: int = 3) -> Column:
    """Pearson correlation as an aggregate; null below ``least`` pairs or where a side is constant."""
    on = x.isNotNull() & y.isNotNull()
    a, b = F.when(on, x.cast("double")), F.when(on, y.cast("double"))
    n = F.count(a)
    cov = n * F.sum(a * b) - F.sum(a) * F.sum(b)
    va, vb = n * F.sum(a * a) - F.sum(a) ** 2, n * F.sum(b * b) - F.sum(b) ** 2
    return F.when((n >= least) & (va > 1e-9) & (vb > 1e-9), F.try_divide(cov, F.sqrt(va) * F.sqrt(vb)))


def average_rank(value: Column | str, by: list[str]) -> Column:
    """Rank with the mean of ties."""
    c = F.col(value) if isinstance(value, str) else value
    return F.rank().over(W.partitionBy(*by).orderBy(c)) + (F.count("*").over(W.partitionBy(*by, c)) - 1) / 2


def spearman(rows: DataFrame, x: str, y: str, by: list[str], name: str = "spearman", weight: str | None = None) -> DataFrame:
    """Pearson correlation of average ranks within groups; pairs with a null are left out.

    Ranks come from counts of distinct pairs of values, so only those are sorted.
    """
    counts = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("_a"), F.col(y).alias("_b")).agg(F.sum(times(weight)).alias("_w"))

    def ranks(side: str, rank: str) -> DataFrame:
        """The mean rank of each distinct value: those before it, and half of its own."""
        n = counts.groupBy(*by, side).agg(F.sum("_w").alias("_n"))
        upto = F.sum("_n").over(W.partitionBy(*by).orderBy(side).rowsBetween(W.unboundedPreceding, 0))
        return n.select(*by, side, (upto - (F.col("_n") - 1) / 2).alias(rank))

    ranked = counts.join(ranks("_a", "_x"), [*by, "_a"]).join(ranks("_b", "_y"), [*by, "_b"])
    w, a, b = (F.col(c).cast("double") for c in ("_w", "_x", "_y"))
    n = F.sum(w)
    va, vb = n * F.sum(w * a * a) - F.sum(w * a) ** 2, n * F.sum(w * b * b) - F.sum(w * b) ** 2
    value = F.when((n >= 3) & (va > 1e-9) & (vb > 1e-9), F.try_divide(n * F.sum(w * a * b) - F.sum(w * a) * F.sum(w * b), F.sqrt(va) * F.sqrt(vb)))
    return ranked.groupBy(*by).agg(value.alias(name))


def score_metrics(decisions: DataFrame, lo: float, hi: float) -> DataFrame:
    """Numeric answers: correlations and errors; an answer of not-applicable stands at the middle of the range.

    ``_answered`` leaves those out. Other malformed answers are dropped.
    """
    rows = decisions.filter("kind = 'score'")
    middle = F.when(F.col("parse_error") == "not_applicable", (lo + hi) / 2).otherwise(F.col("pred_num"))
    rows = rows.withColumn("full", F.when(F.coalesce(F.col("parse_error"), F.lit("not_applicable")) == "not_applicable", middle))
    rows = rows.withColumn("answered", F.when(F.col("parse_error").isNull(), F.col("pred_num")))
    plain = rows.groupBy("task", "model").agg(
        pearson(F.col("gold_num"), F.col("full")).alias("pearson_r"),
        pearson(F.col("gold_num"), F.col("answered")).alias("pearson_r_answered"),
        F.avg(F.abs(F.col("full") - F.col("gold_num"))).alias("mae"),
        F.avg(F.abs(F.col("answered") - F.col("gold_num"))).alias("mae_answered"),
        F.avg((F.col("parse_error") == "not_applicable").cast("double")).alias("share_void"),
        F.count(F.col("full")).alias("n_scored"),
    )
    a, b = (spearman(rows, "gold_num", c, ["task", "model"], n) for c, n in (("full", "spearman_r"), ("answered", "spearman_r_answered")))
    return plain.join(a, ["task", "model"], "left").join(b, ["task", "model"], "left")


def ordinal_metrics(decisions: DataFrame, label_def: DataFrame, weight: str | None = None) -> DataFrame:
    """Ordered labels: quadratic weighted kappa from moments, rank correlation and the mean error in steps."""
    place = label_def.filter("ordinal").select("task", "label_field", "label", "pos")
    rows = decisions.join(F.broadcast(place.select("task", "label_field", F.col("label").alias("gold"), F.col("pos").alias("g"))), ["task", "label_field", "gold"])
    rows = rows.join(F.broadcast(place.select("task", "label_field", F.col("label").alias("pred"), F.col("pos").alias("p"))), ["task", "label_field", "pred"])
    w, g, p = times(weight), F.col("g").cast("double"), F.col("p").cast("double")
    n = F.sum(w)
    apart = n * (F.sum(w * g * g) + F.sum(w * p * p)) - 2 * F.sum(w * g) * F.sum(w * p)
    mean = lambda c: F.sum(w * c) / n
    plain = rows.groupBy("task", "model").agg(
        (1 - F.try_divide(n * F.sum(w * (g - p) ** 2), apart)).alias("weighted_kappa"), mean(F.abs(g - p)).alias("mae_steps"), mean((g == p).cast("double")).alias("accuracy"), n.alias("n")
    )
    return plain.join(spearman(rows, "g", "p", ["task", "model"], "spearman_r", weight), ["task", "model"], "left")


def binary_behaviour(decisions: DataFrame) -> DataFrame:
    """Positive rates, bias and both classes' scores; a malformed answer is a miss of its gold class."""
    bad = malformed(F.col("parse_error")) | F.col("pred").isNull()
    g, ok = F.col("gold") == "1", ~bad
    p = F.when(ok, F.col("pred") == "1")
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    c = decisions.filter("kind IN ('binary', 'multi_binary')").groupBy(*CELL, "label_field").agg(
        F.count("*").alias("n"), count(ok).alias("valid"), count(g).alias("pos"), count(g & p).alias("tp"), count(~g & ~p).alias("tn"), count(~g & p).alias("fp"), count(g & ~p).alias("fn"), count(ok & g).alias("vpos")
    )
    neg, rate = F.col("n") - F.col("pos"), ratio(F.col("tp") + F.col("fp"), F.col("valid"))
    recall, recall0 = safe_ratio(F.col("tp"), F.col("pos")), safe_ratio(F.col("tn"), neg)
    precision, precision0 = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tn"), F.col("tn") + F.col("fn"))
    f1, f0 = safe_ratio(2 * precision * recall, precision + recall), safe_ratio(2 * precision0 * recall0, precision0 + recall0)
    return c.select(
        *CELL, "label_field", "n", ratio(F.col("valid"), F.col("n")).alias("valid_rate"), ratio(F.col("pos"), F.col("n")).alias("gold_rate"), rate.alias("pred_rate"),
        (rate - ratio(F.col("vpos"), F.col("valid"))).alias("bias"), precision.alias("precision"), recall.alias("recall"), precision0.alias("negative_precision"), recall0.alias("negative_recall"),
        f1.alias("f1"), f0.alias("negative_f1"), ((f1 + f0) / 2).alias("symmetric_f1"), ratio(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
    )


def multi_binary_behaviour(decisions: DataFrame) -> DataFrame:
    """The behaviour of each binary field, averaged over the fields of a task; a field without a value doesn't count in that mean."""
    each = binary_behaviour(decisions.withColumn("kind", F.lit("binary")))
    values = [c for c, kind in each.dtypes if kind == "double"]
    return each.groupBy("task", "model").agg(F.count("*").alias("fields"), *(F.avg(c).alias(c) for c in values))


def effective_tuples(items: DataFrame, by: str = "task", key: str = "item_id", field: str = "label_field", label: str = "gold") -> DataFrame:
    """Effective number of label tuples, the fields of an item taken together: exp of the entropy, and how many tuples there are."""
    tuples = items.groupBy(by, key).agg(F.array_sort(F.collect_list(F.struct(field, label))).alias("_t")).withColumn("_t", F.to_json("_t"))
    return effective_labels(tuples, "_t", by)


def categorical_behaviour(decisions: DataFrame, label_def: DataFrame) -> DataFrame:
    """Accuracy, macro F1, the share of labels used, entropy of the answers over log(labels), recall of the rarest."""
    rows = with_policy(decisions.filter("kind = 'categorical'"), "wrong")
    classes = per_class(rows, label_def, support_only=False)
    share = F.col("pred_n") / F.sum("pred_n").over(W.partitionBy(*CELL))
    part = classes.withColumn("_h", F.when(share > 0, -share * F.ln(share)).otherwise(0.0))
    out = part.groupBy(*CELL).agg(F.avg("f1").alias("macro_f1"), F.avg((F.col("pred_n") > 0).cast("double")).alias("coverage"), (F.sum("_h") / F.ln(F.count("*"))).alias("entropy"))
    hits = rows.groupBy(*CELL).agg(F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("accuracy"), F.avg((F.col("pred") != MISS).cast("double")).alias("valid_rate"))
    return out.join(hits, CELL).join(rare_class_recall(decisions), CELL, "left")


def rare_class_recall(decisions: DataFrame) -> DataFrame:
    """Mean recall over all labels tied at the least observed support; malformed answers are misses."""
    counts = label_counts(with_policy(decisions.filter("kind = 'categorical'"), "wrong")).filter("gold_n > 0")
    rarest = counts.withColumn("_r", F.rank().over(W.partitionBy(*CELL).orderBy("gold_n"))).filter("_r = 1")
    return rarest.groupBy(*CELL).agg(F.avg(ratio(F.col("tp"), F.col("gold_n"))).alias("rare_recall"))


def class_support(decisions: DataFrame, label_def: DataFrame) -> DataFrame:
    """Gold counts of every declared label, zeros kept."""
    seen = decisions.filter("gold IS NOT NULL").select("task", "label_field", F.col("gold").alias("label"), "item_id").distinct().groupBy("task", "label_field", "label").agg(F.count("*").alias("support"))
    return label_def.select("task", "label_field", "label").join(seen, ["task", "label_field", "label"], "left").fillna(0, ["support"])


def effective_labels(items: DataFrame, label: str = "gold", by: str = "task") -> DataFrame:
    """exp(entropy) of the gold labels."""
    n = items.filter(F.col(label).isNotNull()).groupBy(by, label).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy(by))
    return n.withColumn("_p", p).groupBy(by).agg(F.exp(F.sum(-F.col("_p") * F.ln("_p"))).alias("effective_labels"), F.count("*").alias("n_labels"))


def chance_baselines(items: DataFrame) -> DataFrame:
    """What always answering the most frequent label scores (ties: the lowest), and what guessing by frequency does."""
    n = items.filter("gold IS NOT NULL AND kind <> 'score'").groupBy("task", "kind", "gold").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("task"))
    first = F.row_number().over(W.partitionBy("task").orderBy(F.desc("n"), "gold"))
    rows = n.withColumn("share", F.col("n") / total).withColumn("r", first).withColumn("labels", F.count("*").over(W.partitionBy("task")))
    top = F.max(F.when(F.col("r") == 1, F.col("share")))
    label = F.max(F.when(F.col("r") == 1, F.col("gold")))
    positive = F.max(F.when(F.col("gold") == "1", F.col("share")))
    f1_top = 2 * top / (1 + top)
    out = rows.groupBy("task", "kind").agg(label.alias("majority"), top.alias("accuracy"), f1_top.alias("_f"), F.max("labels").alias("_k"), F.coalesce(positive, F.lit(0.0)).alias("_p"), F.sum(F.col("share") ** 2).alias("stratified_accuracy"))
    binary = F.col("kind") == "binary"
    f1 = F.when(binary, F.when(F.col("majority") == "1", F.col("_f")).otherwise(0.0)).otherwise(F.col("_f") / F.col("_k"))
    return out.select("task", "majority", f1.alias("majority_f1"), "accuracy", F.when(binary, F.col("_p")).otherwise(1.0 / F.col("_k")).alias("stratified_f1"), "stratified_accuracy")
