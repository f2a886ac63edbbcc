"""Queries of the scoring metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as m
from .fixtures import HI, LO, SQL_DECISIONS, SQL_LABELS, SQL_MODELS, SQL_TASKS, decisions, items, label_def, models, tasks
from .registry import query, rounded

#: Decisions with malformed answers as misses, and label counts.
SQL_WRONG = """wrong AS (SELECT task, kind, model, id, gold, CASE WHEN pred IS NOT NULL THEN pred WHEN kind = 'binary' THEN CASE WHEN gold = '1' THEN '0' ELSE '1' END ELSE '__malformed__' END AS pred
    FROM dec WHERE kind <> 'score')"""
SQL_CLASS = """counts AS (SELECT w.task, w.kind, w.model, l.label, count(*) FILTER (gold = label) AS gold_n, count(*) FILTER (pred = label) AS pred_n, count(*) FILTER (gold = label AND pred = label) AS tp
    FROM {rows} w JOIN label_def l ON w.task = l.task GROUP BY ALL),
classes AS (SELECT *, CASE WHEN gold_n + pred_n = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (gold_n + pred_n) END AS f1 FROM counts)"""
BASE = f"WITH {SQL_DECISIONS}, {SQL_LABELS}, {SQL_WRONG}, {SQL_CLASS.format(rows='wrong')}"
BASE_DROP = f"WITH {SQL_DECISIONS}, {SQL_LABELS}, kept AS (SELECT * FROM dec WHERE pred IS NOT NULL AND kind <> 'score'), {SQL_CLASS.format(rows='kept')}"
HEAD = "headline AS (SELECT task, kind, model, avg(f1) AS headline_f1 FROM classes WHERE gold_n > 0 GROUP BY ALL)"


def wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.with_policy(decisions(spark, sf_dir), "wrong")


def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline F1 of each labelling task and model, malformed answers as misses."""
    return m.headline_f1(wrong(spark, sf_dir), label_def(spark))


@query(f"""{BASE}, {HEAD}, bad AS (SELECT model, avg((parse_error IS NOT NULL)::INT) AS malformed_rate, count(*) AS n FROM dec WHERE kind <> 'score' GROUP BY model)
    SELECT h.model, count(*) AS tasks, round(avg(headline_f1), 6) AS mean_f1, round(any_value(malformed_rate), 6) AS malformed_rate, any_value(n) AS n,
        rank() OVER (ORDER BY round(avg(headline_f1), 9) DESC) AS rank FROM headline h JOIN bad USING (model) GROUP BY h.model""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean headline F1 over tasks, with rows, malformed share and rank."""
    from pyspark.sql import Window as W

    dec = decisions(spark, sf_dir)
    scores = m.headline_f1(m.with_policy(dec, "wrong"), label_def(spark)).groupBy("model").agg(F.count("*").alias("tasks"), F.avg("headline_f1").alias("mean_f1"))
    sizes = dec.filter("kind <> 'score'").groupBy("model").agg(F.avg(m.malformed(F.col("parse_error")).cast("double")).alias("malformed_rate"), F.count("*").alias("n"))
    rows = scores.join(F.broadcast(sizes), "model")
    return rounded(rows.withColumn("rank", F.rank().over(W.orderBy(F.desc(F.round("mean_f1", 9)))).cast("long")))


@query(f"{BASE} SELECT task, kind, model, label, gold_n, pred_n, tp, round(f1, 6) AS f1, round(tp / nullif(pred_n, 0)::DOUBLE, 6) AS precision, round(tp / nullif(gold_n, 0)::DOUBLE, 6) AS recall FROM classes WHERE gold_n > 0")
def per_class_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.per_class(wrong(spark, sf_dir), label_def(spark)).drop("label_field"))


@query(f"{BASE} SELECT task, kind, model, round(avg(f1), 6) AS headline_f1 FROM classes GROUP BY ALL")
def headline_all_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.headline_f1(wrong(spark, sf_dir), label_def(spark), support_only=False))


@query(f"{BASE_DROP} SELECT task, kind, model, round(avg(f1), 6) AS headline_f1 FROM classes WHERE gold_n > 0 GROUP BY ALL")
def headline_drop_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.headline_f1(m.with_policy(decisions(spark, sf_dir), "drop"), label_def(spark)))


@query(f"{BASE} SELECT task, kind, model, round(avg(f1), 6) AS headline_f1 FROM classes WHERE label IN ('1', 'en', 'fr', '1-URGENT') AND gold_n > 0 GROUP BY ALL")
def headline_pinned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pinned = label_def(spark).filter("label IN ('1', 'en', 'fr', '1-URGENT')").select("task", "label_field", "label")
    return rounded(m.headline_f1(wrong(spark, sf_dir), label_def(spark), pinned=pinned))


@query(f"WITH {SQL_DECISIONS} SELECT task, kind, model, round(avg((gold = pred)::INT) FILTER (pred IS NOT NULL), 6) AS accuracy FROM dec WHERE kind <> 'score' GROUP BY ALL")
def accuracy_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.accuracy(decisions(spark, sf_dir)))


@query(f"""WITH {SQL_DECISIONS}, r AS (SELECT * FROM dec WHERE pred IS NOT NULL AND kind <> 'score'),
    g AS (SELECT task, kind, model, gold AS label, count(*) AS t, count(*) FILTER (gold = pred) AS c FROM r GROUP BY ALL),
    p AS (SELECT task, kind, model, pred AS label, count(*) AS p FROM r GROUP BY ALL),
    j AS (SELECT task, kind, model, coalesce(t, 0) AS t, coalesce(c, 0) AS c, coalesce(p, 0) AS p FROM g FULL JOIN p USING (task, kind, model, label)),
    s AS (SELECT task, kind, model, sum(c)::DOUBLE AS c, sum(t)::DOUBLE AS s, sum(p * t)::DOUBLE AS pt, sum(p * p)::DOUBLE AS pp, sum(t * t)::DOUBLE AS tt FROM j GROUP BY ALL)
    SELECT task, kind, model, round(CASE WHEN (s * s - pp) * (s * s - tt) = 0 THEN 0 ELSE (c * s - pt) / sqrt((s * s - pp) * (s * s - tt)) END, 6) AS mcc FROM s""")
def matthews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.mcc(decisions(spark, sf_dir)))


@query(f"""{BASE}, t AS (SELECT task, model, count(*)::DOUBLE AS n FROM wrong GROUP BY ALL),
    x AS (SELECT c.*, n, tp::DOUBLE AS a, (pred_n - tp)::DOUBLE AS fp, (gold_n - tp)::DOUBLE AS fn, n - gold_n - pred_n + tp AS tn FROM classes c JOIN t USING (task, model))
    SELECT task, kind, model, label, round((a * tn - fp * fn) / sqrt(nullif((a + fp) * (a + fn) * (tn + fp) * (tn + fn), 0)), 6) AS mcc,
        round(a / nullif(pred_n, 0), 6) AS precision, round(a / nullif(gold_n, 0), 6) AS recall, gold_n AS support, pred_n AS calls FROM x""")
def class_matthews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.class_mcc(wrong(spark, sf_dir), label_def(spark)))


_SCORE = f"""WITH {SQL_DECISIONS}, s AS (SELECT task, model, parse_error, gold::DOUBLE AS g, CASE WHEN parse_error = 'not_applicable' THEN {(LO + HI) / 2} ELSE pred::DOUBLE END AS f, pred::DOUBLE AS a FROM dec WHERE kind = 'score'),
    ra AS (SELECT task, model, rank() OVER (PARTITION BY task, model ORDER BY g) + (count(*) OVER (PARTITION BY task, model, g) - 1) / 2.0 AS x, rank() OVER (PARTITION BY task, model ORDER BY f) + (count(*) OVER (PARTITION BY task, model, f) - 1) / 2.0 AS y FROM s WHERE f IS NOT NULL),
    rb AS (SELECT task, model, rank() OVER (PARTITION BY task, model ORDER BY g) + (count(*) OVER (PARTITION BY task, model, g) - 1) / 2.0 AS x, rank() OVER (PARTITION BY task, model ORDER BY a) + (count(*) OVER (PARTITION BY task, model, a) - 1) / 2.0 AS y FROM s WHERE a IS NOT NULL)"""


@query(f"""{_SCORE} SELECT s.task, s.model, round(corr(g, f), 6) AS pearson_r, round(corr(g, a), 6) AS pearson_r_answered, round(avg(abs(f - g)), 6) AS mae, round(avg(abs(a - g)), 6) AS mae_answered,
        round(avg((coalesce(parse_error, '') = 'not_applicable')::INT) FILTER (parse_error IS NOT NULL), 6) AS share_void, count(f) AS n_scored, any_value(sa.v) AS spearman_r, any_value(sb.v) AS spearman_r_answered
    FROM s JOIN (SELECT task, model, round(corr(x, y), 6) AS v FROM ra GROUP BY ALL) sa USING (task, model) JOIN (SELECT task, model, round(corr(x, y), 6) AS v FROM rb GROUP BY ALL) sb USING (task, model) GROUP BY s.task, s.model""")
def score_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.score_metrics(decisions(spark, sf_dir), LO, HI))


@query(f"""WITH {SQL_DECISIONS}, o AS (SELECT task, model, left(gold, 1)::INT AS g, left(pred, 1)::INT AS p FROM dec WHERE task = 'priority' AND pred IS NOT NULL),
    r AS (SELECT task, model, rank() OVER (PARTITION BY task, model ORDER BY g) + (count(*) OVER (PARTITION BY task, model, g) - 1) / 2.0 AS x, rank() OVER (PARTITION BY task, model ORDER BY p) + (count(*) OVER (PARTITION BY task, model, p) - 1) / 2.0 AS y FROM o),
    e AS (SELECT a.task, a.model, sum((a.g - b.p) ** 2 * a.n * b.n) AS expected FROM (SELECT task, model, g, count(*) AS n FROM o GROUP BY ALL) a JOIN (SELECT task, model, p, count(*) AS n FROM o GROUP BY ALL) b USING (task, model) GROUP BY ALL)
    SELECT o.task, o.model, round(1 - count(*) * sum((g - p) ** 2) / any_value(expected), 6) AS weighted_kappa, round(avg(abs(g - p)), 6) AS mae_steps, round(avg((g = p)::INT), 6) AS accuracy, count(*) AS n, any_value(s.v) AS spearman_r
    FROM o JOIN e USING (task, model) JOIN (SELECT task, model, round(corr(x, y), 6) AS v FROM r GROUP BY ALL) s USING (task, model) GROUP BY o.task, o.model""")
def ordinal_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.ordinal_metrics(decisions(spark, sf_dir), label_def(spark)))


@query(f"""WITH {SQL_DECISIONS}, c AS (SELECT task, kind, model, count(*) AS n, count(pred)::DOUBLE AS valid, count(*) FILTER (gold = '1')::DOUBLE AS pos, count(*) FILTER (gold = '1' AND pred = '1')::DOUBLE AS tp,
        count(*) FILTER (gold = '0' AND pred = '0')::DOUBLE AS tn, count(*) FILTER (gold = '0' AND pred = '1')::DOUBLE AS fp, count(*) FILTER (gold = '1' AND pred = '0')::DOUBLE AS fn, count(*) FILTER (gold = '1' AND pred IS NOT NULL)::DOUBLE AS vpos FROM dec WHERE kind = 'binary' GROUP BY ALL),
    d AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(pos, 0), 0) AS recall, coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(n - pos, 0), 0) AS r0 FROM c),
    e AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0 FROM d)
    SELECT task, kind, model, task AS label_field, n, round(valid / n, 6) AS valid_rate, round(pos / n, 6) AS gold_rate, round((tp + fp) / valid, 6) AS pred_rate, round((tp + fp) / valid - vpos / valid, 6) AS bias, round(precision, 6) AS precision, round(recall, 6) AS recall,
        round(p0, 6) AS negative_precision, round(r0, 6) AS negative_recall, round(f1, 6) AS f1, round(f0, 6) AS negative_f1, round((f1 + f0) / 2, 6) AS symmetric_f1, round((tp + tn) / n, 6) AS accuracy FROM e""")
def binary_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.binary_behaviour(decisions(spark, sf_dir)))


_RARE = """rare AS (SELECT task, kind, model, round(avg(tp / gold_n::DOUBLE), 6) AS rare_recall FROM (SELECT *, rank() OVER (PARTITION BY task, model ORDER BY gold_n) AS r FROM classes WHERE gold_n > 0 AND kind = 'categorical') WHERE r = 1 GROUP BY ALL)"""


@query(f"""{BASE}, {_RARE}, h AS (SELECT *, pred_n / sum(pred_n) OVER (PARTITION BY task, model) AS s FROM classes WHERE kind = 'categorical'),
    a AS (SELECT task, model, round(avg((gold = pred)::INT), 6) AS accuracy, round(avg((pred <> '__malformed__')::INT), 6) AS valid_rate FROM wrong GROUP BY ALL)
    SELECT h.task, h.kind, h.model, round(avg(f1), 6) AS macro_f1, round(avg((pred_n > 0)::INT), 6) AS coverage, round(sum(CASE WHEN s > 0 THEN -s * ln(s) ELSE 0 END) / ln(count(*)), 6) AS entropy,
        any_value(accuracy) AS accuracy, any_value(valid_rate) AS valid_rate, any_value(rare_recall) AS rare_recall FROM h JOIN a USING (task, model) JOIN rare USING (task, model) GROUP BY h.task, h.kind, h.model""")
def categorical_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.categorical_behaviour(decisions(spark, sf_dir), label_def(spark)))


@query(f"{BASE}, {_RARE} SELECT * FROM rare")
def rare_class_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.rare_class_recall(decisions(spark, sf_dir)))


@query(f"WITH {SQL_DECISIONS}, {SQL_LABELS} SELECT l.task, l.label_field, l.label, count(i.id) AS support FROM label_def l LEFT JOIN items i ON i.task = l.task AND i.gold = l.label GROUP BY ALL")
def class_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("task", F.col("task").alias("label_field"), "gold", F.col("id").alias("item_id"))
    return m.class_support(rows, label_def(spark))


@query(f"WITH {SQL_DECISIONS}, n AS (SELECT task, gold, count(*) AS n FROM items GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY task) AS p FROM n) SELECT task, round(exp(sum(-p * ln(p))), 6) AS effective_labels, count(*) AS n_labels FROM p GROUP BY task")
def effective_label_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.effective_labels(items(spark, sf_dir)))


@query(f"""WITH {SQL_DECISIONS}, n AS (SELECT task, kind, gold, count(*) AS n FROM items WHERE kind <> 'score' GROUP BY ALL),
    s AS (SELECT *, n / sum(n) OVER (PARTITION BY task) AS share, row_number() OVER (PARTITION BY task ORDER BY n DESC, gold) AS r, count(*) OVER (PARTITION BY task) AS k FROM n),
    b AS (SELECT task, kind, max(gold) FILTER (r = 1) AS majority, max(share) FILTER (r = 1) AS accuracy, coalesce(max(share) FILTER (gold = '1'), 0) AS p, max(k) AS k, sum(share * share) AS strat FROM s GROUP BY ALL)
    SELECT task, majority, round(CASE WHEN kind = 'binary' THEN CASE WHEN majority = '1' THEN 2 * accuracy / (1 + accuracy) ELSE 0 END ELSE 2 * accuracy / (1 + accuracy) / k END, 6) AS majority_f1, round(accuracy, 6) AS accuracy,
        round(CASE WHEN kind = 'binary' THEN p ELSE 1 / k END, 6) AS stratified_f1, round(strat, 6) AS stratified_accuracy FROM b""")
def chance_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.chance_baselines(items(spark, sf_dir)))


@query(f"""{BASE}, {HEAD}, {SQL_MODELS}, {SQL_TASKS},
    c AS (SELECT category, model, avg(headline_f1) AS f1, count(*) AS tasks FROM headline JOIN tasks USING (task) GROUP BY ALL)
    SELECT category, model, family, round(f1, 6) AS mean_f1, tasks FROM c JOIN models USING (model)""")
def category_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = headline(spark, sf_dir).join(F.broadcast(tasks(spark).select("task", "category")), "task").join(F.broadcast(models(spark).select("model", "family")), "model")
    return rounded(rows.groupBy("category", "model", "family").agg(F.avg("headline_f1").alias("mean_f1"), F.count("*").alias("tasks")))


@query(f"""WITH {SQL_DECISIONS} SELECT task, model, count(*) AS n, count(*) FILTER (parse_error IS NULL) AS parse_ok, round(avg((parse_error IS NOT NULL)::INT), 6) AS parse_err_rate,
    round(avg((coalesce(parse_error, '') = 'not_applicable')::INT), 6) AS not_applicable_rate, avg((parse_error IS NOT NULL)::INT) <= 0.05 AS passes_gate FROM dec GROUP BY ALL""")
def parse_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = m.malformed(F.col("parse_error")).cast("double")
    rows = decisions(spark, sf_dir).groupBy("task", "model").agg(
        F.count("*").alias("n"), F.count_if(F.col("parse_error").isNull()).alias("parse_ok"), F.avg(bad).alias("parse_err_rate"), F.avg((F.coalesce("parse_error", F.lit("")) == "not_applicable").cast("double")).alias("not_applicable_rate"), (F.avg(bad) <= 0.05).alias("passes_gate")
    )
    return rounded(rows)


@query(f"""WITH {SQL_DECISIONS}, b AS (SELECT id, k, model, max(gold) FILTER (task = 'quality') AS q, max(pred) FILTER (task = 'quality') AS pq, max(gold) FILTER (task = 'toxic') AS t, max(pred) FILTER (task = 'toxic') AS pt FROM dec WHERE task IN ('quality', 'toxic') GROUP BY ALL),
    f AS (SELECT model, unnest(['quality', 'toxic']) AS label_field, unnest([q, t]) AS g, unnest([coalesce(pq, CASE WHEN q = '1' THEN '0' ELSE '1' END), coalesce(pt, CASE WHEN t = '1' THEN '0' ELSE '1' END)]) AS p FROM b),
    s AS (SELECT model, label_field, 2.0::DOUBLE * count(*) FILTER (g = '1' AND p = '1') / nullif(count(*) FILTER (g = '1') + count(*) FILTER (p = '1'), 0) AS f1 FROM f GROUP BY ALL),
    e AS (SELECT model, avg((q = coalesce(pq, '') AND t = coalesce(pt, ''))::INT) AS exact_rate FROM b GROUP BY ALL)
    SELECT model, round(avg(coalesce(f1, 0)), 6) AS headline_f1, round(any_value(exact_rate), 6) AS exact_rate FROM s JOIN e USING (model) GROUP BY model""")
def multi_binary_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two binary fields of one item: mean positive-class F1, and the share of rows with every field right."""
    rows = decisions(spark, sf_dir).filter("task IN ('quality', 'toxic')").withColumns({"task": F.lit("both"), "kind": F.lit("multi_binary")})
    labels = label_def(spark).filter("kind = 'binary'").withColumns({"task": F.lit("both"), "kind": F.lit("multi_binary")})
    scores = m.headline_f1(m.with_policy(rows, "wrong"), labels)
    right = rows.groupBy("model", "item_id").agg(F.min((F.coalesce("pred", F.lit("")) == F.col("gold")).cast("double")).alias("right"))
    return rounded(scores.select("model", "headline_f1").join(right.groupBy("model").agg(F.avg("right").alias("exact_rate")), "model"))
