"""Queries of ranks, frontiers, pairs and resampled intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators import ranking as k
from ..operators import resample as b
from .fixtures import SQL_MODELS, SQL_TASKS, decisions, label_def, models, tasks
from .registry import query, rounded
from .scoring import BASE, HEAD, headline, wrong

#: Headline F1 by task and model, rounded so that ranks and ties are the same in any engine.
SCORES = f"{BASE}, {HEAD}, scores AS (SELECT task, model, round(headline_f1, 9) AS f1 FROM headline)"
META = f"{SCORES}, {SQL_MODELS}, {SQL_TASKS}"
#: Replicates of a summary; a permutation test takes as many permutations.
DRAWS = 1000


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headline(spark, sf_dir).select("task", "model", F.round("headline_f1", 9).alias("f1"))


def with_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score, malformed share and date of each model."""
    dec = decisions(spark, sf_dir).filter("kind <> 'score'")
    rate = dec.groupBy("model").agg(F.avg(m.malformed(F.col("parse_error")).cast("double")).alias("malformed_rate"))
    means = scores(spark, sf_dir).groupBy("model").agg(F.round(F.avg("f1"), 9).alias("f1"))
    return means.join(F.broadcast(models(spark).drop("k")), "model").join(F.broadcast(rate), "model")


_MEANS = """means AS (SELECT model, round(avg(f1), 9) AS f1 FROM scores GROUP BY model),
    rates AS (SELECT model, avg((parse_error IS NOT NULL)::INT) AS malformed_rate FROM dec WHERE kind <> 'score' GROUP BY model),
    m AS (SELECT * EXCLUDE (k) FROM means JOIN models USING (model) JOIN rates USING (model))"""


@query(f"{SCORES} SELECT model, round(avg(f1), 6) AS mean, count(DISTINCT task) AS tasks, rank() OVER (ORDER BY round(avg(f1), 9) DESC)::INT AS rank FROM scores GROUP BY model")
def model_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(k.model_means(scores(spark, sf_dir), tasks=4))


@query(f"""{SCORES}, l AS (SELECT model, task, round((sum(f1) OVER (PARTITION BY model) - f1) / (count(*) OVER (PARTITION BY model) - 1), 9) AS rest FROM scores),
    r AS (SELECT model, rank() OVER (PARTITION BY task ORDER BY rest DESC)::INT AS r FROM l) SELECT model, min(r) AS best_rank, max(r) AS worst_rank FROM r GROUP BY model""")
def leave_one_out_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.leave_one_out_ranks(scores(spark, sf_dir))


@query(f"""{SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1, task) AS l, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, task DESC) AS h FROM scores)
    SELECT model, round(avg(f1), 6) AS trimmed_mean FROM r WHERE l > 1 AND h > 1 GROUP BY model""")
def trimmed_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(k.trimmed_means(scores(spark, sf_dir)))


@query(f"{SCORES} SELECT task, model, round(f1, 6) AS f1, round(f1 - avg(f1) OVER (PARTITION BY task), 6) AS demeaned FROM scores")
def demeaned_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(k.demeaned(scores(spark, sf_dir)))


@query(f"""{SCORES}, w AS (SELECT task, 1 / avg(((0.1 + f1 / 10) / 3.92) ** 2) AS w FROM scores GROUP BY task) SELECT model, round(sum(f1 * w) / sum(w), 6) AS weighted_mean FROM scores JOIN w USING (task) GROUP BY model""")
def reliability_weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    widths = rows.select("task", F.lit(0.0).alias("low"), (0.1 + F.col("f1") / 10).alias("high"))
    return rounded(k.weighted_means(rows, widths))


@query(f"{META} SELECT model, round(avg(c), 6) AS equal_group_mean FROM (SELECT model, category, avg(f1) AS c FROM scores JOIN tasks USING (task) GROUP BY ALL) GROUP BY model")
def equal_category_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(k.two_level_mean(scores(spark, sf_dir).join(F.broadcast(tasks(spark)), "task"), "category", "f1", ["model"]))


@query(f"""{SCORES}, d AS (SELECT a.model, b.model AS reference, round(a.f1 - b.f1, 12) AS d FROM scores a JOIN scores b USING (task) WHERE a.model <> b.model)
    SELECT model, reference, round(avg(d), 6) AS difference, count(*) FILTER (d > 0) AS better, count(*) FILTER (d = 0) AS tied, count(*) FILTER (d < 0) AS worse FROM d GROUP BY ALL""")
def model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(k.ordered_pairs(scores(spark, sf_dir)))


@query(f"""{META}, {_MEANS} SELECT model, round(f1, 6) AS f1, cost_per_call_usd, round(malformed_rate, 6) AS malformed_rate FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.model <> a.model AND b.f1 >= a.f1 AND b.cost_per_call_usd <= a.cost_per_call_usd AND b.malformed_rate <= a.malformed_rate
    AND (b.f1 > a.f1 OR b.cost_per_call_usd < a.cost_per_call_usd OR b.malformed_rate < a.malformed_rate))""")
def pareto_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_models(spark, sf_dir).select("model", "f1", "cost_per_call_usd", "malformed_rate")
    return rounded(k.pareto_front(rows, ["f1"], ["cost_per_call_usd", "malformed_rate"]))


_FRONT = """p AS (SELECT *, malformed_rate <= 0.05 AS ok, max(f1) FILTER (malformed_rate <= 0.05) OVER (PARTITION BY compute_class ORDER BY release_date, model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m)"""


@query(f"""{META}, {_MEANS}, {_FRONT} SELECT model, compute_class, round(f1, 6) AS f1, round(before, 6) AS frontier_before, ok AND (before IS NULL OR f1 > before) AS promoted,
    CASE WHEN NOT ok THEN 'unreliable' WHEN before IS NULL THEN 'first' WHEN f1 > before THEN 'above' ELSE 'not above' END AS reason, round(greatest(before, CASE WHEN ok THEN f1 END), 6) AS frontier FROM p""")
def frontier_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = k.promotion(with_models(spark, sf_dir), "compute_class", "release_date", "f1")
    return rounded(rows.select("model", "compute_class", "f1", "frontier_before", "promoted", "reason", "frontier"))


@query(f"""{META}, {_MEANS}, r AS (SELECT model, compute_class, release_date, max(f1) OVER (PARTITION BY compute_class ORDER BY release_date, model) AS top FROM m)
    SELECT model, compute_class, round(top, 6) AS running_max, round(top - coalesce(lag(top) OVER (PARTITION BY compute_class ORDER BY release_date, model), 0), 6) AS step FROM r""")
def class_staircase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(k.staircase(with_models(spark, sf_dir), "compute_class", "release_date", "f1").select("model", "compute_class", "running_max", "step"))


@query(f"""{META}, {_MEANS}, h AS (SELECT o.model, o.release_date, arg_min(a.model, (a.release_date, a.model)) AS leader, min(a.release_date) AS d FROM m o LEFT JOIN m a ON a.compute_class = 'api' AND a.release_date <= o.release_date AND a.f1 >= o.f1 WHERE o.compute_class = 'local' GROUP BY ALL)
    SELECT model, leader, round((release_date - d) / 30.4375::DOUBLE, 6) AS lag_months FROM h""")
def open_model_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_models(spark, sf_dir)
    return rounded(k.lag_behind(rows, F.col("compute_class") == "local", F.col("compute_class") == "api", "release_date", "f1"))


@query(f"""{META}, {_MEANS}, d AS (SELECT DISTINCT release_date + 45 AS date FROM models), g AS (SELECT DISTINCT compute_class FROM m)
    SELECT compute_class, date::VARCHAR AS date, round(max(f1), 6) AS best FROM d CROSS JOIN g LEFT JOIN m ON m.compute_class = g.compute_class AND m.release_date <= date GROUP BY g.compute_class, date""".replace("SELECT compute_class, date::", "SELECT g.compute_class, date::"))
def best_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = models(spark).select(F.date_add("release_date", 45).alias("date"))
    return rounded(k.best_by_date(with_models(spark, sf_dir), dates, "compute_class", "release_date", "f1").withColumn("date", F.col("date").cast("string")))


@query(f"{SCORES} SELECT task, model, round(f1, 6) AS f1 FROM scores a WHERE f1 = (SELECT max(f1) FROM scores b WHERE a.task = b.task)")
def task_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(k.task_winners(scores(spark, sf_dir)))


@query(f"""{SCORES}, w AS (SELECT f1, avg(f1) OVER (PARTITION BY task) AS t, avg(f1) OVER (PARTITION BY model) AS m, avg(f1) OVER () AS a FROM scores)
    SELECT round(sum((f1 - t - m + a) ** 2) / sum((f1 - a) ** 2), 6) AS interaction, round(sum((t - a) ** 2) / sum((f1 - a) ** 2), 6) AS task, round(sum((m - a) ** 2) / sum((f1 - a) ** 2), 6) AS model FROM w""")
def variance_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(k.interaction_share(scores(spark, sf_dir)))


@query(f"{SCORES}, w AS (SELECT f1, avg(f1) OVER (PARTITION BY task) AS t, avg(f1) OVER () AS a FROM scores) SELECT round(sum((t - a) ** 2) / sum((f1 - a) ** 2), 6) AS eta_squared FROM w")
def eta_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(k.eta_squared(scores(spark, sf_dir), "task", "f1"))


@query(f"""{META}, {_MEANS} SELECT family, arg_min(model, (release_date, model)) AS first_model, arg_max(model, (release_date, model)) AS last_model, round(arg_max(f1, (release_date, model)) - arg_min(f1, (release_date, model)), 6) AS change FROM m GROUP BY family""")
def lineage_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(k.lineage_change(with_models(spark, sf_dir), "family", "release_date", "f1"))


@query(f"""{META} SELECT task, round(max(f1) FILTER (compute_class = 'local'), 6) AS best_local, round(max(f1) FILTER (compute_class = 'api'), 6) AS best_api, round(avg(f1) FILTER (compute_class = 'local'), 6) AS mean_local,
    round(avg(f1) FILTER (compute_class = 'api'), 6) AS mean_api, round(max(f1), 6) AS oracle, arg_max(model, (f1, model)) AS winner FROM scores JOIN models USING (model) GROUP BY task""")
def model_selection_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(k.selection_value(scores(spark, sf_dir), models(spark).select("model", "compute_class")))


@query(f"""WITH x AS (SELECT doc_id, ln(1 + n_chars) AS a, ln(1 + length(text) - length(replace(text, ' ', ''))) AS b FROM documents)
    SELECT doc_id, round(((a - avg(a) OVER ()) / stddev_pop(a) OVER () + (b - avg(b) OVER ()) / stddev_pop(b) OVER ()) / 2, 6) AS proxy FROM x""")
def complexity_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fixtures import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("spaces"))
    return rounded(k.standardised_mean(docs, ["n_chars", "spaces"]).select("doc_id", "proxy"))


#: Draws of replicates for every labelling task, counted by pattern of answers, and their F1.
SQL_DRAW = """hashed AS (SELECT {keys}, n, b, c, sha256('{seed}|' || {task} || '|' || b || '|' || c) AS h FROM (SELECT *, unnest(range((n + 7) // 8)) AS c FROM {sizes}, range(1, {last}) r(b))),
    slot AS (SELECT {keys}, b, ('0x' || substr(h, 8 * i::INT + 1, 8))::BIGINT % n AS pos FROM hashed, range(8) r(i) WHERE c * 8 + i < n)"""
SQL_BOOT = f"""{BASE}, s AS (SELECT task, id, list((model, gold, pred) ORDER BY model)::VARCHAR AS pattern FROM wrong GROUP BY task, id),
    place AS (SELECT task, pattern, row_number() OVER (PARTITION BY task ORDER BY id) - 1 AS pos FROM s),
    size AS (SELECT task, count(*) AS n FROM s GROUP BY task),
    {SQL_DRAW.format(keys="task", seed="boot", task="task", sizes="size", last=DRAWS + 1)},
    w AS (SELECT task, b, pattern, count(*) AS w FROM slot JOIN place USING (task, pos) GROUP BY ALL),
    known AS (SELECT DISTINCT s.task, s.pattern, model, gold, pred FROM wrong JOIN s USING (task, id)),
    lab AS (SELECT DISTINCT l.task, l.label FROM label_def l JOIN items i ON i.task = l.task AND i.gold = l.label),
    lb AS (SELECT k.task, k.model, b, l.label, 2 * sum(w) FILTER (gold = label AND pred = label) AS tp2, sum(w) FILTER (gold = label) AS g, sum(w) FILTER (pred = label) AS p FROM known k JOIN w USING (task, pattern) JOIN lab l ON l.task = k.task GROUP BY ALL),
    reps AS (SELECT task, model, b, avg(coalesce(coalesce(tp2, 0)::DOUBLE / nullif(coalesce(g, 0) + coalesce(p, 0), 0), 0)) AS f1 FROM lb GROUP BY ALL)"""


def replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.f1_replicates(wrong(spark, sf_dir).filter("kind <> 'score'"), label_def(spark), DRAWS)


@query(f"{SQL_BOOT} SELECT task, model, round(quantile_cont(f1, 0.025), 6) AS low, round(quantile_cont(f1, 0.975), 6) AS high, round(avg(f1), 6) AS mean FROM reps GROUP BY ALL")
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item bootstrap of headline F1, draws shared by the models of a task."""
    return rounded(replicates(spark, sf_dir).groupBy("task", "model").agg(*b.interval(F.col("f1")), F.avg("f1").alias("mean")))


@query(f"""{SQL_BOOT}, d AS (SELECT a.model, c.model AS reference, b, avg(a.f1 - c.f1) AS d FROM reps a JOIN reps c USING (task, b) WHERE a.model < c.model GROUP BY ALL)
    SELECT model, reference, round(avg(d), 6) AS difference, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM d GROUP BY ALL""")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of every pair's mean difference over tasks, from the same draws."""
    d = b.paired_replicates(replicates(spark, sf_dir), ordered=False)
    return rounded(d.groupBy("model", "reference").agg(F.avg("d").alias("difference"), *b.interval(F.col("d"))))


_UNIT = """u AS (SELECT {{unit}} AS unit, row_number() OVER (ORDER BY {{unit}}) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT {{unit}} FROM {{rows}})),
    sl AS (SELECT 'u' AS task, any_value(n) AS n FROM u), {draw}, dr AS (SELECT b, pos, count(*) AS w FROM slot GROUP BY ALL)""".format(
    draw=SQL_DRAW.format(keys="task", seed="mean", task="task", sizes="sl", last=DRAWS + 1)
)


@query(f"""{SCORES}, {_UNIT.format(unit="task", rows="scores")}, reps AS (SELECT model, b, sum(w * f1) / sum(w) AS mean FROM scores JOIN u ON task = unit JOIN dr USING (pos) GROUP BY ALL)
    SELECT s.model, round(s.mean, 6) AS mean, round(quantile_cont(r.mean, 0.025), 6) AS low, round(quantile_cont(r.mean, 0.975), 6) AS high, round(avg((r.mean > 0)::INT), 6) AS share_positive
    FROM (SELECT model, avg(f1) AS mean FROM scores GROUP BY model) s JOIN reps r USING (model) GROUP BY s.model, s.mean""")
def task_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of model means when tasks are resampled."""
    return rounded(b.mean_interval(scores(spark, sf_dir), "task", "f1", DRAWS, ["model"]))


@query(f"""{SCORES}, x AS (SELECT task, a.model, a.f1 - c.f1 AS d FROM scores a JOIN scores c USING (task) WHERE c.model = 'm1' AND a.model <> 'm1'), {_UNIT.format(unit="task", rows="x")},
    reps AS (SELECT model, b, sum(w * d) / sum(w) AS mean FROM x JOIN u ON task = unit JOIN dr USING (pos) GROUP BY ALL)
    SELECT s.model, round(s.mean, 6) AS mean, round(quantile_cont(r.mean, 0.025), 6) AS low, round(quantile_cont(r.mean, 0.975), 6) AS high, round(avg((r.mean > 0)::INT), 6) AS share_positive
    FROM (SELECT model, avg(d) AS mean FROM x GROUP BY model) s JOIN reps r USING (model) GROUP BY s.model, s.mean""")
def contrasts_to_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task bootstrap of each model's difference to the first model."""
    rows = scores(spark, sf_dir)
    base = rows.filter("model = 'm1'").select("task", F.col("f1").alias("_b"))
    d = rows.filter("model <> 'm1'").join(F.broadcast(base), "task").withColumn("d", F.col("f1") - F.col("_b"))
    return rounded(b.mean_interval(d, "task", "d", DRAWS, ["model"]))


@query(f"""{META}, c AS (SELECT model, category, avg(f1) AS f1 FROM scores JOIN tasks USING (task) GROUP BY ALL), {_UNIT.format(unit="category", rows="c")},
    reps AS (SELECT model, b, sum(w * f1) / sum(w) AS mean FROM c JOIN u ON category = unit JOIN dr USING (pos) GROUP BY ALL)
    SELECT s.model, round(s.mean, 6) AS mean, round(quantile_cont(r.mean, 0.025), 6) AS low, round(quantile_cont(r.mean, 0.975), 6) AS high, round(avg((r.mean > 0)::INT), 6) AS share_positive
    FROM (SELECT model, avg(f1) AS mean FROM c GROUP BY model) s JOIN reps r USING (model) GROUP BY s.model, s.mean""")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole categories are resampled; each counts by its own mean."""
    rows = scores(spark, sf_dir).join(F.broadcast(tasks(spark)), "task").groupBy("model", "category").agg(F.avg("f1").alias("f1"))
    return rounded(b.mean_interval(rows, "category", "f1", DRAWS, ["model"]))


def paired_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy tiers from paired task intervals."""
    rows = scores(spark, sf_dir)
    other = rows.select("task", F.col("model").alias("reference"), F.col("f1").alias("_b"))
    d = rows.join(other, "task").filter("model <> reference").withColumn("d", F.col("f1") - F.col("_b"))
    pairs = b.mean_interval(d, "task", "d", DRAWS, ["model", "reference"])
    return k.greedy_tiers(k.model_means(rows), pairs)


query(f"""{SCORES}, x AS (SELECT task, a.model, c.model AS reference, a.f1 - c.f1 AS d FROM scores a JOIN scores c USING (task) WHERE a.model <> c.model), {_UNIT.format(unit="task", rows="x")},
    hi AS (SELECT model, reference, quantile_cont(mean, 0.975) AS high FROM (SELECT model, reference, b, sum(w * d) / sum(w) AS mean FROM x JOIN u ON task = unit JOIN dr USING (pos) GROUP BY ALL) GROUP BY ALL),
    o AS (SELECT model, row_number() OVER (ORDER BY round(avg(f1), 9) DESC, model) AS i FROM scores GROUP BY model),
    t AS (WITH RECURSIVE t AS (SELECT o.i, o.model, 1 AS tier, o.model AS leader FROM o WHERE o.i = 1 UNION ALL
        SELECT o.i, o.model, CASE WHEN hi.high < 0 THEN t.tier + 1 ELSE t.tier END, CASE WHEN hi.high < 0 THEN o.model ELSE t.leader END FROM t JOIN o ON o.i = t.i + 1 JOIN hi ON hi.model = o.model AND hi.reference = t.leader) SELECT * FROM t)
    SELECT model, tier, leader FROM t""")(paired_tiers)


@query(f"""{SCORES}, t AS (SELECT task, avg(f1) AS y FROM scores GROUP BY task), v AS (SELECT task, y, round(y, 9) AS o, length(task) AS x FROM t),
    p AS (SELECT draw, task, row_number() OVER (PARTITION BY draw ORDER BY task) AS i, row_number() OVER (PARTITION BY draw ORDER BY sha256('perm|' || draw || '|' || task), task) AS q, x, y FROM v, range(1, {DRAWS + 1}) r(draw)),
    d AS (SELECT a.draw, avg(c.y) FILTER (a.x > 4) - avg(c.y) FILTER (a.x <= 4) AS gap FROM p a JOIN p c ON a.draw = c.draw AND a.i = c.q GROUP BY a.draw),
    s AS (SELECT avg(y) FILTER (x > 4) - avg(y) FILTER (x <= 4) AS gap FROM v)
    SELECT round(any_value(s.gap), 6) AS gap, round((1 + count(*) FILTER (round(abs(d.gap), 9) >= round(abs(s.gap), 9))) / (count(*) + 1), 6) AS p_value FROM d, s""")
def permutation_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided permutation test: is the mean score of tasks with long names another one?"""
    rows = scores(spark, sf_dir).groupBy("task").agg(F.avg("f1").alias("y"))
    side = rows.select("task", (F.length("task") > 4).alias("long"))
    gap = F.avg(F.when(F.col("long"), F.col("y"))) - F.avg(F.when(~F.col("long"), F.col("y")))
    real = rows.join(side, "task").agg(gap.alias("real"))
    drawn = b.permuted(rows, "task", "y", DRAWS).join(side, "task").groupBy("draw").agg(gap.alias("gap"))
    over = F.round(F.abs("gap"), 9) >= F.round(F.abs("real"), 9)
    return rounded(drawn.crossJoin(F.broadcast(real)).agg(F.max("real").alias("gap"), ((1 + F.count_if(over)) / (F.count("*") + 1)).alias("p_value")))


@query(f"""{SCORES}, d AS (SELECT a.model, c.model AS reference, count(*) FILTER (a.f1 > c.f1) AS k, count(*) AS n FROM scores a JOIN scores c USING (task) WHERE a.model <> c.model GROUP BY ALL)
    SELECT model, reference, k AS wins, n, round((SELECT sum(CASE WHEN i >= k THEN factorial(n::INT) / (factorial(i::INT) * factorial((n - i)::INT)) ELSE 0 END) FROM range(0, 5) r(i))::DOUBLE / 2 ** n, 6) AS p_value FROM d""")
def sign_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact one-sided sign test of every pair."""
    rows = scores(spark, sf_dir)
    other = rows.select("task", F.col("model").alias("reference"), F.col("f1").alias("_b"))
    d = rows.join(other, "task").filter("model <> reference").groupBy("model", "reference").agg(F.count_if(F.col("f1") > F.col("_b")).alias("wins"), F.count("*").alias("n"))
    return rounded(d.withColumn("p_value", b.binomial_tail(F.col("wins").cast("int"), F.col("n").cast("int"))))
