"""Queries of resampling schemes beyond the plain bootstrap of items or tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import logit
from ..operators import resample as b
from .comparing import _UNIT, DRAWS, META, SCORES, SQL_BOOT, SQL_DRAW, replicates, scores
from .fixtures import decisions, label_def, models, table
from .registry import query, rounded
from .scoring import wrong

_WITHIN = """pl AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY unit) - 1 AS pos FROM x), sz AS (SELECT grp AS task, count(*) AS n FROM x GROUP BY grp),
    {draw}, dr AS (SELECT task AS grp, b, pos, count(*) AS w FROM slot GROUP BY ALL)""".format(draw=SQL_DRAW.format(keys="task", seed="mean", task="task", sizes="sz", last=DRAWS + 1))


@query(f"""{SQL_BOOT}, every AS (SELECT DISTINCT task, gold AS label FROM wrong),
    lb2 AS (SELECT k.task, k.model, b, l.label, 2 * sum(w) FILTER (gold = label AND pred = label) AS tp2, sum(w) FILTER (gold = label) AS g, sum(w) FILTER (pred = label) AS p FROM known k JOIN w USING (task, pattern) JOIN every l ON l.task = k.task GROUP BY ALL),
    sym AS (SELECT task, model, b, avg(coalesce(coalesce(tp2, 0)::DOUBLE / nullif(coalesce(g, 0) + coalesce(p, 0), 0), 0)) AS s FROM lb2 GROUP BY ALL)
    SELECT task, model, round(quantile_cont(f1, 0.025), 6) AS low, round(quantile_cont(f1, 0.975), 6) AS high, round(quantile_cont(s, 0.025), 6) AS symmetric_low, round(quantile_cont(s, 0.975), 6) AS symmetric_high
    FROM reps JOIN sym USING (task, model, b) GROUP BY task, model""")
def symmetric_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline and symmetric F1 from the same draws."""
    reps = b.symmetric_replicates(wrong(spark, sf_dir).filter("kind <> 'score'"), label_def(spark), DRAWS)
    return rounded(reps.groupBy("task", "model").agg(*b.interval(F.col("f1")), *b.interval(F.col("symmetric"), "symmetric_")))


@query(f"""{SQL_BOOT}, hd AS (SELECT task, model, avg(f1) AS f1 FROM classes WHERE gold_n > 0 GROUP BY ALL), scores AS (SELECT task, model, round(f1, 9) AS f1 FROM hd),
    r AS (SELECT task, max(f1) FILTER (model = 'm5') - max(f1) FILTER (model = 'm2') AS d FROM scores GROUP BY task),
    it AS (SELECT b, avg(d) AS m FROM (SELECT task, b, max(f1) FILTER (model = 'm5') - max(f1) FILTER (model = 'm2') AS d FROM reps GROUP BY ALL) GROUP BY b),
    u AS (SELECT task AS unit, d, row_number() OVER (ORDER BY task) - 1 AS pos FROM r), sl AS (SELECT 'u' AS task, count(*) AS n FROM r),
    h2 AS (SELECT n, b, c, sha256('mean|u|' || b || '|' || c) AS h FROM (SELECT *, unnest(range((n + 7) // 8)) AS c FROM sl, range(1, {DRAWS + 1}) q(b))),
    s2 AS (SELECT b, ('0x' || substr(h, 8 * i::INT + 1, 8))::BIGINT % n AS pos FROM h2, range(8) q(i) WHERE c * 8 + i < n),
    tk AS (SELECT b, avg(d) AS m FROM s2 JOIN u USING (pos) GROUP BY b), lo AS (SELECT (sum(d) OVER () - d) / (count(*) OVER () - 1) AS d FROM r)
    SELECT (SELECT round(avg(d), 6) FROM r) AS difference, (SELECT round(quantile_cont(m, 0.025), 6) FROM tk) AS task_low, (SELECT round(quantile_cont(m, 0.975), 6) FROM tk) AS task_high,
        (SELECT round(quantile_cont(m, 0.025), 6) FROM it) AS item_low, (SELECT round(quantile_cont(m, 0.975), 6) FROM it) AS item_high, (SELECT round(avg((m > 0)::INT), 6) FROM it) AS share_positive,
        (SELECT round(min(d), 6) FROM lo) AS without_low, (SELECT round(max(d), 6) FROM lo) AS without_high""")
def task_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the lead of one model over another hold over items, over tasks, and without each task?"""
    return rounded(b.task_sensitivity(scores(spark, sf_dir), replicates(spark, sf_dir), "m5", "m2", DRAWS))


@query(f"""WITH x AS (SELECT o_orderstatus AS status, o_custkey AS cust, o_totalprice AS y FROM orders), {_UNIT.format(unit="cust", rows="x")}, s AS (SELECT status, cust, sum(y) AS s, count(*) AS n FROM x GROUP BY ALL),
    reps AS (SELECT status, b, sum(w * s.s) / sum(w * s.n) AS m FROM s JOIN u ON cust = unit JOIN dr USING (pos) GROUP BY ALL)
    SELECT status, round(any_value(a), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM reps JOIN (SELECT status, avg(y) AS a FROM x GROUP BY status) USING (status) GROUP BY status""")
def whole_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are drawn with all their orders."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("y"))
    return rounded(b.cluster_interval(rows, "cust", "y", DRAWS, ["status"]))


@query(f"""{META}, x AS (SELECT task || '/' || family AS cell, avg(f1) FILTER (compute_class = 'api') - avg(f1) FILTER (compute_class = 'local') AS d FROM scores JOIN models USING (model) GROUP BY ALL HAVING count(DISTINCT compute_class) = 2), {_UNIT.format(unit="cell", rows="x")},
    reps AS (SELECT b, sum(w * d) / sum(w) AS m FROM x JOIN u ON cell = unit JOIN dr USING (pos) GROUP BY b)
    SELECT 'all' AS grp, (SELECT round(avg(d), 6) FROM x) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg((m > 0)::INT), 6) AS share_positive FROM reps""")
def cell_difference_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms of each cell: the mean difference when cells are drawn."""
    side = lambda c: F.avg(F.when(F.col("compute_class") == c, F.col("f1")))
    rows = scores(spark, sf_dir).join(F.broadcast(models(spark)), "model").groupBy(F.concat_ws("/", "task", "family").alias("cell")).agg((side("api") - side("local")).alias("d"), F.countDistinct("compute_class").alias("arms"))
    return rounded(b.mean_interval(rows.filter("arms = 2").withColumn("grp", F.lit("all")), "cell", "d", DRAWS, ["grp"]))


_GAPS = """x AS (SELECT doc_id AS unit, 'bin' || (doc_id % 4) AS grp, coalesce((a.pred = a.gold)::INT, 0) - coalesce((c.pred = c.gold)::INT, 0) AS d
    FROM documents JOIN dec a ON a.id = doc_id AND a.task = 'lang' AND a.model = 'm5' JOIN dec c ON c.id = doc_id AND c.task = 'lang' AND c.model = 'm2')"""


@query(f"""{SCORES}, {_GAPS}, {_WITHIN}, reps AS (SELECT grp, b, sum(w * d) / sum(w) AS m FROM pl JOIN dr USING (grp, pos) GROUP BY ALL)
    SELECT grp AS bin, round(any_value(a), 6) AS mean, any_value(n) AS n, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM reps JOIN (SELECT grp, avg(d) AS a, count(*) AS n FROM x GROUP BY grp) USING (grp) GROUP BY grp""")
def accuracy_gap_by_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models on the same items: the gap in accuracy in each bin of items, whose own items are drawn."""
    right = F.coalesce((F.col("pred") == F.col("gold")).cast("int"), F.lit(0))
    rows = decisions(spark, sf_dir).filter("task = 'lang' AND model IN ('m5', 'm2')").groupBy(F.col("id").alias("unit")).agg(F.sum(F.when(F.col("model") == "m5", right).otherwise(-right)).cast("double").alias("d"))
    rows = rows.withColumn("bin", F.concat(F.lit("bin"), (F.col("unit") % 4).cast("string")))
    return rounded(b.mean_interval_within(rows, "unit", "d", "bin", DRAWS))


@query(f"""WITH x AS (SELECT p_partkey AS unit, p_brand AS grp, p_size::DOUBLE AS a, p_retailprice AS y FROM part), {_WITHIN},
    reps AS (SELECT b, avg(s) AS s FROM (SELECT grp, b, CASE WHEN sum(w) * sum(w * a * a) - sum(w * a) ** 2 > 1e-9 AND sum(w) * sum(w * y * y) - sum(w * y) ** 2 > 1e-9 THEN (sum(w) * sum(w * a * y) - sum(w * a) * sum(w * y)) / (sqrt(greatest(sum(w) * sum(w * a * a) - sum(w * a) ** 2, 0)) * sqrt(greatest(sum(w) * sum(w * y * y) - sum(w * y) ** 2, 0))) END AS s FROM pl JOIN dr USING (grp, pos) GROUP BY ALL) GROUP BY b),
    o AS (SELECT avg(s) AS s, count(*) AS n FROM (SELECT grp, corr(a, y) AS s FROM x GROUP BY grp))
    SELECT (SELECT round(s, 6) FROM o) AS slope, (SELECT n FROM o) AS groups, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high FROM reps""")
def pooled_slope_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised slopes of datasets that count alike, each with draws of its own items."""
    return rounded(b.pooled_slope(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), "p_partkey", "p_size", "p_retailprice", "p_brand", DRAWS))


@query(f"""{META}, x AS (SELECT task, k::DOUBLE AS a, f1 AS y FROM scores JOIN models USING (model)), {_UNIT.format(unit="task", rows="x")},
    mo AS (SELECT task, sum(a * y) - sum(a) * sum(y) / count(*) AS xy, sum(a * a) - sum(a) ** 2 / count(*) AS xx FROM x GROUP BY task),
    reps AS (SELECT b, sum(w * xy) / sum(w * xx) AS s FROM mo JOIN u ON mo.task = unit JOIN dr USING (pos) GROUP BY b)
    SELECT (SELECT round(sum(xy) / sum(xx), 6) FROM mo) AS slope, (SELECT count(*) FROM mo) AS clusters, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high FROM reps""")
def fixed_effect_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slope with one effect for each task, when tasks are drawn; a task drawn twice is two tasks."""
    rows = scores(spark, sf_dir).join(F.broadcast(models(spark).select("model", F.col("k").cast("double").alias("k"))), "model")
    return rounded(b.fixed_effect_interval(rows, "task", "k", "f1", DRAWS))


@query(f"""{META}, x AS (SELECT model, ln(avg(f1) / (1 - avg(f1))) AS y, any_value(k)::DOUBLE AS a FROM scores JOIN models USING (model) GROUP BY model), {_UNIT.format(unit="model", rows="x")},
    reps AS (SELECT b, CASE WHEN sum(w) * sum(w * a * a) - sum(w * a) ** 2 <> 0 THEN (sum(w) * sum(w * a * y) - sum(w * a) * sum(w * y)) / (sum(w) * sum(w * a * a) - sum(w * a) ** 2) END AS s FROM x JOIN u ON model = unit JOIN dr USING (pos) GROUP BY b)
    SELECT (SELECT round(regr_slope(y, a), 6) FROM x) AS slope, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high FROM reps""")
def logit_slope_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slope on the logit scale."""
    rows = scores(spark, sf_dir).join(F.broadcast(models(spark)), "model").groupBy("model").agg(logit(F.avg("f1")).alias("y"), F.max("k").cast("double").alias("x"))
    return rounded(b.slope_interval(rows, "model", "x", "y", DRAWS))


@query("""SELECT round((avg(l_extendedprice) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') - avg(l_extendedprice) FILTER (l_returnflag = 'A' AND l_linestatus = 'O'))
    - (avg(l_extendedprice) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') - avg(l_extendedprice) FILTER (l_returnflag = 'N' AND l_linestatus = 'O')), 6) AS change FROM lineitem""")
def group_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a difference between two groups differs between two conditions."""
    return rounded(table(spark, sf_dir, "lineitem").agg(b.group_change("l_returnflag", ("A", "N"), "l_linestatus", ("F", "O"), "l_extendedprice").alias("change")))
