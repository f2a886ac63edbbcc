"""Queries of votes, class comparisons, slopes with draws, budgets and boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import cost as h
from ..operators import inference as i
from ..operators import metrics as m
from ..operators import ranking as k
from ..operators import resample as b
from ..operators import reshape as r
from ..operators import state as s
from ..operators import trends as g
from ..operators import votes as v
from .comparing import _UNIT, DRAWS, META, SCORES, scores
from .fixtures import SQL_DECISIONS, items, models, table, tasks
from .registry import query, rounded


@query("""WITH n AS (SELECT user_id, event_type AS label, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT user_id, label AS gold FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, label) = 1),
    j AS (SELECT label, gold, n FROM n JOIN g USING (user_id)), l AS (SELECT DISTINCT label FROM j)
    SELECT l.label, coalesce(sum(n) FILTER (gold = l.label), 0)::BIGINT AS gold_n, coalesce(sum(n) FILTER (j.label = l.label), 0)::BIGINT AS pred_n, coalesce(sum(n) FILTER (gold = l.label AND j.label = l.label), 0)::BIGINT AS tp,
        round(2.0::DOUBLE * coalesce(sum(n) FILTER (gold = l.label AND j.label = l.label), 0) / (coalesce(sum(n) FILTER (gold = l.label), 0) + coalesce(sum(n) FILTER (j.label = l.label), 0)), 6) AS f1 FROM l, j GROUP BY l.label""")
def vote_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("label")).agg(F.count("*").alias("n"))
    return rounded(v.vote_baseline(n, "user_id", "label", "n"))


@query("""WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT source, max(n) / sum(n) AS share FROM n GROUP BY source)
    SELECT 'all' AS name, round(avg(share), 6) AS mean, round(quantile_cont(share, 0.25), 6) AS lower_quartile, round(median(share), 6) AS median, round(quantile_cont(share, 0.75), 6) AS upper_quartile, round(avg((share = 1)::INT), 6) AS unanimous, count(*) AS n FROM s""")
def majority_share_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    shares = n.groupBy("source").agg((F.max("n") / F.sum("n")).alias("share")).withColumn("name", F.lit("all"))
    return rounded(v.share_summary(shares, "share", "name"))


@query("""WITH c AS (SELECT (l_orderkey % 50) AS unit, l_suppkey % 9 AS coder, array_to_string(list_sort(list(DISTINCT l_returnflag)), '+') AS s FROM lineitem GROUP BY ALL), n AS (SELECT unit, s, count(*) AS n FROM c GROUP BY ALL)
    SELECT unit, max(n) AS top, sum(n)::BIGINT AS coders, round(max(n) / sum(n), 6) AS share FROM n GROUP BY unit""")
def label_set_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("unit"), (F.col("l_suppkey") % 9).alias("coder"), "l_returnflag")
    return rounded(v.label_set_votes(rows, "unit", "coder", "l_returnflag"))


@query("""WITH c AS (SELECT l_partkey AS unit, l_returnflag AS domain, l_linenumber AS code FROM lineitem), sh AS (SELECT *, avg((domain = 'R')::INT) OVER (PARTITION BY unit) AS share FROM c), rr AS (SELECT * FROM sh WHERE share > 0.5 AND domain = 'R'),
    n AS (SELECT unit, share, code, count(*) AS n FROM rr GROUP BY ALL), t AS (SELECT * FROM n QUALIFY rank() OVER (PARTITION BY unit ORDER BY n DESC) = 1), o AS (SELECT unit, any_value(share) AS share, max(code) AS mode_code FROM t GROUP BY unit HAVING count(*) = 1)
    SELECT unit, round(any_value(o.share), 6) AS share, any_value(mode_code) AS mode_code, round(avg(code), 6) AS mean_code FROM o JOIN rr USING (unit) GROUP BY unit""")
def domain_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("unit"), F.col("l_returnflag").alias("domain"), F.col("l_linenumber").alias("code"))
    return rounded(v.domain_majority(rows, "unit", "domain", "code", "R"))


@query("SELECT l_suppkey, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median, round(stddev_samp(l_quantity), 6) AS sd, count(l_quantity) AS ratings, count(*) AS size FROM lineitem GROUP BY l_suppkey")
def rating_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(v.rating_summary(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity"))


@query(f"""{META} SELECT count(*) FILTER (a.f1 >= c.f1) AS wins, round(avg(c.f1 - a.f1), 6) AS mean_gap, count(*) AS tasks FROM scores a JOIN scores c USING (task) WHERE a.model = 'm5' AND c.model = 'm2'""")
def fixed_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two chosen models task by task."""
    wide = r.score_matrix(scores(spark, sf_dir).filter("model IN ('m2', 'm5')"), "task", "model", "f1", ["m2", "m5"])
    return rounded(wide.agg(F.count_if(F.col("m5") >= F.col("m2")).alias("wins"), F.avg(F.col("m2") - F.col("m5")).alias("mean_gap"), F.count("*").alias("tasks")))


@query(f"""{META}, w AS (SELECT task, any_value(category) AS category, max(f1) FILTER (compute_class = 'local') AS l, max(f1) FILTER (compute_class = 'api') AS a FROM scores JOIN models USING (model) JOIN tasks USING (task) GROUP BY task)
    SELECT category, round(avg(a - l), 6) AS mean_gap, count(*) AS tasks, round(max(a - l), 6) AS largest_gap FROM w GROUP BY category""")
def gap_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of each class per task, and the gap between them by category."""
    best = k.selection_value(scores(spark, sf_dir), models(spark).select("model", "compute_class")).join(F.broadcast(tasks(spark).select("task", "category")), "task")
    gap = F.col("best_api") - F.col("best_local")
    return rounded(best.groupBy("category").agg(F.avg(gap).alias("mean_gap"), F.count("*").alias("tasks"), F.max(gap).alias("largest_gap")))


@query("""SELECT year(o_orderdate)::INT AS order_year, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS f, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def year_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell means of one year against a second factor."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = rows.groupBy(F.year("o_orderdate").alias("order_year")).pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity"))
    return rounded(out.select("order_year", F.col("F").alias("f"), F.col("O").alias("o")))


@query(f"""{META}, x AS (SELECT model, round(avg(f1), 9) AS y, any_value(k)::DOUBLE AS x FROM scores JOIN models USING (model) GROUP BY model), {_UNIT.format(unit="model", rows="x")},
    s AS (SELECT b, (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / nullif(sum(w) * sum(w * x * x) - sum(w * x) ** 2, 0) AS s FROM x JOIN u ON model = unit JOIN dr USING (pos) GROUP BY b)
    SELECT round((SELECT regr_slope(y, x) FROM x), 6) AS slope, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high FROM s""")
def slope_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs bootstrap of a slope over models; a draw of one model only has none."""
    rows = scores(spark, sf_dir).join(F.broadcast(models(spark)), "model").groupBy("model").agg(F.round(F.avg("f1"), 9).alias("y"), F.max("k").cast("double").alias("x"))
    return rounded(b.slope_interval(rows, "model", "x", "y", DRAWS))


@query(f"""{META}, x AS (SELECT model, round(avg(f1), 9) AS y, any_value(k) AS x FROM scores JOIN models USING (model) GROUP BY model),
    p AS (SELECT draw, row_number() OVER (PARTITION BY draw ORDER BY model) AS i, row_number() OVER (PARTITION BY draw ORDER BY sha256('perm|' || draw || '|' || model), model) AS q, x, y FROM x, range(1, {DRAWS + 1}) r(draw)),
    z AS (SELECT a.draw, a.x, c.y FROM p a JOIN p c ON a.draw = c.draw AND a.i = c.q),
    rk AS (SELECT draw, rank() OVER (PARTITION BY draw ORDER BY x) + (count(*) OVER (PARTITION BY draw, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY draw ORDER BY y) + (count(*) OVER (PARTITION BY draw, y) - 1) / 2.0 AS c FROM z),
    d AS (SELECT draw, corr(a, c) AS r FROM rk GROUP BY draw),
    o AS (SELECT corr(a, c) AS r FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS c FROM x))
    SELECT round(any_value(o.r), 6) AS correlation, round((1 + count(*) FILTER (round(d.r, 9) >= round(o.r, 9))) / (count(*) + 1), 6) AS p_value FROM d, o""")
def permutation_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-sided permutation test of a rank correlation."""
    rows = scores(spark, sf_dir).join(F.broadcast(models(spark)), "model").groupBy("model").agg(F.round(F.avg("f1"), 9).alias("y"), F.max("k").alias("x"))
    real = m.spearman(rows.withColumn("_all", F.lit(1)), "x", "y", ["_all"], "real")
    drawn = m.spearman(b.permuted(rows, "model", "y", DRAWS).join(F.broadcast(rows.select("model", "x")), "model"), "x", "y", ["draw"], "r")
    over = F.count_if(F.round("r", 9) >= F.round("real", 9))
    return rounded(drawn.crossJoin(F.broadcast(real)).agg(F.max("real").alias("correlation"), ((1 + over) / (F.count("*") + 1)).alias("p_value")))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, sum(o_totalprice) OVER (ORDER BY o_orderkey) AS spent FROM orders) SELECT o_orderkey, round(spent, 2) AS spent, round(spent, 2) <= 1000000 AS kept FROM o""")
def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a hard budget keeps, by priority."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rounded(h.within_budget(rows, "o_orderkey", "o_totalprice", 1_000_000).select("o_orderkey", "spent", "kept"), 2)


@query("""WITH l AS (SELECT user_id, max(ts) AS last_at, arg_max(event_type, (ts, event_type)) AS last_event, count(*) AS events FROM events GROUP BY user_id),
    b AS (SELECT *, CASE last_event WHEN 'start' THEN 'active' WHEN 'update' THEN 'active' WHEN 'finish' THEN 'completed' WHEN 'fail' THEN 'failed' WHEN 'table' THEN 'tabled' ELSE 'other' END AS bucket FROM l)
    SELECT user_id, last_event, bucket, events, row_number() OVER (PARTITION BY bucket ORDER BY last_at DESC, user_id)::INT AS place FROM b QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY last_at DESC, user_id) <= 12""")
def status_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = s.latest_runs(table(spark, sf_dir, "events"), "user_id", "ts", "event_type")
    return s.status_board(runs, "user_id").select("user_id", "last_event", "bucket", "events", "place")


@query("""SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) = 1""")
def newest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.newest_per_key(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_type").select("user_id", "event_id", "event_type", "value")


@query(f"""WITH {SQL_DECISIONS}, n AS (SELECT task, any_value(kind) AS kind, gold, count(*) AS n FROM items GROUP BY task, gold), p AS (SELECT *, n / sum(n) OVER (PARTITION BY task) AS p FROM n), e AS (SELECT task, any_value(kind) AS kind, exp(sum(-p * ln(p))) AS eff, count(*) AS labels FROM p GROUP BY task)
    SELECT task, CASE WHEN labels <= 2 THEN 'binary' WHEN labels = 3 THEN 'three classes' ELSE 'many classes' END AS structure, CASE WHEN eff >= 8 THEN 'high' WHEN eff >= 3 OR labels * 20 >= 300 THEN 'medium' ELSE 'low' END AS complexity FROM e""")
def coding_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    eff = m.effective_labels(items(spark, sf_dir)).join(F.broadcast(tasks(spark).select("task", "kind")), "task")
    return eff.select("task", t.label_structure(F.col("n_labels")).alias("structure"), t.coding_complexity(F.col("kind"), F.col("effective_labels"), F.col("n_labels") * 20).alias("complexity"))


@query("""SELECT p_brand, round(avg(p_retailprice), 6) AS mean_price, max((p_brand = 'Brand#11')::INT) AS p_brand_one, row_number() OVER (ORDER BY try_cast(regexp_extract(p_brand, '[0-9]+') AS INT), p_brand)::INT AS natural_order FROM part GROUP BY p_brand""")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers before text, by value."""
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean_price"), F.max((F.col("p_brand") == "Brand#11").cast("int")).alias("p_brand_one"))
    order = F.row_number().over(W.orderBy(F.regexp_extract("p_brand", "[0-9]+", 0).try_cast("int"), "p_brand"))
    return rounded(rows.withColumn("natural_order", order))


@query("""WITH p AS (SELECT 2 * p_size AS a, p_retailprice AS y FROM part) SELECT round(regr_intercept(y, a), 6) AS intercept, round(regr_slope(y, a), 6) AS slope FROM p""")
def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal equations from one pass; the two-by-two system is solved on the driver."""
    found = g.least_squares(table(spark, sf_dir, "part").withColumn("a", 2 * F.col("p_size")), "p_retailprice", ["a"])
    return spark.createDataFrame([(round(found["intercept"], 6), round(found["a"], 6))], "intercept double, slope double")


@query(f"""{SCORES}, x AS (SELECT task, model, f1 FROM scores), c AS (SELECT model, avg(f1) AS raw FROM x GROUP BY model), {_UNIT.format(unit="task", rows="x")},
    reps AS (SELECT model, b, sum(w * f1) / sum(w) AS mean FROM x JOIN u ON task = unit JOIN dr USING (pos) GROUP BY ALL),
    res AS (SELECT row_number() OVER (ORDER BY i) - 1 AS pos, v, count(*) OVER () AS n FROM (VALUES (1, -0.01::DOUBLE), (2, 0.0::DOUBLE), (3, 0.01::DOUBLE), (4, 0.02::DOUBLE)) z(i, v)),
    m AS (SELECT model, 0.1 + 0.8 * mean + v AS mean FROM reps JOIN res ON res.pos = ('0x' || substr(sha256('residual|' || model || '|' || b), 1, 8))::BIGINT % 4)
    SELECT c.model, round(0.1 + 0.8 * any_value(raw), 6) AS calibrated, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM c JOIN m USING (model) GROUP BY c.model""")
def calibrated_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear calibration of the mean; replicates also draw one of its residuals."""
    residuals = spark.createDataFrame([(0, -0.01), (1, 0.0), (2, 0.01), (3, 0.02)], "pos long, residual double")
    return rounded(b.calibrated_interval(scores(spark, sf_dir), "task", "f1", DRAWS, "model", 0.1, 0.8, residuals))
