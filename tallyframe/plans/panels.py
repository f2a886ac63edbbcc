"""Fixed effects on unbalanced tables, places of text keys, exact quantiles, skylines and as-of lookups over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panel as p
from ..operators import ranking as k
from ..operators.numbering import placed
from ..operators.quantiles import exact_quantiles
from .fixtures import FAMILY, SQL_DECISIONS, SQL_MODELS, decisions, models, table
from .registry import query, rounded

#: Two regressors ``a`` and ``b`` and an outcome ``y``, all without the effects, in ``left_over`` (with cluster ``c``): both slopes and their clustered errors.
_SANDWICH = """x AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_, count(*) AS n FROM left_over),
    i AS (SELECT *, aa * bb - ab * ab AS det FROM x), s AS (SELECT n, bb / det AS p, -ab / det AS q, aa / det AS r, (bb * ay - ab * by_) / det AS s1, (aa * by_ - ab * ay) / det AS s2 FROM i),
    u AS (SELECT c, sum(a * (y - s1 * a - s2 * b)) AS u1, sum(b * (y - s1 * a - s2 * b)) AS u2 FROM left_over, s GROUP BY c),
    m AS (SELECT sum(u1 * u1) AS m11, sum(u1 * u2) AS m12, sum(u2 * u2) AS m22, count(*) AS g FROM u),
    v AS (SELECT *, g / (g - 1)::DOUBLE * (n - 1) / (n - {used}) AS scale FROM s, m),
    t AS (SELECT unnest(['{first}', '{second}']) AS term, unnest([s1, s2]) AS estimate, unnest([sqrt(scale * (p * p * m11 + 2 * p * q * m12 + q * q * m22)), sqrt(scale * (q * q * m11 + 2 * q * r * m12 + r * r * m22))]) AS e, n, g FROM v)
    SELECT term, round(estimate, 6) AS estimate, round(e, 6) AS cluster_error, round(estimate - 1.959963984540054 * e, 6) AS low, round(estimate + 1.959963984540054 * e, 6) AS high, n, g AS clusters FROM t"""


@query(f"""WITH RECURSIVE o AS (SELECT o_custkey AS c, o_orderpriority AS g, o_totalprice / 1000 AS y, month(o_orderdate)::DOUBLE AS a, day(o_orderdate)::DOUBLE AS b FROM orders),
    r AS (SELECT 0 AS t, c, g, y, a, b FROM o
        UNION ALL SELECT t + 1, c, g, y - avg(y) OVER w, a - avg(a) OVER w, b - avg(b) OVER w FROM (SELECT t, c, g, y - avg(y) OVER h AS y, a - avg(a) OVER h AS a, b - avg(b) OVER h AS b FROM r WHERE t < 25 WINDOW h AS (PARTITION BY c)) WINDOW w AS (PARTITION BY g)),
    left_over AS (SELECT * FROM r WHERE t = 25),
    {_SANDWICH.format(first="month", second="day", used="2 - (SELECT count(DISTINCT c) + count(DISTINCT g) - 1 FROM o)")}""")
def two_way_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by month and day with effects of customers, who order unequally often, and priorities; errors by customer."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", (F.col("o_totalprice") / 1000).alias("y"), F.month("o_orderdate").alias("month"), F.day("o_orderdate").alias("day"))
    return rounded(p.fixed_effects(rows, ["o_custkey", "o_orderpriority"], "y", ["month", "day"], "o_custkey"))


@query(f"""WITH {SQL_DECISIONS}, {SQL_MODELS}, o AS (SELECT item_id AS c, gold, pred::DOUBLE - gold::DOUBLE AS y, (family = 'beta')::INT::DOUBLE AS a, (family = 'gamma')::INT::DOUBLE AS b FROM dec JOIN models USING (model) WHERE task = 'size' AND pred IS NOT NULL),
    left_over AS (SELECT c, y - avg(y) OVER w AS y, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b FROM o WINDOW w AS (PARTITION BY gold)),
    {_SANDWICH.format(first="family=beta", second="family=gamma", used="2 - (SELECT count(DISTINCT gold) FROM o)")}""")
def code_effect_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families' differences in signed error to the first family, with an effect for every gold code; errors by item."""
    rows = decisions(spark, sf_dir).filter("task = 'size' AND pred_num IS NOT NULL").join(F.broadcast(models(spark).select("model", "family")), "model")
    others = sorted(set(FAMILY.values()))[1:]
    return rounded(p.group_gap(rows, "family", others, "gold", F.col("pred_num") - F.col("gold_num"), "item_id"))


@query("SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) - 1 AS place FROM customer")
def named_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's place by name in the segment: text keys, dealt out by ranges."""
    return placed(table(spark, sf_dir, "customer"), ["c_name"], ["c_mktsegment"], "place").select("c_custkey", "c_mktsegment", "place")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.999), 6) AS p999 FROM events GROUP BY event_type")
def event_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exact_quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"median": 0.5, "p90": 0.9, "p999": 0.999}))


@query("""SELECT o_orderkey, o_totalprice FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_totalprice >= a.o_totalprice AND b.o_orderdate <= a.o_orderdate AND b.o_custkey >= a.o_custkey
    AND (b.o_totalprice > a.o_totalprice OR b.o_orderdate < a.o_orderdate OR b.o_custkey > a.o_custkey))""")
def order_skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that none beats in price, date and customer number at once."""
    rows = table(spark, sf_dir, "orders").withColumn("_day", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")))
    return k.pareto_front(rows, ["o_totalprice", "o_custkey"], ["_day"], "o_orderkey").select("o_orderkey", "o_totalprice")


@query("""WITH l AS (SELECT o_orderkey::VARCHAR AS leader, o_orderdate AS d, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F'),
    h AS (SELECT o.o_orderkey, o.o_orderdate, min((d, leader)) AS h FROM orders o LEFT JOIN l ON d <= o.o_orderdate AND v >= o.o_totalprice WHERE o.o_orderstatus = 'O' AND l.leader IS NOT NULL GROUP BY ALL)
    SELECT o.o_orderkey::VARCHAR AS model, h.h[2] AS leader, round(date_diff('day', h.h[1]::DATE, o.o_orderdate::DATE) / 30.4375::DOUBLE, 6) AS lag_months FROM orders o LEFT JOIN h USING (o_orderkey) WHERE o_orderstatus = 'O'""")
def order_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each open order, the earliest filled one before it of at least its price."""
    rows = table(spark, sf_dir, "orders").withColumn("model", F.col("o_orderkey").cast("string"))
    return rounded(k.lag_behind(rows, F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "F", "o_orderdate", "o_totalprice"))
