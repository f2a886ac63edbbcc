"""Queries that audit results: disagreements of two models, validity at several levels, tests of group effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as c
from ..operators import resample as b
from ..operators import trends as g
from .comparing import DRAWS, SCORES, scores
from .fixtures import table
from .registry import query, rounded
from .scoring import wrong


@query(f"""{SCORES}, d AS (SELECT task, round(max(f1) FILTER (model = 'm5') - max(f1) FILTER (model = 'm2'), 9) AS delta FROM scores GROUP BY task),
    ch AS (SELECT task FROM d QUALIFY row_number() OVER (ORDER BY delta, task) <= 1 OR row_number() OVER (ORDER BY delta DESC, task DESC) <= 1),
    r AS (SELECT task, id, bool_and(coalesce(gold = pred, false)) FILTER (model = 'm2') AS first_right, bool_and(coalesce(gold = pred, false)) FILTER (model = 'm5') AS second_right
        FROM wrong WHERE task IN (SELECT task FROM ch) GROUP BY task, id)
    SELECT task, id, first_right, second_right FROM r WHERE first_right <> second_right QUALIFY row_number() OVER (PARTITION BY task ORDER BY sha256('audit|' || task || '|' || id), id) <= 20""")
def disagreement_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items to read by eye from the tasks where two models differ most, either way."""
    of = lambda model: F.max(F.when(F.col("model") == model, F.col("f1")))
    deltas = scores(spark, sf_dir).groupBy("task").agg(F.round(of("m5") - of("m2"), 9).alias("delta"))
    return c.disagreement_sample(wrong(spark, sf_dir), deltas, "m2", "m5", 1, 20, "audit")


@query(f"""{SCORES}, v AS (SELECT task || '/' || model AS cell, task, f1 FROM scores), t AS (SELECT sum(f1 * f1) - sum(f1) ** 2 / count(*) AS total FROM v),
    p AS (SELECT draw, task, f1, row_number() OVER (PARTITION BY draw ORDER BY cell) AS i, row_number() OVER (PARTITION BY draw ORDER BY sha256('perm|' || draw || '|' || cell), cell) AS q FROM v, range(1, {DRAWS + 1}) r(draw)),
    s AS (SELECT a.draw, a.task, sum(c.f1) AS s, count(*) AS n FROM p a JOIN p c ON a.draw = c.draw AND a.i = c.q GROUP BY ALL),
    e AS (SELECT draw, (sum(s * s / n) - sum(s) ** 2 / sum(n)) / (SELECT total FROM t) AS eta FROM s GROUP BY draw),
    o AS (SELECT (sum(s * s / n) - sum(s) ** 2 / sum(n)) / (SELECT total FROM t) AS eta FROM (SELECT task, sum(f1) AS s, count(*) AS n FROM v GROUP BY task))
    SELECT round(any_value(o.eta), 6) AS eta_squared, round((1 + count(*) FILTER (round(e.eta, 9) >= round(o.eta, 9))) / (count(*) + 1), 6) AS p_value FROM e, o""")
def permutation_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do tasks explain more of the scores than chance would?"""
    rows = scores(spark, sf_dir).select(F.concat_ws("/", "task", "model").alias("cell"), "task", "f1")
    return rounded(b.permutation_eta(rows, "cell", "task", "f1", DRAWS))


@query("""WITH s AS (SELECT l_suppkey AS unit, l_suppkey % 7 AS place, l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_linenumber <= 2),
    f AS (SELECT l_suppkey AS unit, avg(l_extendedprice) AS f FROM lineitem GROUP BY l_suppkey), u AS (SELECT unit, avg(x) AS x, avg(y) AS y FROM s GROUP BY unit), j AS (SELECT * FROM u JOIN f USING (unit)),
    p AS (SELECT avg(x) AS x, avg(y) AS y FROM s GROUP BY place)
    SELECT (SELECT round(corr(x, y), 6) FROM s) AS r_row, (SELECT round(corr(x, y), 6) FROM j) AS r_same, (SELECT round(corr(x, f), 6) FROM j) AS r_all,
        (SELECT round(corr(y, f), 6) FROM j) AS r_ceiling, (SELECT round(corr(x, y), 6) FROM p) AS r_place""")
def validity_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, suppliers and groups of suppliers; the first two lines of an order are the sample."""
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_suppkey").alias("unit"), (F.col("l_suppkey") % 7).alias("place"), "l_quantity", "l_extendedprice")
    return rounded(g.validity_levels(rows.filter("l_linenumber <= 2"), rows, "unit", "place", "l_quantity", "l_extendedprice"))
