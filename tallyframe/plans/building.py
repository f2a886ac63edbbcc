"""Corpus builders as queries: each recipe is one of the patterns that source data comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import builders as b
from ..operators import corpus as c
from ..operators import reshape as r
from ..operators.builders import Recipe, build
from .fixtures import PRIORITIES, table
from .registry import query, rounded

_TEXT = "trim(regexp_replace(p_name || ' ' || p_brand, '\\s+', ' ', 'g'))"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded parts: a text, three coders and a topic."""
    rows = table(spark, sf_dir, "part")
    coder = lambda k: (F.col("p_partkey") * k % 7 < 3).cast("int")
    return rows.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", *(coder(k).alias(f"coder_{k}") for k in (3, 5, 11)), (F.col("p_size") % 6).cast("string").alias("code"))


_CODERS = ", ".join(f"(p_partkey * {k} % 7 < 3)::INT AS coder_{k}" for k in (3, 5, 11))
SQL_PARTS = f"parts AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, {_CODERS}, (p_size % 6)::VARCHAR AS code FROM part)"
_AGREED = "agreed AS (SELECT text FROM rows GROUP BY text HAVING count(DISTINCT gold) = 1)"


def _first(extra: str = "") -> str:
    """SQL that keeps the first row of each text and gold by order and id."""
    return f"SELECT task, item_id, source, text, gold FROM rows {extra} QUALIFY row_number() OVER (PARTITION BY text, gold ORDER BY o, item_id) = 1"


@query(f"""WITH {SQL_PARTS}, rows AS (SELECT 'topic' AS task, 'topic_' || p_partkey AS item_id, CASE WHEN p_partkey % 3 = 0 THEN 'test' ELSE 'train' END AS source, p_partkey AS o, {_TEXT} AS text,
    CASE code WHEN '0' THEN 'trade' WHEN '1' THEN 'health' WHEN '2' THEN 'defence' END AS gold FROM parts WHERE code IN ('0', '1', '2')), {_AGREED} {_first("JOIN agreed USING (text)")}""")
def build_from_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A union of splits with provenance, codes mapped to labels, unknown codes dropped, conflicts and repeats dropped."""
    rows = parts(spark, sf_dir)
    recipe = Recipe("topic", ("p_partkey",), ("p_name", "p_brand"), ("code",), "p_partkey", labels={"0": "trade", "1": "health", "2": "defence"}, known_only=True)
    test = F.col("p_partkey") % 3 == 0
    return build(recipe, {"test": rows.filter(test), "train": rows.filter(~test)}).withColumnRenamed("code", "gold")


@query(f"""WITH {SQL_PARTS}, rows AS (SELECT 'toxic' AS task, 'toxic_' || p_partkey || '_' || p_size AS item_id, 'all' AS source, p_partkey AS o, p_name AS text, coder_3 AS gold FROM parts WHERE coder_3 = coder_5), {_AGREED} {_first("JOIN agreed USING (text)")}""")
def build_where_coders_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows where two coders agree, with a composite id."""
    recipe = Recipe("toxic", ("p_partkey", "p_size"), ("p_name",), ("coder_3",), "p_partkey", agree=("coder_3", "coder_5"))
    return build(recipe, {"all": parts(spark, sf_dir)}).withColumnRenamed("coder_3", "gold")


@query(f"""WITH {SQL_PARTS}, rows AS (SELECT 'offensive' AS task, 'offensive_' || p_partkey AS item_id, 'zipped' AS source, p_partkey AS o, p_name || ' ' || p_type AS text, (coder_3 + coder_5 + coder_11 >= 2)::INT AS gold FROM parts), {_AGREED} {_first("JOIN agreed USING (text)")}""")
def build_from_aligned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files whose rows belong together by position, and the majority of three ratings."""
    rows = parts(spark, sf_dir)
    zipped = b.aligned([rows.select("p_partkey", "p_name", "coder_3"), rows.select("p_partkey", "p_type", "coder_5"), rows.select("p_partkey", "coder_11")], "p_partkey")
    recipe = Recipe("offensive", ("p_partkey",), ("p_name", "p_type"), ("gold",), "p_partkey", majority=("coder_3", "coder_5", "coder_11"))
    return build(recipe, {"zipped": zipped})


@query(f"""WITH {SQL_PARTS}, rows AS (SELECT 'kept' AS task, 'kept_' || p_partkey AS item_id, 'all' AS source, p_name AS text, coder_3 AS gold FROM parts) SELECT * FROM rows""")
def build_with_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats and conflicts stay, where a source says so."""
    recipe = Recipe("kept", ("p_partkey",), ("p_name",), ("coder_3",), "p_partkey", conflicts="keep", dedup=False)
    return build(recipe, {"all": parts(spark, sf_dir)}).withColumnRenamed("coder_3", "gold")


@query(f"""WITH {SQL_PARTS}, rows AS (SELECT 'vec_' || p_partkey AS item_id, p_partkey AS o, p_name || ' ' || p_brand AS text, coder_3, coder_5, coder_11 FROM parts),
    agreed AS (SELECT text FROM rows GROUP BY text HAVING count(DISTINCT (coder_3, coder_5, coder_11)) = 1)
    SELECT item_id, text, coder_3, coder_5, coder_11 FROM rows JOIN agreed USING (text) QUALIFY row_number() OVER (PARTITION BY text, coder_3, coder_5, coder_11 ORDER BY o, item_id) = 1""")
def build_label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several 0/1 labels: a conflict is another vector."""
    recipe = Recipe("vec", ("p_partkey",), ("p_name", "p_brand"), ("coder_3", "coder_5", "coder_11"), "p_partkey")
    return build(recipe, {"all": parts(spark, sf_dir)}).select("item_id", "text", *recipe.gold)


@query(f"""WITH {SQL_PARTS}, rows AS (SELECT 'pair_' || p_partkey AS item_id, p_partkey AS o, p_name AS text, p_brand, CASE coder_5 WHEN 0 THEN '1' ELSE '0' END AS gold FROM parts),
    agreed AS (SELECT text, p_brand FROM rows GROUP BY ALL HAVING count(DISTINCT gold) = 1)
    SELECT item_id, text, p_brand AS hypothesis, gold FROM rows JOIN agreed USING (text, p_brand) QUALIFY row_number() OVER (PARTITION BY text, p_brand, gold ORDER BY o, item_id) = 1""")
def build_text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and hypothesis are the key, and labels are turned round."""
    recipe = Recipe("pair", ("p_partkey",), ("p_name",), ("coder_5",), "p_partkey", labels={"0": "1", "1": "0"}, pair=("p_brand",))
    return build(recipe, {"all": parts(spark, sf_dir)}).select("item_id", "text", F.col("p_brand").alias("hypothesis"), F.col("coder_5").alias("gold"))


@query("""WITH c AS (SELECT o_custkey AS unit, o_orderkey % 5 AS coder, o_orderkey AS seen, o_orderstatus AS domain, (o_orderkey % 4)::INT AS code FROM orders),
    f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY unit, coder ORDER BY seen) = 1),
    d AS (SELECT unit, domain, count(*) AS n, sum(count(*)) OVER (PARTITION BY unit) AS coders FROM f GROUP BY unit, domain QUALIFY 2 * count(*) > sum(count(*)) OVER (PARTITION BY unit)),
    k AS (SELECT f.unit, f.domain, coders, f.code, count(*) AS n FROM f JOIN d USING (unit, domain) GROUP BY ALL),
    m AS (SELECT unit, max(n) AS top, sum(code * n) / sum(n) AS mean_code FROM k GROUP BY unit)
    SELECT unit, any_value(domain) AS domain, any_value(coders)::BIGINT AS coders, any_value(code) AS code, round(any_value(mean_code), 6) AS mean_code FROM k JOIN m USING (unit) WHERE n = top GROUP BY unit HAVING count(*) = 1""")
def modal_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several coders of a unit: the first coding of each counts, the domain needs a majority, ties of codes are dropped."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), (F.col("o_orderkey") % 5).alias("coder"), F.col("o_orderkey").alias("seen"), F.col("o_orderstatus").alias("domain"), (F.col("o_orderkey") % 4).cast("int").alias("code"))
    return rounded(b.modal_code(rows, "unit", "coder", "seen", "domain", "code"))


@query("""WITH s AS (SELECT l_orderkey AS doc, l_linenumber AS line, CASE WHEN l_tax > 0.01 THEN l_returnflag END AS type FROM lineitem),
    g AS (SELECT doc, line, CASE WHEN count(type) = 0 THEN 'none' WHEN count(DISTINCT type) > 1 THEN 'mixed' ELSE any_value(type) FILTER (type IS NOT NULL) END AS type FROM s GROUP BY doc, line)
    SELECT doc, line, type, row_number() OVER (PARTITION BY doc ORDER BY line) - 1 AS sentence, o_orderpriority AS about FROM g LEFT JOIN orders ON doc = o_orderkey""")
def sentence_label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set of types of each sentence as one label, a running number of sentences, and a join on keys of other names."""
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), F.when(F.col("l_tax") > 0.01, F.col("l_returnflag")).alias("type"))
    sets = b.label_sets(rows, ["doc", "line"], "type")
    sets = sets.withColumn("sentence", (F.row_number().over(W.partitionBy("doc").orderBy("line")) - 1).cast("long"))
    orders = table(spark, sf_dir, "orders")
    return sets.join(orders, sets["doc"] == orders["o_orderkey"], "left").select("doc", "line", "type", "sentence", F.col("o_orderpriority").alias("about"))


@query("""WITH n AS (SELECT source, lang AS label, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT source, sum(n)::BIGINT AS n_votes, max(n) AS top, arg_max(label, n) AS gold FROM n GROUP BY source)
    SELECT source, gold, n_votes, round(top / n_votes, 6) AS share FROM t WHERE n_votes >= 3 AND 2 * top > n_votes""")
def voted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with three votes or more and a strict majority."""
    return rounded(b.voted_items(table(spark, sf_dir, "documents"), "source", "lang"))


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY sha256('take|' || event_id), event_id) <= 25")
def class_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 rows of each class by digest."""
    return b.class_take(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id", 25, "take")


@query("""SELECT doc_id, quality::INT AS binary_gold, lang AS label_gold, n_chars::DOUBLE AS score_gold, quality::INT AS quality, toxic::INT AS toxic FROM documents JOIN labels USING (doc_id)""")
def gold_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold as a number, a text or a map, by kind of label."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    both = b.gold_of("multi_binary", {"quality": F.col("quality"), "toxic": F.col("toxic")})
    rows = rows.select("doc_id", b.gold_of("binary", {"q": F.col("quality")}).alias("binary_gold"), b.gold_of("categorical", {"l": F.col("lang")}).alias("label_gold"), b.gold_of("score", {"s": F.col("n_chars")}).alias("score_gold"), both.alias("m"))
    return rows.select("doc_id", "binary_gold", "label_gold", "score_gold", F.col("m")["quality"].alias("quality"), F.col("m")["toxic"].alias("toxic"))


@query("""SELECT doc_id, lang, n_chars FROM documents WHERE lang <> 'es' QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) > 20""")
def new_items_of_active_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items after the first 20 of each task, without the tasks whose status is excluded."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    status = spark.createDataFrame([("en", "active"), ("de", "active"), ("fr", None), ("es", "excluded")], "task string, status string")
    active = c.active_tasks(status)
    return c.after_baseline(docs.join(F.broadcast(active), docs["lang"] == active["task"], "left_semi"), ["lang"], "doc_id", 20)


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 7")
def smallest_after_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven smallest of what a filter leaves, sorted by several keys with nulls last."""
    rows = c.smallest(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F", ["o_totalprice", "o_orderkey"], 7)
    return rows.select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 12")
def tasks_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that both sides have."""
    return c.keys_of_both(table(spark, sf_dir, "orders").select("o_custkey"), table(spark, sf_dir, "customer").filter("c_nationkey < 12").select("c_custkey"))


@query("""WITH n AS (SELECT l_returnflag, l_linestatus, l_suppkey % 10 AS grp, count(*) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY ALL)
    SELECT l_returnflag, l_linestatus, arg_max(grp, (n, -grp)) AS grp, max(n) AS n FROM n GROUP BY l_returnflag, l_linestatus""")
def most_eligible_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each task's compatible groups the one with most eligible items; ties go to the lowest."""
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 30").withColumn("grp", F.col("l_suppkey") % 10)
    return c.most_eligible(rows, ["l_returnflag", "l_linestatus"], "grp")


_PIVOT = ", ".join(f"round(avg(o_totalprice) FILTER (o_orderpriority = '{x}'), 6) AS \"{x}\"" for x in PRIORITIES)


@query(f"SELECT o_orderstatus, {_PIVOT} FROM orders GROUP BY o_orderstatus")
def mean_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table of means."""
    return rounded(r.pivot_mean(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderpriority", "o_totalprice", PRIORITIES))
