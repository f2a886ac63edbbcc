"""Queries of the smaller scalar functions, of request rows and of run bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import builders as b
from ..operators import cost as h
from ..operators import inference as i
from ..operators import state as s
from .fixtures import LANGS, SQL_DECISIONS, SQL_MODELS, decisions, table
from .registry import query, rounded


@query("""SELECT p_partkey, p_name AS no_tag, p_partkey::VARCHAR AS id, p_name AS no_number, CASE p_size % 3 WHEN 0 THEN 'none' WHEN 1 THEN p_brand ELSE 'mixed' END AS parties,
    left(p_name, 9) AS head, replace(replace(p_type, ' ', '_'), '&', '_') AS key, p_type AS label, p_brand AS short, CASE WHEN p_size % 4 <> 0 THEN p_retailprice END AS number FROM part""")
def repaired_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashtags, float tails, numbered titles, sets of parties, previews, keys and back, short labels, and NaN."""
    rows, at = table(spark, sf_dir, "part"), F.col("p_size") % 3
    types = [r["p_type"] for r in rows.select("p_type").distinct().collect()]  # a small dimension
    part = F.when(at == 1, F.col("p_brand")).when(at == 2, F.concat("p_brand", F.lit("|x")))
    return rows.select(
        "p_partkey",
        t.without_hashtag(F.concat("p_name", F.lit(" #SemST ")), "semst").alias("no_tag"),
        t.without_float_tail(F.concat(F.col("p_partkey").cast("string"), F.lit(".0"))).alias("id"),
        t.without_number_prefix(F.concat(F.lit("Title 12 "), "p_name"), "Title").alias("no_number"),
        t.single_or_mixed(part).alias("parties"),
        t.preview("p_name", 9).alias("head"),
        t.safe_key("p_type").alias("key"),
        t.restored_label(t.safe_key("p_type"), types).alias("label"),
        t.short_label(F.concat("p_brand", F.lit(" (main part)"))).alias("short"),
        t.no_nan(F.when(F.col("p_size") % 4 == 0, float("nan")).otherwise(F.col("p_retailprice"))).alias("number"),
    )


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS parsed, year(o_orderdate)::INT AS first_year, 2011 AS last_year, o_orderkey::VARCHAR || '.123457' AS usd,
    round(ln(1 + o_totalprice), 6) AS log1p, round(ln(o_totalprice), 6) AS log, round(exp(-o_totalprice / 100000), 6) AS exp, least(greatest(o_totalprice, 50000), 200000)::DOUBLE AS clipped,
    round(ln(least(greatest(o_totalprice / 400000, 0.000001), 0.999999) / (1 - least(greatest(o_totalprice / 400000, 0.000001), 0.999999))), 6) AS logit FROM orders""")
def dates_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English times, cited years, exact money rounded up, logarithms and clipping."""
    price = F.col("o_totalprice")
    written = F.lower(F.date_format("o_orderdate", "ddMMMyyyy HH:mm:ss"))
    cited = F.concat(F.lit("(Smith "), F.year("o_orderdate").cast("string"), F.lit("; Jones 2011)"))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(t.parsed_time(written), "yyyy-MM-dd HH:mm:ss").alias("parsed"), t.cited_year(cited).alias("first_year"), t.cited_year(cited, last=True).alias("last_year"),
        t.money(F.concat(F.col("o_orderkey").cast("string"), F.lit(".1234561"))).cast("string").alias("usd"),
        F.log1p(price).alias("log1p"), F.ln(price).alias("log"), F.exp(-price / 100000).alias("exp"), t.clipped(price, 50000.0, 200000.0).alias("clipped"), t.logit(price / 400000).alias("logit"),
    )
    return rounded(rows)


@query("""SELECT event_id, sha256('{"a":{"b":' || user_id || ',"c":"é"},"k":' || json_extract_string(props, '$.k') || '}') AS digest FROM events""")
def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a nested object doesn't depend on the order of its keys."""
    raw = F.concat(F.lit('{"k" : '), F.get_json_object("props", "$.k"), F.lit(', "a": {"c": "é", "b": '), F.col("user_id").cast("string"), F.lit("}}"))
    return table(spark, sf_dir, "events").select("event_id", F.sha2(t.canonical_json(raw), 256).alias("digest"))


@query("""WITH n AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey)
    SELECT n_regionkey, array_to_string(names[1:-2], ', ') || ' and ' || names[-1] AS said FROM n""")
def prose_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return names.select("n_regionkey", t.prose_list("names").alias("said"))


@query(f"""WITH {SQL_DECISIONS} SELECT task, count(*) AS items, min(CASE kind WHEN 'binary' THEN 'integer' WHEN 'score' THEN 'number' ELSE 'string' END) AS type, task AS required FROM items GROUP BY task""")
def answer_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON schema that each task's answers must have."""
    import json

    from .fixtures import TASKS, items

    schemas = [(task, json.dumps(b.answer_schema(kind, [task], LANGS))) for task, (_, kind) in TASKS.items()]
    rows = spark.createDataFrame(schemas, "task string, schema string")
    n = items(spark, sf_dir).groupBy("task").agg(F.count("*").alias("items"))
    field = F.get_json_object(F.col("schema"), "$.properties")
    return n.join(F.broadcast(rows), "task").select("task", "items", F.regexp_extract(field, '"type":"([a-z]+)"', 1).alias("type"), F.get_json_object("schema", "$.required[0]").alias("required"))


@query(f"""WITH {SQL_DECISIONS}, {SQL_MODELS} SELECT task, model, item_id, sha256(model || '|' || task || '|' || item_id) AS custom_id, octet_length(encode(gold)) AS prompt_bytes,
    CASE WHEN id % 9 = 0 THEN 'http 500' WHEN id % 9 = 1 THEN 'no content' END AS failure, CASE WHEN id % 9 > 1 THEN pred END AS content, CASE WHEN id % 9 > 1 THEN id % 100 END AS tokens FROM dec""")
def decoded_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with ids of their own, and provider answers decoded to rows; failures are rows too."""
    dec = decisions(spark, sf_dir).withColumn("user_content", F.col("gold"))
    asked = i.request_rows(dec)
    at = F.col("id") % 9
    message = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("pred").alias("content")).alias("message"))).alias("choices"), F.struct((F.col("id") % 100).alias("completion_tokens")).alias("usage")))
    body = F.when(at == 0, F.lit(None)).when(at == 1, '{"choices": []}').otherwise(message)
    found = i.decoded(asked.withColumn("status", F.when(at == 0, 500).otherwise(200)).withColumn("body", body))
    content = F.when(at > 1, F.col("content"))
    return found.select("task", "model", "item_id", "custom_id", "prompt_bytes", F.when(F.col("failure").isNotNull() & (at > 1), F.lit(None)).otherwise(F.col("failure")).alias("failure"), content.alias("content"), "tokens")


@query("""WITH x AS (SELECT l_shipmode, sum(CASE WHEN h >= 9 AND h < 17 THEN 2 ELSE 1 END * usd) AS usd, count(*) AS items FROM (SELECT l_returnflag AS l_shipmode, l_linenumber * 5 % 24 AS h, l_tax AS usd FROM lineitem) GROUP BY ALL)
    SELECT l_shipmode AS run, round(usd / items * 1000, 6) AS usd_per_1000 FROM x""")
def ledger_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger amounts per 1,000 items, twice as dear in the peak hours."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("run"), (F.col("l_linenumber") * 5 % 24).alias("hour"), F.col("l_tax").alias("usd"))
    return rounded(h.ledger_cost_per_1000(rows, "run", "hour", "usd", (9, 17), 2.0))


@query(f"""WITH {SQL_DECISIONS} SELECT task, count(*) AS requests, sum(octet_length(encode(gold)))::BIGINT AS prompt_bound, (count(*) * 64)::BIGINT AS output_bound,
    round((sum(octet_length(encode(gold))) * 3.0 + count(*) * 64 * 15.0) / 1000000 * 1.2, 6) AS usd_bound FROM dec GROUP BY task""")
def preflight_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds on tokens and cost before anything is sent: a token has a byte at least."""
    return rounded(h.preflight(decisions(spark, sf_dir).withColumn("user_content", F.col("gold")), 64, 3.0, 15.0, 1.2))


@query(f"""WITH {SQL_DECISIONS} SELECT task, model, count(*) AS items, count(DISTINCT gold) AS labels, round(avg((parse_error IS NOT NULL)::INT), 6) AS malformed, sum(id % 50)::BIGINT AS tokens, round(avg(CASE WHEN lower(pred) IN ('0', '5-low', 'es') THEN 1.0 ELSE 0 END) FILTER (pred IS NOT NULL), 6) AS neutral FROM dec GROUP BY task, model""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, malformed share, tokens and the share of neutral labels of each run."""
    rows = decisions(spark, sf_dir).withColumn("tokens", F.col("id") % 50)
    return rounded(s.run_summary(rows, ["task", "model"], neutral=("0", "5-low", "es")))


@query("""WITH r AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'update' WHEN 'click' THEN 'update' WHEN 'purchase' THEN 'finish' ELSE 'fail' END AS event, ts FROM events),
    l AS (SELECT user_id, max(ts) AS last_at, arg_max(event, (ts, event)) AS last_event, count(*) AS events FROM r GROUP BY user_id),
    b AS (SELECT *, CASE last_event WHEN 'start' THEN 'active' WHEN 'update' THEN 'active' WHEN 'finish' THEN 'completed' ELSE 'failed' END AS bucket FROM l)
    SELECT bucket, user_id, events, row_number() OVER (PARTITION BY bucket ORDER BY last_at DESC, user_id)::INT AS place FROM b QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY last_at DESC, user_id) <= 12""")
def run_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by the bucket of their last event, newest first; the events of the table stand for those of a run."""
    names = {"signup": "start", "view": "update", "click": "update", "purchase": "finish", "error": "fail"}
    rows = table(spark, sf_dir, "events").withColumn("event", F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("event_type")])
    return s.status_board(s.latest_runs(rows, "user_id", "ts", "event"), "user_id").select("bucket", "user_id", "events", "place")


@query(f"""WITH {SQL_DECISIONS}, c AS (SELECT task, model, count(*) FILTER (id % 10 = 0) AS pilot, avg((parse_error IS NOT NULL)::INT) FILTER (id % 10 = 0) AS rate, count(*) FILTER (id % 10 <> 0 AND model IN ('m1', 'm2')) AS rest FROM dec WHERE model <> 'm3' OR id % 10 <> 0 GROUP BY task, model)
    SELECT task, model, CASE WHEN pilot = 0 THEN 'pilot' WHEN rate > 0.05 THEN 'stopped' WHEN rest > 0 THEN 'done' ELSE 'remainder' END AS stage FROM c""")
def run_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each cell does next: pilot, then the gate on malformed answers, then the remainder."""
    dec = decisions(spark, sf_dir).filter("model <> 'm3' OR id % 10 <> 0").withColumn("pilot", F.col("id") % 10 == 0)
    dec = dec.filter("pilot OR model IN ('m1', 'm2', 'm3')").withColumn("done", ~F.col("pilot") & F.col("model").isin("m1", "m2"))
    return s.stages(dec, ["task", "model"], "pilot", "done", 0.05)


@query(f"""WITH {SQL_DECISIONS} SELECT task, model, sha256('model=' || model || '|panel=p1|task=' || task || '|temperature=0.1') AS fingerprint, count(*) AS rows FROM dec GROUP BY task, model""")
def cell_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of everything that changes a cell's result."""
    cell = decisions(spark, sf_dir).groupBy("task", "model").agg(F.count("*").alias("rows"))
    settings = {"model": F.col("model"), "task": F.col("task"), "panel": F.lit("p1"), "temperature": F.lit("0.1")}
    return cell.select("task", "model", s.fingerprint(settings).alias("fingerprint"), "rows")


@query("SELECT lang, count(*) AS docs, count(*) FILTER (doc_id % 5 <> 0) AS train, count(*) FILTER (doc_id % 5 = 0) AS test FROM documents GROUP BY lang")
def pool_and_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test rows are recovered by key; what is left is the pool, and no row is in both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    pool, test = s.pool_and_test(docs, docs.filter("doc_id % 5 = 0").select("doc_id"), ["doc_id"])
    rows = pool.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(F.col("part") == "train").alias("train"), F.count_if(F.col("part") == "test").alias("test"))


