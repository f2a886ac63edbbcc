"""Queries that write a table through a sink and read it back through a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers as r
from ..sources import sinks as k
from ..sources.shared import new_folder
from .fixtures import table
from .registry import query


def _text_file(rows: DataFrame, path: str) -> str:
    """Rows of one text column, a file for each partition."""
    rows.write.text(path)
    return path


@query("SELECT p_partkey::VARCHAR AS part, p_name, p_size, p_retailprice FROM part")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key stays text; the other columns have declared types."""
    path = new_folder(spark, "csv")
    k.write_csv(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_name", "p_size", "p_retailprice"), path)
    return r.csv(spark, path, "part string, p_name string, p_size int, p_retailprice double")


@query("SELECT o_orderkey::INT AS o_orderkey, o_orderstatus, o_totalprice FROM orders")
def csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types from all values of the file."""
    path = new_folder(spark, "csv")
    k.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    found = r.csv(spark, path, None)
    assert dict(found.dtypes) == {"o_orderkey": "int", "o_orderstatus": "string", "o_totalprice": "double"}
    return found


@query("SELECT p_partkey::VARCHAR AS part, CASE WHEN p_size % 3 = 0 THEN 'NA' WHEN p_size % 3 = 1 THEN '' ELSE p_size::VARCHAR END AS size FROM part")
def csv_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NA stays a text and an empty field an empty text."""
    size = F.when(F.col("p_size") % 3 == 0, "NA").when(F.col("p_size") % 3 == 2, F.col("p_size").cast("string"))
    path = new_folder(spark, "csv")
    k.write_csv(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), size.alias("size")), path)
    return r.csv_text(spark, path, ["part", "size"])


@query("""SELECT p_partkey::VARCHAR AS part, 'the "' || p_name || '" part, ' || p_brand AS text FROM part""")
def tsv_without_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tsv")
    text = F.concat(F.lit('the "'), "p_name", F.lit('" part, '), "p_brand")
    k.write_csv(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("part"), text.alias("text")), path, sep="\t", quote=None)
    return r.csv(spark, path, "part string, text string", sep="\t", quote=None)


@query("SELECT doc_id, text FROM documents WHERE lang = 'fr' AND n_chars > 0")
def latin1_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accents in one byte, and line breaks in quoted fields."""
    path = new_folder(spark, "latin1")
    rows = table(spark, sf_dir, "documents").filter("lang = 'fr' AND n_chars > 0").select("doc_id", "text")
    k.write_csv(rows, path, encoding="ISO-8859-1")
    return r.csv(spark, path, "doc_id long, text string", encoding="ISO-8859-1")


@query("SELECT p_partkey, printf('%.2f', p_retailprice) AS price FROM part")
def csv_fixed_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "csv")
    k.write_csv(table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price")), path, digits=2)
    return r.csv(spark, path, "p_partkey long, price string")


@query("SELECT lang, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM documents WHERE lang <> 'en' GROUP BY lang")
def partitioned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on the partition column reads those folders only."""
    path = new_folder(spark, "documents")
    k.write_table(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), path, partition_by=["lang"])
    return spark.read.parquet(path).filter("lang <> 'en'").groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query("""SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS event_type, user_id FROM events""")
def json_lines_without_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty fields aren't written, and come back as null; two appends make one log."""
    path = new_folder(spark, "log")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("event_type"), "user_id")
    for part in (rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1")):
        k.append_events(part, path)
    return r.json_lines(spark, path, "event_id long, event_type string, user_id long")


@query("SELECT event_id, event_type, user_id FROM events")
def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "ledger")
    table(spark, sf_dir, "events").select("event_id", "event_type", "user_id").write.json(path)
    return r.ledger(spark, path, "event_id long, event_type string, user_id long")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold one array of records each."""
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("part")).agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("value"))
    root = new_folder(spark, "documents")
    rows.write.partitionBy("part").text(root)
    found = r.json_document(spark, f"{root}/*", "n_nationkey int, n_name string, n_regionkey int")
    return found.select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT n_regionkey::VARCHAR AS key, count(*) AS names, min(n_name) AS first FROM nation GROUP BY n_regionkey")
def keyed_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document that maps ids to what their annotators said."""
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("key")).agg(F.struct(F.sort_array(F.collect_list("n_name")).alias("names")).alias("value"))
    doc = rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("value"))
    found = r.keyed_json(spark, _text_file(doc, new_folder(spark, "keyed")), "struct<names: array<string>>")
    return found.select("key", F.size("value.names").cast("long").alias("names"), F.col("value.names")[0].alias("first"))


@query("SELECT p_partkey, p_name || ' ' || p_brand AS text, split_part(p_name, ' ', 1) AS trigger FROM part")
def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records of sentences and trigger spans, written as JSON lines."""
    words = F.split("p_name", " ")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(words, F.array("p_brand")).alias("sentences"), F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end")), F.struct(F.lit(1).alias("start"), F.lit(2).alias("end"))).alias("triggers"))
    path = new_folder(spark, "nested")
    rows.write.json(path)
    nested = r.json_lines(spark, path, "p_partkey long, sentences array<array<string>>, triggers array<struct<start: int, end: int>>")
    return r.trigger_sentences(nested).select("p_partkey", "text", "trigger")


@query("SELECT o_orderkey::VARCHAR AS job_id, o_orderpriority AS job_name, o_orderstatus AS state, (o_totalprice::BIGINT % 900 + 60)::BIGINT AS elapsed_s FROM orders")
def accounting_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe-delimited lines of jobs and their steps; only whole jobs are read."""
    seconds = (F.rint("o_totalprice").cast("long") % 900 + 60).cast("string")
    line = lambda job: F.concat_ws("|", job, "o_orderpriority", "o_orderstatus", seconds)
    key = F.col("o_orderkey").cast("string")
    rows = table(spark, sf_dir, "orders").select(F.explode(F.array(line(key), line(F.concat(key, F.lit(".batch"))))).alias("value"))
    return r.job_accounting(spark, _text_file(rows, new_folder(spark, "jobs")))


@query("SELECT n_nationkey::VARCHAR AS item_id, 'region' || n_regionkey AS task, n_name AS user_content, n_regionkey::VARCHAR AS gold, n_nationkey % 5 = 0 AS pilot FROM nation")
def panel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frozen panel: one document with all requests."""
    item = F.struct(F.col("n_nationkey").cast("string").alias("item_id"), F.col("n_name").alias("user_content"), F.create_map(F.lit("y"), F.col("n_regionkey").cast("string")).alias("gt"))
    row = F.struct(F.concat(F.lit("region"), "n_regionkey").alias("task"), item.alias("item"), (F.col("n_nationkey") % 5 == 0).alias("pilot"))
    doc = table(spark, sf_dir, "nation").agg(F.to_json(F.struct(F.collect_list(row).alias("rows"))).alias("value"))
    return r.panel(spark, _text_file(doc, new_folder(spark, "panel"))).select("item_id", "task", "user_content", F.col("gold")["y"].alias("gold"), "pilot")


@query("SELECT CASE n_regionkey % 3 WHEN 0 THEN 'canonical' WHEN 1 THEN 'sidecar' ELSE 'archive' END AS source, n_nationkey, n_name FROM nation")
def prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below one folder, labelled by the role that their own folder has."""
    root, rows = new_folder(spark, "predictions"), table(spark, sf_dir, "nation")
    for i, role in enumerate(("canonical", "sidecar", "archive")):
        k.write_csv(rows.filter(F.col("n_regionkey") % 3 == i).select("n_nationkey", "n_name"), f"{root}/{role}")
    return r.predictions(spark, root, "n_nationkey int, n_name string").select("source", "n_nationkey", "n_name")


@query("SELECT 'kept' AS outcome, count(*) AS rows FROM part UNION ALL SELECT 'refused', 1 UNION ALL SELECT 'sidecar only', 1")
def guarded_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second write to a path of record is refused and changes nothing; so is a sidecar below it."""
    path, refused = new_folder(spark, "release"), 0
    k.write_table(table(spark, sf_dir, "part"), path)
    for attempt in (lambda: k.write_table(table(spark, sf_dir, "nation"), path), lambda: k.require_sidecar(f"{path}/x", [path])):
        try:
            attempt()
        except Exception:  # noqa: BLE001
            refused += 1
    kept = spark.read.parquet(path).agg(F.lit("kept").alias("outcome"), F.count("*").alias("rows"))
    return kept.unionByName(spark.range(refused).select(F.when(F.col("id") == 0, "refused").otherwise("sidecar only").alias("outcome"), F.lit(1).cast("long").alias("rows")))


@query("SELECT doc_id, lang, n_chars FROM documents")
def merged_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four shards that cover the documents exactly; only named columns leave."""
    docs = table(spark, sf_dir, "documents")
    shards = [docs.filter(F.col("doc_id") % 4 == i) for i in range(4)]
    return k.exported(k.merged_shards(shards, ["doc_id"], expected=docs), ["doc_id", "lang", "n_chars", "secret"])
