"""Jobs that save as they go, calls side by side, members of archives and walks over nested values."""

from __future__ import annotations

import random
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.variants import private_values
from ..operators.concurrent import Retryable, answer_concurrently
from ..sources.archives import write_zips, zip_csv
from ..sources.shared import new_folder
from ..streaming.checkpoints import cell_progress, run_in_batches, saved_rows
from .fixtures import SQL_DECISIONS, answers, decisions, items_apart, table
from .registry import query


@query(f"""WITH {SQL_DECISIONS} SELECT task, model, count(*) AS expected, count(*) AS saved, 0::BIGINT AS repeated, 0::BIGINT AS extra, true AS complete FROM dec GROUP BY ALL""")
def saved_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All answers, put down as files and saved batch by batch by a stream; how far each cell has come."""
    folder = new_folder(spark, "answers")
    rows = decisions(spark, sf_dir).select("task", "model", "item_id", "pred", "parse_error")
    answers(items_apart(spark, sf_dir)).select(*rows.columns).write.parquet(f"{folder}/in")
    files = len(spark.read.parquet(f"{folder}/in").inputFiles())
    work = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(f"{folder}/in")  # three batches
    run_in_batches(work, f"{folder}/out").awaitTermination()
    return cell_progress(saved_rows(spark, f"{folder}/out", rows.schema), rows).drop("keys_sha256")


def hesitant_client():  # noqa: ANN201
    """Answers with the text's first word; one in ten texts is turned away once, and one in fifty for good."""
    seen: set[str] = set()

    def call(model: str, system: str, text: str) -> str:
        number = int(text.rpartition(" ")[2])
        time.sleep(random.random() / 2000)
        if number % 50 == 7:
            raise ValueError("refused")
        if number % 10 == 3 and text not in seen:
            seen.add(text)
            raise Retryable("busy", 0.001)
        return text.split(" ")[0]

    return call


@query("SELECT 'first_word' AS task, 'm1' AS model, o_orderkey::VARCHAR AS item_id, CASE WHEN o_orderkey % 50 <> 7 THEN string_split(o_orderpriority, ' ')[1] END AS raw_content, CASE WHEN o_orderkey % 50 = 7 THEN 'ValueError: refused' END AS parse_error FROM orders")
def concurrent_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls side by side: repeated where the failure passes, errors as rows."""
    rows = table(spark, sf_dir, "orders").select(F.lit("first_word").alias("task"), F.lit("m1").alias("model"), F.col("o_orderkey").cast("string").alias("item_id"), F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("user_content"))
    return answer_concurrently(rows, hesitant_client, open_calls=16, first_wait=0.001).drop("latency_s")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 9 <> 4 THEN p_size::BIGINT END AS p_size, p_name, 'data/' || replace(p_brand, '#', '') || '.csv' AS member, CASE WHEN p_partkey % 9 = 4 THEN 'p_size' ELSE '' END AS bad FROM part""")
def archived_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts put into archives by brand and read back, a member to a task; sizes spelt as words are reported."""
    folder = new_folder(spark, "archives")
    size = F.when(F.col("p_partkey") % 9 == 4, "large, very").otherwise(F.col("p_size").cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", size.alias("p_size"), "p_name", F.replace("p_brand", F.lit("#"), F.lit("")).alias("brand"))
    write_zips(rows.repartition(3, "brand"), folder, "brand", ["p_partkey", "p_size", "p_name"])
    found = zip_csv(spark, folder, "data/*.csv", "p_partkey long, p_size int, p_name string")
    return found.select("p_partkey", F.col("p_size").cast("long").alias("p_size"), "p_name", "member", F.array_join("bad", ",").alias("bad"))


@query("""WITH e AS (SELECT event_id, event_id % 4 AS depth FROM events),
    p AS (SELECT event_id, '$' || repeat('.in[1]', depth::INT) AS place FROM e)
    SELECT event_id, place || '.Token' AS path, 'name token' AS reason FROM p WHERE event_id % 7 = 0
    UNION ALL SELECT event_id, place || '.log', 'mark /home/' FROM p WHERE event_id % 11 = 0
    UNION ALL SELECT event_id, place || '.props.k', 'name k' FROM p JOIN events USING (event_id) WHERE json_extract(props, '$.k') IS NOT NULL""")
def private_event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties inside lists and objects of several depths: forbidden names and marks at any of them."""
    e = F.col("event_id")
    token, log = F.when(e % 7 == 0, F.lit(',"Token":"t"')).otherwise(""), F.when(e % 11 == 0, F.lit(',"log":"see /home/u"')).otherwise(',"log":"fine"')
    body = F.concat(F.lit('{"props":'), F.coalesce("props", F.lit("null")), token, log, F.lit("}"))
    for depth in range(1, 4):
        body = F.when(e % 4 >= depth, F.concat(F.lit('{"in":[0,'), body, F.lit("]}"))).otherwise(body)
    rows = table(spark, sf_dir, "events").select("event_id", F.try_parse_json(body).alias("value"))
    return private_values(rows, "event_id", "value", ["token", "k"], ["/home/", "sk-"])
