"""Line deduplication: lines that many documents share stay in one of them only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, lower_ascii, written


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 10, least_docs: int = 2) -> DataFrame:
    """Drop lines whose key is found in at least ``least_docs`` documents, but for the smallest id.

    Returns one row per input row: ``id_col``, ``n_lines``, ``n_dropped``, ``kept_text``.

    A line's key is the line without white space at its ends, with A-Z lower-cased; shorter keys than
    ``least_chars`` code points are never dropped. Keys are hashed (128 bits), documents are counted per
    hash with partial aggregation, and the positions to drop come back by document. A very common line
    sits on the side of the join that adaptive execution splits.

    A null or empty text is one empty line. Lines of rows with a null id are counted as one document and
    never dropped. Repeated rows are one document, and each of them keeps or loses the same lines. An
    empty table gives an empty result; other columns are dropped.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    key = lambda x: lower_ascii(F.btrim(x, F.lit(SPACE)))
    hashed = lambda k: F.when(F.length(k) >= least_chars, F.unhex(F.md5(k)))
    lines = F.split("_text", "\n", -1)
    with_hash = written(rows.select("_id", F.xxhash64("_text").alias("_version"), F.transform(F.transform(lines, key), hashed).alias("_hashes")), "lines")
    each = with_hash.select("_id", F.explode(F.array_distinct(F.filter("_hashes", lambda h: h.isNotNull()))).alias("_hash"))
    pairs = each.groupBy("_hash", "_id").agg(F.lit(1).alias("_one"))
    common = pairs.groupBy("_hash").agg(F.count("*").alias("_docs"), F.min("_id").alias("_first")).filter(F.col("_docs") >= least_docs)
    common = written(common, "common")  # so that the join can split a very common line
    places = with_hash.select("_id", "_version", F.posexplode("_hashes").alias("_at", "_hash")).filter("_hash IS NOT NULL AND _id IS NOT NULL")
    lost = places.join(common, "_hash").filter("_id <> _first")
    lost = lost.groupBy("_id", "_version").agg(F.collect_set("_at").alias("_lost"))
    lost = lost.select(F.col("_id").alias("_lost_id"), F.col("_version").alias("_lost_version"), "_lost")
    out = rows.withColumn("_version", F.xxhash64("_text")).join(lost, (F.col("_id") == F.col("_lost_id")) & (F.col("_version") == F.col("_lost_version")), "left")
    n_lines = F.size(lines)
    stay = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("_lost"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n")
    return out.withColumn("_lines", lines).select(
        F.col("_id").alias(id_col),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("_lost"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_lost").isNull(), F.col("_text")).otherwise(kept).alias("kept_text"),
    )
