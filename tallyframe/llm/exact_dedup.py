"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 8, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Group documents whose texts are identical after lower-casing A-Z; the largest id stays.

    Returns one row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Each task first combines its own copies, the groups of ``salts`` sets of tasks are merged, then their winners
    are combined. The whole normalised text is a grouping key at each of these stages. The last one also counts
    the different texts of each digest: where all that share a digest were found equal in content, the digest
    alone brings the winner back to its members, and whole texts need not move again. Members of a digest with
    several texts are matched by text. Adaptive execution splits a hot digest on the documents' side.

    A null text counts as empty. A null id is below every other id. Rows that repeat the kept id are all
    marked as kept and all count. An empty table gives an empty result; other columns are dropped.
    """
    norm = lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm"))
    rows = rows.select("_id", "_norm", F.sha2("_norm", 256).alias("_sha"), digest(F.col("_norm")).alias("_digest"))
    local = rows.select("_id", "_norm", "_digest", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"))
    merged = local.groupBy("_digest", "_norm", "_salt").agg(F.max("_id").alias("_keep"), F.count("*").alias("_n"))
    winners = merged.groupBy("_digest", "_norm").agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    found = winners.groupBy("_digest").agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"), F.count("*").alias("_texts"))
    found = written(found.filter("_n > 1"), "digests")
    sole = found.filter("_texts = 1").select("_digest", "_keep", "_n")
    several = found.filter("_texts > 1").select("_digest")
    if several.isEmpty():
        out = rows.select("_id", "_sha", "_digest").join(sole, "_digest", "left")
    else:
        out = rows.join(several, "_digest", "left_anti").select("_id", "_sha", "_digest").join(sole, "_digest", "left")
        apart = rows.join(winners.join(several, "_digest", "left_semi"), ["_digest", "_norm"])
        out = out.unionByName(apart.select("_digest", "_id", "_sha", "_keep", "_n"))
    keep = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return out.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
