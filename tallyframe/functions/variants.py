"""Walks over VARIANT values of unknown depth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Levels that are unfolded before what is still nested is written and looked at again.
STEP = 3


def walk(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Every node of every row's VARIANT: ``key, path, name, kind, value``; array places are names in brackets, the root's name is null.

    Each level is unfolded by Spark's own explosion of variants, all rows at once; the walk ends when no row has a container left.
    """
    level = rows.select(F.col(key).alias("_key"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), F.col(value).alias("value"))
    kind = F.when(F.col("value").isNull(), "NULL").otherwise(F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0))
    out, depth = None, 0
    while True:
        level = level.withColumn("kind", kind)
        out = level if out is None else out.unionByName(level)
        depth += 1
        if depth % STEP == 0:
            level = written(level, "nodes")
            if level.filter("kind IN ('OBJECT', 'ARRAY')").isEmpty():
                break
        nested = level.filter("kind IN ('OBJECT', 'ARRAY')").select("_key", F.col("path").alias("_path"), F.col("value").alias("_value"))
        spread = nested.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_value").outer()))
        name = F.coalesce(F.col("key"), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = spread.select("_key", F.concat("_path", F.when(F.col("key").isNull(), "").otherwise("."), name).alias("path"), name.alias("name"), "value")
    return out.withColumnRenamed("_key", key)


def private_values(rows: DataFrame, key: str, value: str, names: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """Nodes that must not be published: ``key, path, reason``, for a forbidden ``name`` at any depth, or a text that holds a ``mark``.

    Names are compared in lower case and whole. Values that are null have no nodes below them.
    """
    nodes = walk(rows, key, value)
    text = F.when(F.col("kind") == "STRING", F.variant_get("value", "$", "string"))
    forbidden = F.col("kind").isNotNull() & F.lower("name").isin([n.lower() for n in names])
    hit = F.array_compact(F.array(*(F.when(F.contains(text, F.lit(m)), F.lit(m)) for m in marks)))
    reasons = F.concat(F.when(forbidden, F.array(F.concat(F.lit("name "), F.lower("name")))).otherwise(F.array().cast("array<string>")), F.transform(hit, lambda m: F.concat(F.lit("mark "), m)))
    return nodes.select(key, "path", F.explode(reasons).alias("reason"))
