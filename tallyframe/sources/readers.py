"""Readers with declared schemas: keys are never inferred, so an all-null column can't change its type."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv(spark: SparkSession, path: str, schema: str | T.StructType | None, sep: str = ",", encoding: str = "UTF-8", quote: str | None = '"') -> DataFrame:
    """CSV or TSV, also gzipped, with line breaks in quoted fields. ``quote=None`` takes quotes as text.

    Without a schema, types are inferred from all values.
    """
    reader = (spark.read.schema(schema).option("enforceSchema", False) if schema else spark.read.option("inferSchema", True)).option("header", True).option("sep", sep).option("encoding", encoding)
    reader = reader.option("quote", quote or "").option("escape", quote or "\\")
    return reader.option("multiLine", quote is not None).csv(path)


def csv_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Every column as text; an empty field is an empty text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).csv(path).fillna("")


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A whole file as one document or an array of records; ``source_file`` names it."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path).withColumn("source_file", F.col("_metadata.file_path"))


def keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A document that maps ids to values of type ``value``: a row for each id."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("key", "value"))


def ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only event file; a bad line stops the read and names it."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def zip_csv(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """A CSV member of zip files, unpacked on the executors."""
    names = T.StructType.fromDDL(schema).fieldNames()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
                    yield from pd.read_csv(f, dtype=str, keep_default_na=False, chunksize=10_000)

    text = ", ".join(f"`{n}` string" for n in names)
    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, text)
    return rows.select(*(F.nullif(F.col(f.name), F.lit("")).try_cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)))


def xml(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def job_accounting(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``JobID|JobName|State|Elapsed`` (seconds): whole jobs only, not their steps."""
    part = F.split("value", r"\|")
    rows = spark.read.text(path).select(*(part[i].alias(n) for i, n in enumerate(("job_id", "job_name", "state"))), part[3].try_cast("long").alias("elapsed_s"))
    return rows.filter("job_id <> 'JobID' AND NOT contains(job_id, '.') AND elapsed_s IS NOT NULL")


def predictions(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """All prediction files below a path; ``source`` is the folder of each file."""
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    return rows.withColumn("source", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1))


def panel(spark: SparkSession, path: str) -> DataFrame:
    """A frozen panel document: a row for each of its requests, gold as a map."""
    item = "struct<item_id: string, user_content: string, gt: map<string, string>>"
    doc = spark.read.schema(f"rows array<struct<task: string, item: {item}, pilot: boolean>>").option("multiLine", True).json(path)
    return doc.select(F.posexplode("rows").alias("pos", "r")).select("pos", "r.task", "r.item.item_id", "r.item.user_content", F.col("r.item.gt").alias("gold"), "r.pilot")


def trigger_sentences(events: DataFrame) -> DataFrame:
    """Nested event records: all sentences as one text, and the words of the first trigger's span."""
    words = F.flatten("sentences")
    span = F.get("triggers", F.lit(0))
    return events.select("*", F.array_join(words, " ").alias("text"), F.array_join(F.slice(words, span["start"] + 1, span["end"] - span["start"]), " ").alias("trigger"))


def manifests(folder: str, kind: str) -> list[dict]:
    """YAML or JSON manifests of a folder on the driver, checked and ordered by (order, name)."""
    import json

    try:
        import yaml

        load = yaml.safe_load
    except ImportError:
        load = json.loads
    out = []
    for p in sorted(Path(folder).glob("*.y*ml")) + sorted(Path(folder).glob("*.json")):
        spec = load(p.read_text(encoding="utf-8"))
        if not isinstance(spec, dict) or "name" not in spec:
            raise ValueError(f"{p.name}: a {kind} manifest needs a name")
        out.append(spec)
    names = [s["name"] for s in out]
    if len(set(names)) != len(names):
        raise ValueError(f"two {kind} manifests have one name")
    return sorted(out, key=lambda s: (s.get("order", 0), s["name"]))
