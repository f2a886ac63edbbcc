"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_BLOCKS: list[list[DataFrame]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(text, UPPER, UPPER.lower())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    This cuts the lineage, so a lost executor costs a re-read and not a re-computation. The folder stays until
    ``discard``, or until the end of the ``scratch`` block around the call unless ``keep`` is set.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    if _BLOCKS and not keep:
        _BLOCKS[-1].append(out)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the folders of written frames that nothing reads any more; other frames are left alone."""
    for df in frames:
        if path := _PATHS.pop(df, None):
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Delete what operators write inside the block at its end; results must be written or read before."""
    block: list[DataFrame] = []
    _BLOCKS.append(block)
    try:
        yield
    finally:
        _BLOCKS.remove(block)
        discard(*block)


def with_text(docs: DataFrame, names: list[str], text_col: str) -> tuple[DataFrame, int]:
    """The named columns and the text, which goes once if it is among them, and the text's place."""
    if text_col in names and dict(docs.dtypes)[text_col] == "string":
        return docs.select(*names), names.index(text_col)
    return docs.select(*names, F.col(text_col).cast("string").alias("_text")), len(names)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
