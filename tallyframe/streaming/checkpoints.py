"""Checkpoints of a running job: answers are saved as they come, and a job that was killed goes on where it stopped.

A stream cuts the work into batches. Each batch is written under its number, so a batch that is run again after a failure
replaces what its first run left and adds nothing; Spark's own checkpoint says which batch is next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.reshape import SHARE, dealt

BATCH = "batch_id"


def save_batches(folder: str, after: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that writes each batch to its own folder below ``folder``; ``after`` sees what was saved."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{BATCH}={number}")
        if after:
            after(batch.sparkSession.read.schema(batch.schema).parquet(f"{folder}/rows/{BATCH}={number}"), number)

    return save


def run_in_batches(work: DataFrame, folder: str, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start the streaming ``work`` over all that is there now, or what an earlier run with this folder has left to do."""
    sink = work.writeStream.foreachBatch(save_batches(folder, after)).option("checkpointLocation", f"{folder}/progress")
    return sink.trigger(availableNow=True).start()


def saved_rows(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Everything saved so far, each row once, with the number of its batch."""
    return spark.read.schema(StructType([*schema.fields]).add(BATCH, "integer")).parquet(f"{folder}/rows")


def cell_progress(rows: DataFrame, panel: DataFrame, cell: tuple[str, ...] = ("task", "model"), key: str = "item_id") -> DataFrame:
    """How far each cell of the ``panel`` (cells and the keys that each must have) is: ``expected, saved, repeated, extra, complete, keys_sha256``.

    A cell is complete if it has exactly its keys, each once. The digest is of the saved keys in order, hashed one by one
    and added up, so that a cell of any size is never gathered. Keys of both sides are counted in one grouping, in tasks that grow
    with them.
    """
    names = [key, *cell]
    due = panel.select(*names, F.lit(1).alias("_d"), F.lit(0).alias("_s"))
    seen = rows.select(*names, F.lit(0).alias("_d"), F.lit(1).alias("_s"))
    sides = dealt(due.unionAll(seen), names, 10 * SHARE).groupBy(*names).agg(F.max("_d").alias("_d"), F.sum("_s").alias("_s"))
    both = sides.select(*names, F.when(F.col("_d") == 1, 1).alias("_due"), F.when(F.col("_s") > 0, F.col("_s")).alias("_n"))
    number = lambda part: F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), part, 8), 16, 10).cast("long")
    sums = [F.sum(F.when(F.col("_n").isNotNull(), number(1 + 8 * i))).alias(f"_h{i}") for i in range(8)]
    out = both.groupBy(*cell).agg(
        F.count("_due").alias("expected"), F.count_if(F.col("_due").isNotNull() & F.col("_n").isNotNull()).alias("saved"),
        F.count_if(F.col("_n") > 1).alias("repeated"), F.count_if(F.col("_due").isNull()).alias("extra"), *sums,
    )
    digest = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(f"_h{i}"), F.lit(0)).cast("string") for i in range(8))), 256)
    complete = (F.col("saved") == F.col("expected")) & (F.col("repeated") == 0) & (F.col("extra") == 0)
    return out.select(*cell, "expected", "saved", "repeated", "extra", complete.alias("complete"), digest.alias("keys_sha256"))
