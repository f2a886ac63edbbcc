"""Counts by cell of every replicate when units with few patterns of rows are drawn: the units move, the draws don't.

A unit's rows, such as the answers of all models to an item, are a pattern, and tasks of millions of units have few patterns. A unit becomes
the two-byte code of its pattern, at its place. Every group of replicates gets the codes, makes its own draws, and looks up and
counts them where they are made, so nothing but counts of patterns leaves a replicate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written
from .draws import CHUNK, SLOTS, weighted_sums
from .numbering import placed

#: Patterns that a task may have to be counted by codes; one with more has its draws moved by ``weighted_sums``.
PATTERNS = 1 << 12
#: Places whose codes are in memory at once; each further such segment of a task makes the draws again.
SEGMENT = 1 << 27
#: Groups of replicates for each core.
WAVES = 4


def _counts(seed: str, task: str, mine: range, n: int, patterns: int, low: int, codes: np.ndarray, chunk: int) -> np.ndarray:
    """How often each replicate of ``mine`` draws each code, of the places from ``low`` on that have codes."""
    out = np.zeros((len(mine), patterns), np.int64)
    digests, sha256 = -(-n // SLOTS), hashlib.sha256
    whole = len(codes) == n
    for first in range(0, digests, chunk):
        ends = [b"%d" % c for c in range(first, min(first + chunk, digests))]
        for i, b in enumerate(mine):
            start = f"{seed}|{task}|{b}|".encode()
            raw = b"".join([sha256(start + e).digest() for e in ends])
            drawn = np.frombuffer(raw, ">u4")[: n - first * SLOTS].astype(np.int64)
            places = drawn - drawn // n * n
            if not whole:
                places = places[(places >= low) & (places < low + len(codes))] - low
            out[i] += np.bincount(codes[places], minlength=patterns)
    return out


def replicate_counts(rows: DataFrame, iterations: int, seed: str, task: str, unit: str, by: Sequence[str], most: int = PATTERNS, segment: int = SEGMENT, chunk: int = CHUNK) -> DataFrame:
    """Rows of each cell ``by`` in every replicate, when a task's units are drawn with all their rows: ``task, by, b, w``.

    Units have a place in their task by the column ``unit``, and draws are those of ``weighted_sums``. Cells that a replicate doesn't draw may be left out.
    """
    rows = rows.select(F.col(task).cast("string").alias("_task"), F.col(unit).alias("_unit"), *by)
    # a pattern is known by its size and two sums of hashes over its rows, of 44 bits so that sums can't overflow
    parts = [x for c in by for x in (F.col(c), F.col(c).isNull())]
    mark = lambda salt: F.sum(F.shiftright(F.xxhash64(F.lit(salt), *parts), 20))
    units = rows.groupBy("_task", "_unit").agg(mark(1).alias("_x"), mark(2).alias("_y"), F.count("*").alias("_z"))
    pattern = ["_task", "_x", "_y", "_z"]
    units = units.repartitionByRange("_task", "_unit").sortWithinPartitions("_task", "_unit")
    units = written(units.withColumn("_row", F.monotonically_increasing_id()), "units")
    patterns = written(units.groupBy(*pattern).agg(F.min("_unit").alias("_unit"), F.count("*").alias("_n")), "patterns")
    sizes = patterns.groupBy("_task").agg(F.sum("_n").alias("_size"), F.count("*").alias("_patterns"))
    wide = [r["_task"] for r in sizes.filter(F.col("_patterns") > most).collect()]  # names of tasks

    code = F.row_number().over(W.partitionBy("_task").orderBy(*pattern[1:])) - 1
    few = patterns.join(F.broadcast(sizes.filter(F.col("_patterns") <= most)), "_task").withColumn("_code", code)
    blocks = written(units.join(F.broadcast(few.select(*pattern, "_code")), pattern).select("_task", "_row", "_code").mapInArrow(_blocks, "_task string, _row long, _n int, _codes binary"), "codes")
    starts = blocks.select("_task", "_row", (F.sum("_n").over(W.partitionBy("_task").orderBy("_row")) - F.col("_n")).alias("_start"))
    groups = min(iterations, WAVES * rows.sparkSession.sparkContext.defaultParallelism)
    dealt = blocks.join(starts, ["_task", "_row"]).join(F.broadcast(sizes), "_task")
    dealt = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"), "_task", "_start", "_size", "_patterns", "_codes")
    dealt = dealt.repartitionById(groups, F.col("_group")).sortWithinPartitions("_group", "_task", "_start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for group, name, start, size, n_patterns, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key and key != (group, name, size, n_patterns, start // segment):
                    yield from counted(*key, held)
                    held = []
                key = group, name, size, n_patterns, start // segment
                held.append((start, codes))
        if key:
            yield from counted(*key, held)

    def counted(group: int, name: str, size: int, n_patterns: int, _: int, held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        mine = range(group + 1, iterations + 1, groups)
        codes = np.frombuffer(b"".join([c for _, c in held]), "<u2")
        out = _counts(seed, name, mine, size, n_patterns, held[0][0], codes, chunk)
        for b, w in zip(mine, out, strict=True):
            found = np.flatnonzero(w)
            columns = [pa.repeat(pa.scalar(name), len(found)), pa.repeat(pa.scalar(b, pa.int32()), len(found)), pa.array(found, pa.int32()), pa.array(w[found])]
            yield pa.RecordBatch.from_arrays(columns, ["_task", "b", "_code", "_w"])

    counts = dealt.mapInArrow(run, "_task string, b int, _code int, _w long")
    entries = rows.join(F.broadcast(few.select("_task", "_unit", "_code")), ["_task", "_unit"]).groupBy("_task", "_code", *by).agg(F.count("*").alias("_k"))
    out = counts.join(F.broadcast(entries), ["_task", "_code"]).groupBy("_task", *by, "b").agg(F.sum(F.col("_w") * F.col("_k")).cast("double").alias("w"))
    out = out.withColumnRenamed("_task", task)
    if not wide:
        return out
    rows = rows.filter(F.col("_task").isin(wide))
    places = placed(rows.select("_task", "_unit").distinct(), ["_unit"], by=["_task"])
    sizes = places.groupBy(F.col("_task").alias("task")).agg(F.count("*").alias("n"))
    moved = weighted_sums(rows.join(places, ["_task", "_unit"]).withColumnRenamed("_task", task), sizes, iterations, seed, task, "pos", by, {"w": F.lit(1.0)}, chunk)
    return out.unionByName(moved.filter("w > 0"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The codes of neighbouring rows of a task, in one value for each run of row numbers."""
    for batch in batches:
        row, code = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype("<u2")
        task = batch.column(0).dictionary_encode()
        at = task.indices.to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(row) != 1) | (np.diff(at) != 0)) + 1).tolist(), len(row)]
        runs = list(zip(cuts, cuts[1:], strict=False)) if len(row) else []
        names = task.dictionary.to_pylist()
        columns = [pa.array([names[at[x]] for x, _ in runs], pa.string()), pa.array([row[x] for x, _ in runs], pa.int64()), pa.array([y - x for x, y in runs], pa.int32()), pa.array([code[x:y].tobytes() for x, y in runs], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["_task", "_row", "_n", "_codes"])
