"""Sums under the weights of many replicates: items move once, and draws move as two bytes each.

The places of a task are cut into blocks. A replicate's draws that fall into a block are one short binary value, and meet the
block's items in one sorted stream. There they become a vector of weights by place, which is multiplied into the items' values and summed
by cell; a task of Spark adds the vectors of all its blocks before anything moves again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Slots that one digest serves.
SLOTS = 8
#: Places of a block; an offset in it fits in two bytes.
BLOCK = 1 << 13
#: Digests of a replicate that one row of draws stands for before they are made.
CHUNK = 1 << 15


def _draw(seed: str, task: str, b: int, first: int, n: int, chunk: int) -> np.ndarray:
    """The places that a run of slots draws, in order of place."""
    last = min(first + chunk, -(-n // SLOTS))
    start = f"{seed}|{task}|{b}|"
    raw = b"".join([hashlib.sha256(f"{start}{c}".encode()).digest() for c in range(first, last)])
    places = np.frombuffer(raw, ">u4")[: n - first * SLOTS].astype(np.int64) % n
    places.sort()
    return places


def block_draws(sizes: DataFrame, iterations: int, seed: str, chunk: int = CHUNK) -> DataFrame:
    """The draws of each replicate by block: ``task, block, b, offsets``, the places in the block as two bytes each."""
    parts = sizes.sparkSession.sparkContext.defaultParallelism
    rows = sizes.select(F.col("task").cast("string").alias("task"), F.col("n").cast("long").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("b"))
    rows = rows.select("task", "n", "b", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1), F.lit(chunk * SLOTS).cast("long"))).alias("slot")).repartition(parts, "task", "b", "slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for task, n, b, slot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places = _draw(seed, task, b, slot // SLOTS, n, chunk)
                block, offset = places // BLOCK, (places % BLOCK).astype("<u2")
                cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(places)]
                out += [(task, int(block[x]), b, offset[x:y].tobytes()) for x, y in zip(cuts, cuts[1:], strict=False)]
                if len(out) > 500:
                    yield _draws(out)
                    out = []
            if out:
                yield _draws(out)

    return rows.mapInArrow(run, "task string, block long, b int, offsets binary")


def _draws(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["task", "block", "b", "offsets"])


class _Sums:
    """Sums by cell and replicate of one task's items."""

    def __init__(self, iterations: int, width: int):
        self.cells: dict[tuple, int] = {}
        self.sums = np.zeros((iterations, 8, width))

    def places(self, keys: list[tuple]) -> np.ndarray:
        for k in keys:
            self.cells.setdefault(k, len(self.cells))
        while len(self.cells) > self.sums.shape[1]:
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)], 1)
        return np.array([self.cells[k] for k in keys])


def weighted_sums(rows: DataFrame, sizes: DataFrame, iterations: int, seed: str, task: str, pos: str, by: Sequence[str], values: Mapping[str, Column], chunk: int = CHUNK) -> DataFrame:
    """Sums of ``values`` by task, ``by`` and replicate, each row as often as its place is drawn: ``task, by, b`` and the sums.

    ``rows`` has a ``task`` and a place ``pos`` from 0 to the task's ``n`` less 1 in ``sizes`` (task, n); several rows may share a place, such as the
    answers of several models to an item, and then share its draws. Values must not be null. Cells that a replicate
    doesn't draw have zeros. A task of Spark holds the sums of one task's cells: there should be no more of these than labels or models make.
    """
    kinds = [rows.schema[c].dataType for c in by]
    items = rows.select(
        F.col(task).cast("string").alias("_task"),
        F.shiftright(F.col(pos).cast("long"), 13).alias("_block"),
        (F.col(pos) % BLOCK).cast("int").alias("_at"),
        *(F.col(c).alias(f"_c{i}") for i, c in enumerate(by)),
        *(v.cast("double").alias(f"_v{i}") for i, v in enumerate(values.values())),
    )
    drawn = block_draws(sizes, iterations, seed, chunk).toDF("_task", "_block", "_b", "_offsets")
    both = items.unionByName(drawn, allowMissingColumns=True).repartition("_task", "_block").sortWithinPartitions("_task", "_block", "_b")
    both = both.select("_task", "_block", "_b", "_offsets", "_at", *(f"_c{i}" for i in range(len(by))), *(f"_v{i}" for i in range(len(values))))
    width, k = len(values), len(by)
    schema = T.StructType([T.StructField("_task", T.StringType()), T.StructField("b", T.IntegerType()), *(T.StructField(f"_c{i}", t) for i, t in enumerate(kinds)), *(T.StructField(f"_v{i}", T.DoubleType()) for i in range(width))])
    arrow = [f.type for f in _arrow(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = block = sums = ready = None
        pending: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != name:
                    if sums:
                        yield from flat(name, sums)
                    name, block, sums = row[0], None, _Sums(iterations, width)
                if row[1] != block:
                    block, ready, pending = row[1], None, []
                if row[2] is None:
                    pending.append(row[4:])
                    continue
                if not pending:
                    continue
                if ready is None:
                    order = {c: i for i, c in enumerate(dict.fromkeys(r[1 : 1 + k] for r in pending))}
                    cell = np.fromiter((order[r[1 : 1 + k]] for r in pending), np.int64, len(pending))
                    sort = np.argsort(cell, kind="stable")
                    at = np.fromiter((r[0] for r in pending), np.int64, len(pending))[sort]
                    v = np.array([r[1 + k :] for r in pending])[sort]
                    starts = np.searchsorted(cell[sort], np.arange(len(order)))
                    ready = sums.places(list(order)), at, v, starts
                places, at, v, starts = ready
                weight = np.bincount(np.frombuffer(row[3], "<u2"), minlength=BLOCK)[at]
                sums.sums[row[2] - 1, places] += np.add.reduceat(weight[:, None] * v, starts, 0)
        if sums:
            yield from flat(name, sums)

    def flat(name: str, sums: _Sums) -> Iterator[pa.RecordBatch]:
        b = pa.array(np.arange(1, iterations + 1), pa.int32())
        for key, i in sums.cells.items():
            columns = [pa.repeat(pa.scalar(name, pa.string()), iterations), b]
            columns += [pa.repeat(pa.scalar(x, t), iterations) for x, t in zip(key, arrow[2:], strict=False)]
            columns += [pa.array(sums.sums[:, i, j]) for j in range(width)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    out = both.mapInArrow(run, schema).groupBy("_task", *(f"_c{i}" for i in range(k)), "b").agg(*(F.sum(f"_v{i}").alias(v) for i, v in enumerate(values)))
    named = [F.col(f"_c{i}").alias(c) for i, c in enumerate(by)]
    return out.select(*([] if task in by or task.startswith("_") else [F.col("_task").alias(task)]), *named, "b", *values)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
