"""Best-fit packing of token pieces with certified repacking.

Each partition packs its pieces by best-fit decreasing. Dual feasible functions give a lower bound on the
sequences that the same pieces need anywhere: a piece over ``capacity - a`` tokens counts as a whole
sequence, one under ``a`` as nothing, the others by their length. A partition that uses as many sequences as
its bound is certified and left alone. The others exchange the documents of their sequences with room: those
are dealt to new partitions, as few as hold them, and packed again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CACHE
from .common import discard, written
from .tokens import token_pieces

#: Pieces of one partition: what one task holds in memory.
PER_PARTITION = 16_384
#: A round that saves no larger share of the sequences in use has found nothing.
LEAST_SAVED = 1e-4


def lower_bound(lengths: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """The largest of the dual-feasible bounds over all ``a`` from 0 to half the capacity."""
    if counts is None:
        counts = np.bincount(lengths, minlength=capacity + 1)
    counts = counts.astype(np.int64)
    many = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])  # pieces of at least this length
    total = np.concatenate([np.cumsum((counts * np.arange(capacity + 1))[::-1])[::-1], [0]])
    a = np.arange(capacity // 2 + 1)
    whole = many[capacity - a + 1]
    part = total[a] - total[capacity - a + 1]
    return int(np.max(whole + -(-part // capacity)))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin and the offset of each length, and the room left in each bin."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []
    mask = 0  # bit r: a bin with room r is open
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(rooms)
            rooms.append(capacity)
        where[i], offset[i] = b, capacity - room
        room -= n
        rooms[b] = room
        if room:
            open_bins[room].append(b)
            mask |= 1 << room
    return where, offset, np.array(rooms, np.int64)


def _pack_partition(capacity: int, round_no: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "start"], ignore_index=True)
        lengths = rows["length"].to_numpy(np.int64)
        where, offset, rooms = best_fit_decreasing(lengths, capacity)
        base = (round_no << 50) + (int(rows["part"].iloc[0]) << 24)
        rows["sequence_id"], rows["offset"], rows["room"] = base + where, offset, rooms[where]
        rows["gap"] = len(rooms) - lower_bound(lengths, capacity)
        return rows

    return run


def pack_pieces(pieces: DataFrame, capacity: int, per_partition: int = PER_PARTITION) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a frame of ``doc_id, piece, start, length, ids_crc32``.

    The frame must be cheap to read again (a written table). Sequences hold at most ``capacity`` tokens
    and have no gaps before their end. First the partitions above their own bound exchange, and then, if the
    table is still above its bound (from the histogram of lengths, ``capacity`` rows at most), the certified
    ones too, as each may lose a part of a sequence. Either ends when one partition held all that is loose, or
    when two rounds in a row each save at most ``LEAST_SAVED`` of the sequences in use. Null ids and repeated
    rows are packed like others; an empty frame stays empty.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, sequence_id long, offset long, room long, gap long"
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["n"]
    bound, total = lower_bound(np.empty(0, np.int64), capacity, counts), int(counts.sum())

    def packed(rows: DataFrame, n: int, round_no: int) -> DataFrame:
        parts = max(1, -(-n // per_partition))
        keyed = rows.select(*columns, F.pmod(F.xxhash64("doc_id", "piece", F.lit(round_no)), F.lit(parts)).alias("part"))
        return written(keyed.groupBy("part").applyInPandas(_pack_partition(capacity, round_no), schema), f"packed{round_no}")

    def sequences(df: DataFrame) -> int:
        return df.filter("offset = 0").count()

    frames = [packed(pieces, total, 0)]
    used, round_no, idle, pooled = sequences(frames[0]), 0, 0, False
    while used > bound:
        round_no += 1
        loose = F.col("room") > 0 if pooled else (F.col("room") > 0) & (F.col("gap") > 0)
        taken = reduce(DataFrame.unionByName, (f.filter(loose) for f in frames))
        n = taken.count()
        saved = 0
        if n:
            again = packed(taken, n, round_no)
            saved = sequences(taken) - sequences(again)
            if saved >= 0:
                frames, used = [*(f.filter(~loose) for f in frames), again], used - saved
            else:  # another deal of the same pieces may need more
                discard(again)
        idle = 0 if saved > LEAST_SAVED * used else idle + 1
        if n <= per_partition or idle == 2:
            if pooled:
                break
            pooled, idle = True, 0
    out = reduce(DataFrame.unionByName, frames)
    return out.select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", per_partition: int = PER_PARTITION, cache: int = CACHE) -> DataFrame:
    """Encode whole documents, end each with ``end_id``, and pack them into sequences of ``capacity``.

    Only documents longer than a sequence are cut. Null texts count as empty and give the end id alone. Rows with a
    null id and repeated rows are packed like others; an empty table gives no pieces; other columns are dropped.
    """
    pieces = written(token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col, cache), "pieces")
    return pack_pieces(pieces, capacity, per_partition)
