"""Encode whole texts to token ids, decode them again, and cut them into pieces."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import in_turn, slices
from .bpe import CACHE, encoder


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each whole text.

    Returns ``id_col``, ``ids`` (array of int), ``n_tokens``, ``ids_sha256``, ``decoded`` and
    ``decoded_sha256``. A null text counts as empty and gives no ids. Strings of special tokens in a text
    become the special ids. Rows are independent: repeated rows, null ids and an empty table need no
    special case, and other columns of ``docs`` are dropped.
    """
    return _encoded(docs, vocabulary, id_col, text_col, True)


def token_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_texts``, with the digests and without ids and texts."""
    return _encoded(docs, vocabulary, id_col, text_col, False)


def _encoded(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, whole: bool) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in in_turn(batches):
            for a, texts in slices(batch.column(1)):
                ids, packed = batch.column(0).slice(a, len(texts)), bpe.encode(texts)
                back = [bpe.decode(p) for p in packed]
                out = {
                    "doc_id": ids,
                    "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()),
                    "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed],
                    "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in back],
                }
                if whole:
                    ends = [0]
                    for p in packed:
                        ends.append(ends[-1] + len(p) // 4)
                    flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(packed))])
                    out |= {"ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), "decoded": back}
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = rows.mapInArrow(run, schema + ", ids array<int>, decoded string" * whole)
    return out.withColumnRenamed("doc_id", id_col)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE) -> DataFrame:
    """Cut each document's ids and ``end_id`` into pieces of at most ``capacity`` tokens.

    Returns ``doc_id``, ``piece``, ``start``, ``length`` and ``ids_crc32``. Where the ids don't fill all
    pieces, the first one is shorter. A null or empty text gives one piece, the end id. Rows are independent:
    null ids and repeated rows need no special case, an empty table gives no pieces, and other columns are
    dropped. ``cache`` bounds what each worker remembers; it changes speed and memory, never results.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary, cache)
        for batch in in_turn(batches):
            for a, texts in slices(batch.column(1)):
                out: list[tuple] = []
                for doc, packed in zip(batch.column(0).slice(a, len(texts)).to_pylist(), bpe.encode(texts), strict=True):
                    packed += end
                    n = len(packed) // 4
                    start = 0
                    stop = n - capacity * ((n - 1) // capacity)
                    piece = 0
                    while start < n:
                        out.append((doc, piece, start, stop - start, zlib.crc32(packed[4 * start : 4 * stop])))
                        piece, start, stop = piece + 1, stop, stop + capacity
                names = ("doc_id", "piece", "start", "length", "ids_crc32")
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")
