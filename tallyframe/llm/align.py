"""Alignment of the tokens that two vocabularies give the same text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import in_turn, slices
from .bpe import SegmentTreeBPE
from .common import written

#: Entries of documents, a distinct pair of a document each, that one block holds: what a task gathers at once.
BLOCK = 1_500_000
#: Groups of more links than this are enumerated one by one, by distinct ids.
LARGE = 4_096
#: Runs of white space of this length overflow the stack of the tiktoken library; texts with one go to the encoder of ``bpe``.
_long_white = re.compile(r"\s{2000}").search

#: A group of tokens: up to the next byte at which tokens of both sides end.
_span = re.compile(rb"[^\x03]*\x03").findall
A_END, B_END, BOTH = 1, 2, 3


class _Sizes(dict):
    """The tokens of either side in a group, packed, from its labels."""

    def __missing__(self, span: bytes) -> int:
        found = ((span.count(A_END) + 1) << 32) + span.count(B_END) + 1
        if len(self) < 10_000:
            self[span] = found
        return found


@dataclass
class Aligned:
    """The tokens of some texts in a row, cut into groups: per text or group, numbers; per token, ids."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray  # by text
    n_b: np.ndarray
    n_groups: np.ndarray
    group_a: np.ndarray  # by group
    group_b: np.ndarray
    ends: np.ndarray  # of each group, in bytes from the start of its text


class Aligner:
    """Two vocabularies: byte-level BPE (A, which gets a space before the text) and pieces with byte fallback (B, which adds one)."""

    def __init__(self, bytes_path: str, pieces_path: str):
        self.bpe = SegmentTreeBPE(bytes_path, cache=10_000)
        ranks = {t: i for i, t in enumerate(self.bpe.tokens) if t and i not in self.bpe.special.values()}
        self.bpe.special, self.bpe.cut = {}, None  # their strings in texts are plain
        self.ranked = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.a_bytes = self.bpe.tokens
        self.b_bytes = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.a_size, self.b_size = len(self.a_bytes), len(self.b_bytes)
        self.a_lengths = np.fromiter(map(len, self.a_bytes), np.int64, self.a_size)
        self.b_lengths = np.fromiter(map(len, self.b_bytes), np.int64, self.b_size)
        self.fallback_bytes = self._fallback()
        self.sizes = _Sizes()
        self.written_ids = [f"{i}{mark}" for i in range(max(self.a_size, self.b_size)) for mark in ",|;"]

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def _fallback(self) -> np.ndarray:
        """For each code point, the byte pieces that stand for it: none if it is a piece itself, as all pieces are made of such."""
        point = np.arange(0x110000)
        out = (1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)).astype(np.uint8)
        out[[ord(p) for i in range(self.b_size) if len(p := self.pieces.id_to_piece(i)) == 1]] = 0
        out[ord(" ")] = 0
        return out

    def encode_bytes(self, text: str) -> np.ndarray:
        """The ids of side A of a text as it is."""
        if _long_white(text):
            return np.frombuffer(self.bpe.encode([text])[0], "<u4")
        return np.array(self.ranked.encode_ordinary(text), np.uint32)

    def align(self, texts: list[str | None]) -> Aligned:
        """Tokens and groups of each text; none for texts that are null, empty or not what its tokens' bytes say."""
        given = [t or "" for t in texts]
        none, a_all, b_all, size = np.empty(0, np.uint32), [], [], []
        a_found = [self.encode_bytes(" " + t) if t else none for t in given]
        b_found = self.pieces.encode(given, num_threads=1)
        for text, a, b in zip(given, a_found, b_found, strict=True):
            raw = b" " + text.encode() if text else b""
            same = b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw == b"".join(map(self.b_bytes.__getitem__, b))
            a_all.append(a if same else none)
            b_all.append(np.array(b, np.uint32) if same else none)
            size.append(len(raw) if same else 0)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a_all, b_all))
        a, b = (np.concatenate([none, *x]).astype(np.int64) for x in (a_all, b_all))
        stops = np.cumsum(np.array(size, np.int64))
        labels = np.zeros(int(stops[-1]) if len(stops) else 0, np.uint8)
        labels[np.cumsum(self.a_lengths[a]) - 1] = A_END
        labels[np.cumsum(self.b_lengths[b]) - 1] |= B_END
        spans = _span(labels.tobytes().translate(None, b"\0"))
        packed = np.fromiter(map(self.sizes.__getitem__, spans), np.int64, len(spans))
        both = np.flatnonzero(labels == BOTH)
        upto = np.searchsorted(both, stops)  # groups end with their texts
        n_groups = np.diff(upto, prepend=0)
        ends = both + 1 - np.repeat(stops - np.array(size, np.int64), n_groups)
        return Aligned(a, b, n_a, n_b, n_groups, packed >> 32, packed & 0xFFFFFFFF, ends)

    def links(self, found: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs of ids linked in each text, packed as ``a * b_size + b``, how often each, and their number by text."""
        a_start, b_start = np.cumsum(found.group_a) - found.group_a, np.cumsum(found.group_b) - found.group_b
        text = np.repeat(np.arange(len(found.n_groups)), found.n_groups)
        products = found.group_a * found.group_b
        width = self.a_size * self.b_size
        small = np.flatnonzero(products <= LARGE)
        n = products[small]
        group = np.repeat(small, n)
        at = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        row, column = np.divmod(at, found.group_b[group])
        keys = text[group] * width + found.a[a_start[group] + row] * self.b_size + found.b[b_start[group] + column]
        keys, times = np.unique(keys, return_counts=True)
        large_keys, large_times = [], []
        for g in np.flatnonzero(products > LARGE).tolist():
            left, n_left = np.unique(found.a[a_start[g] : a_start[g] + found.group_a[g]], return_counts=True)
            right, n_right = np.unique(found.b[b_start[g] : b_start[g] + found.group_b[g]], return_counts=True)
            large_keys.append((text[g] * width + left[:, None] * self.b_size + right).ravel())
            large_times.append((n_left[:, None] * n_right).ravel())
        if large_keys:
            keys, place = np.unique(np.concatenate([keys, *large_keys]), return_inverse=True)
            every = np.concatenate([times, *large_times])
            times = np.zeros(len(keys), np.int64)
            np.add.at(times, place, every)
        owner, pairs = np.divmod(keys, width)
        return pairs, times, np.bincount(owner, minlength=len(found.n_groups))

    def written(self, found: Aligned) -> list[str]:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3``."""
        a_start, b_start = np.cumsum(found.group_a) - found.group_a, np.cumsum(found.group_b) - found.group_b
        codes = np.empty(len(found.a) + len(found.b), np.int64)
        a_at = np.arange(len(found.a)) + np.repeat(b_start, found.group_a)
        b_at = np.arange(len(found.b)) + np.repeat(a_start + found.group_a, found.group_b)
        codes[a_at], codes[b_at] = found.a * 3, found.b * 3
        codes[a_start + b_start + found.group_a - 1] += 1
        codes[a_start + b_start + found.group_a + found.group_b - 1] += 2
        out, start = [], 0
        for n in (found.n_a + found.n_b).tolist():
            out.append("".join(map(self.written_ids.__getitem__, codes[start : start + n].tolist()))[:-1])
            start += n
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    """One for each pair of files and Python worker."""
    key = (bytes_path, pieces_path)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def align_texts(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The tokens of both sides and the groups into which common ends cut them.

    Returns ``id_col``, ``a_ids`` and ``b_ids``, and ``group_ends`` (bytes of a space and the text), ``group_a`` and ``group_b``
    (tokens of each side), one element a group. Texts that are null, empty, or whose tokens' bytes differ from a
    space and the text on either side, have no tokens. Rows are independent: null ids, repeated rows and an empty
    table need no special case, and other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(bytes_path, pieces_path)
        for batch in in_turn(batches):
            for at, texts in slices(batch.column(1)):
                x = work.align(texts)
                columns = [batch.column(0).slice(at, len(texts)), _lists(x.a, x.n_a, pa.int32()), _lists(x.b, x.n_b, pa.int32())]
                columns += [_lists(x.ends, x.n_groups, pa.int64()), _lists(x.group_a, x.n_groups, pa.int32()), _lists(x.group_b, x.n_groups, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a_ids", "b_ids", "group_ends", "group_a", "group_b"])

    kinds = "doc_id long, a_ids array<int>, b_ids array<int>, group_ends array<long>, group_a array<int>, group_b array<int>"
    return _rows(docs, id_col, text_col).mapInArrow(run, kinds).withColumnRenamed("doc_id", id_col)


_DOC = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "places": pa.list_(pa.int32()), "times": pa.list_(pa.int64())}
_PAIR = {"a": pa.int32(), "b": pa.int32(), "place": pa.int32(), "docs": pa.int64()}
_BLOCK_TYPE = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places array<int>, times array<long>, a int, b int, place int, docs long"


def _blocks(docs: DataFrame, bytes_path: str, pieces_path: str, block: int) -> DataFrame:
    """Rows of documents, whose links are places in the list of their block's distinct pairs, and rows of these lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(bytes_path, pieces_path)
        number = TaskContext.get().partitionId() << 32
        parts: list[tuple] = []
        for batch in in_turn(batches):
            for at, texts in slices(batch.column(1)):
                x = work.align(texts)
                pairs, times, n = work.links(x)
                products = np.concatenate([[0], np.cumsum(x.group_a * x.group_b)])
                ends = np.cumsum(x.n_groups)
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in work.written(x)]
                parts.append((batch.column(0).slice(at, len(texts)), x.n_a, x.n_b, x.n_groups, products[ends] - products[ends - x.n_groups], digests, pairs, times, n))
                if sum(len(p[6]) for p in parts) >= block:
                    yield from table(work, parts, number)
                    parts, number = [], number + 1
        if parts:
            yield from table(work, parts, number)

    def table(work: Aligner, parts: list[tuple], number: int) -> Iterator[pa.RecordBatch]:
        pairs, places, n_docs = np.unique(np.concatenate([p[6] for p in parts]), return_inverse=True, return_counts=True)
        start = 0
        for ids, *numbers, digests, _, times, n in parts:
            here = places[start : start + len(times)]
            start += len(times)
            columns = [pa.array(np.full(len(ids), number)), ids, *(pa.array(c, pa.int64()) for c in numbers), pa.array(digests)]
            columns += [_lists(here, n, pa.int32()), _lists(times, n, pa.int64()), *(pa.nulls(len(ids), k) for k in _PAIR.values())]
            yield pa.RecordBatch.from_arrays(columns, ["block", *_DOC, *_PAIR])
        a, b = np.divmod(pairs, work.b_size)
        for s in range(0, len(pairs), 100_000):
            cut = slice(s, s + 100_000)
            m = len(a[cut])
            columns = [pa.array(np.full(m, number)), *(pa.nulls(m, k) for k in _DOC.values())]
            columns += [pa.array(v, k) for v, k in zip((a[cut], b[cut], np.arange(s, s + m), n_docs[cut]), _PAIR.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["block", *_DOC, *_PAIR])

    return docs.mapInArrow(run, _BLOCK_TYPE)


def _counted(pairs: DataFrame) -> DataFrame:
    """Pairs of ids with the number of documents that hold them linked, and whether it is the highest of their A id."""
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))  # at most one row for each B id


def linked_ids(docs: DataFrame, bytes_path: str, pieces_path: str, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The pairs of ids ``a`` and ``b`` that share a group in some document, the ``count`` of such documents, and whether no
    other pair of that ``a`` has a higher one (``best``). Repeated rows count each; see ``align_texts`` for texts without tokens."""
    rows = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = _blocks(rows, bytes_path, pieces_path, block)
    return _counted(found.filter("a IS NOT NULL"))


def alignment(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """How the tokens of both sides meet in each document, and how common its links are in the corpus.

    Per byte, a label says whether a token of A, of B, of both or of neither ends there; a regular expression
    scans the labels for spans up to each byte where both end, and the labels in a span say how many tokens of
    each side form a group. Every token of A is linked with every one of B in its group.

    Returns ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair of ids is linked in no fewer documents
    than any other pair of its A id), ``count_sum`` (over links, the documents that hold the pair linked) and
    ``groups_sha256`` (of ``a1,a2|b1;...``, empty without tokens).

    Documents are dealt into blocks of ``block`` entries or a little more, each with the list of its distinct pairs. Only these lists
    are counted and joined with the counts, so a pair found in every document moves once for each block, and what
    comes back to a block is no larger than its list. A document with very long groups has as many entries as
    distinct pairs, which the definition asks for.

    Texts that are null, empty, or whose tokens' bytes differ from a space and the text have zeros and ''. Null ids
    and repeated rows are documents of their own; an empty table gives an empty result; other columns are dropped.
    """
    found = written(_blocks(_rows(docs, id_col, text_col), bytes_path, pieces_path, block), "aligned")
    pairs = found.filter("a IS NOT NULL").select("block", "place", "a", "b", "docs")
    known = pairs.join(_counted(pairs), ["a", "b"]).select(F.col("block").alias("of"), "place", "count", "best")
    rows = found.filter("a IS NULL").select("block", *_DOC)
    names = [c for c in _DOC if c not in ("places", "times")]

    def summed(rows: pa.Table, known: pa.Table) -> pa.Table:
        size = known.num_rows
        counts, best = np.zeros(size, np.int64), np.zeros(size, bool)
        at = known["place"].to_numpy()
        counts[at], best[at] = known["count"].to_numpy(), known["best"].to_numpy(zero_copy_only=False)
        n_best, count_sum = [], []
        for chunk in rows.select(["places", "times"]).to_batches():
            places, times = (np.asarray(c.flatten()) for c in chunk.columns)
            ends = np.cumsum(np.asarray(chunk.column(0).value_lengths()))
            for values, out in ((times * best[places], n_best), (times * counts[places], count_sum)):
                upto = np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], ends])]
                out.append(np.diff(upto))
        out = [rows[c] for c in names] + [pa.array(np.concatenate([np.empty(0, np.int64), *x]), pa.int64()) for x in (n_best, count_sum)]
        return pa.table(out, [*names, "n_best", "count_sum"])

    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    out = rows.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(summed, kinds)
    return out.withColumnRenamed("doc_id", id_col)
