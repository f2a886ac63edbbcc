"""Byte-level BPE encoding with a segment tree over the ranks of adjacent pairs.

Each leaf of the tree holds ``rank * width + position`` of the pair that starts at that position, or a
value above all others where no merge applies. The root is then the leftmost pair of lowest rank. A merge
changes three leaves (the pair before, the new pair and the one that went), and each change costs the
height of the tree. Short words are merged many at a time, one tree per row of a matrix; a long word has
a tree of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import regex

#: Unicode's White_Space characters.
WHITE = r"\t-\r \x85\xa0  -     　"
#: The pre-tokens of the byte-level vocabulary, with the white space class spelt out.
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
NONE = np.int64(1) << 62
MARKS = ".,;:!?"


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SegmentTreeBPE:
    """Encoder and decoder for a byte-level vocabulary file.

    ``cache`` bounds the words and chunks remembered between calls; it changes speed, never results.
    """

    def __init__(self, path: str, cache: int = 700_000, widest: int = 64):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte, vocab = printable_bytes(), spec["model"]["vocab"]
        as_bytes = lambda token: bytes(to_byte[c] for c in token)
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.tokens = [b""] * size
        for token, i in vocab.items():
            self.tokens[i] = as_bytes(token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        self.byte_id = np.array([vocab[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.size = size
        self.rank = {vocab[a] * size + vocab[b]: (r, vocab[a + b]) for r, (a, b) in enumerate(merges)}
        order = sorted(self.rank)
        self.pairs = np.array([*order, 1 << 62], np.int64)
        self.pair_rank = np.array([*(self.rank[p][0] for p in order), 0], np.int64)
        self.pair_new = np.array([*(self.rank[p][1] for p in order), 0], np.int64)
        self.find = regex.compile(PRE_TOKEN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.limit, self.widest = cache, widest
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.size + right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.pair_rank[at], -1), self.pair_new[at]

    def _merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        """Merge words of 2 to ``width`` bytes, one segment tree a row, all rows in step."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width + 1, b"\0") for w in words), np.uint8).reshape(n, width + 1)
        ids = self.byte_id[raw]
        column = np.arange(width + 1)
        ids[column >= lengths[:, None]] = -1
        after = np.minimum(column + 1, lengths[:, None]).astype(np.int32)
        before = np.broadcast_to(column - 1, (n, width + 1)).astype(np.int32).copy()
        tree = np.full((n, 2 * width), NONE)
        rank, _ = self._ranked(np.maximum(ids[:, :-1], 0), np.maximum(ids[:, 1:], 0))
        apply = (rank >= 0) & (column[1:] < lengths[:, None])
        tree[:, width:] = np.where(apply, rank * width + column[:-1], NONE)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        alive = column < lengths[:, None]
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            at = tree[rows, 1] % width
            gone = after[rows, at]
            _, new = self._ranked(ids[rows, at], ids[rows, gone])
            ids[rows, at] = new
            alive[rows, gone] = False
            then = after[rows, gone]
            after[rows, at] = then
            before[rows, then] = at
            prior = before[rows, at]
            rank, _ = self._ranked(new, np.maximum(ids[rows, then], 0))
            tree[rows, width + at] = np.where((rank >= 0) & (ids[rows, then] >= 0), rank * width + at, NONE)
            inside = gone < width
            tree[rows[inside], width + gone[inside]] = NONE
            has = prior >= 0
            r, p = rows[has], prior[has]
            rank, _ = self._ranked(ids[r, p], new[has])
            tree[r, width + p] = np.where(rank >= 0, rank * width + p, NONE)
            up = np.concatenate([rows, rows[inside], r])
            node = (width + np.concatenate([at, gone[inside], p])) >> 1
            while node[0]:
                tree[up, node] = np.minimum(tree[up, 2 * node], tree[up, 2 * node + 1])
                node = node >> 1
            rows = rows[tree[rows, 1] < NONE]
        flat = ids[:, :width][alive[:, :width]].astype("<u4").tobytes()
        ends = np.cumsum(alive[:, :width].sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _merge_long(self, word: bytes) -> bytes:
        """Merge one long word with a segment tree of its own."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        none = int(NONE)
        ids = [int(self.byte_id[b]) for b in word]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        size, rank = self.size, self.rank

        def leaf(i: int) -> int:
            j = after[i]
            found = rank.get(ids[i] * size + ids[j]) if j < n else None
            return found[0] * width + i if found else none

        tree = [none] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = leaf(i)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            i >>= 1
            while i:
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low
                i >>= 1

        alive = bytearray(b"\1" * n)
        while tree[1] < none:
            i = tree[1] % width
            j = after[i]
            ids[i] = rank[ids[i] * size + ids[j]][1]
            alive[j] = 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            put(j, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        return np.array([x for x, on in zip(ids, alive, strict=True) if on], "<u4").tobytes()

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, packed as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) > self.widest:
                out[k] = self._merge_long(w)
            elif len(w) > 1:
                groups.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(k)
            elif w:
                out[k] = self.byte_id[w[0] : w[0] + 1].astype("<u4").tobytes()
        for width, all_at in groups.items():
            for s in range(0, len(all_at), 2_000):
                at = all_at[s : s + 2_000]
                for k, ids in zip(at, self._merge_rows([words[k] for k in at], width), strict=True):
                    out[k] = ids
        return out

    def _learn(self, missing: Iterable[str]) -> None:
        """Encode pre-tokens that the cache lacks."""
        new = [w for w in missing if w not in self.words]
        self.words.update(zip(new, self.merge([w.encode() for w in new]), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text; a null counts as empty.

        A single space before a character that is no white space always starts a pre-token, so texts are
        cut there and whole chunks are remembered. Texts with other runs of white space are cut by the
        full pattern.
        """
        if len(self.words) > self.limit:
            self.words.clear()
        if len(self.chunks) > self.limit:
            self.chunks.clear()
        plans: list[list[tuple[str | int, list]]] = []
        odd_words: set[str] = set()
        fresh: set[str] = set()
        chunks = self.chunks
        for text in texts:
            plan: list[tuple[str | int, list]] = []
            for part in self.cut(text or "") if self.cut and text and any(s in text for s in self.special) else [text or ""]:
                if part in self.special:
                    plan.append((self.special[part], []))
                    continue
                if not part:
                    continue
                head, *rest = part.split(" ")
                known = list(map(chunks.get, rest))
                new = {c for c, x in zip(rest, known, strict=True) if x is None} if None in known else ()
                odd = any(not c[:1].strip() for c in new)  # empty or after white space: never remembered
                found = self.find(part if odd else head)
                odd_words.update(found)
                plan.append(("words", found))
                if not odd:
                    fresh.update(new)
                    plan.append(("chunks", rest) if new else ("known", known))
            plans.append(plan)
        # a chunk of letters is one pre-token, and one mark after it is another
        stems, marked, others = set(), [], {}
        for c in fresh:
            if c.isalpha():
                stems.add(c)
            elif c[-1] in MARKS and c[:-1].isalpha():
                marked.append(c)
                if c[:-1] not in chunks:
                    stems.add(c[:-1])
            else:
                others[c] = self.find(" " + c)
        self._learn({*odd_words, *MARKS}.union(*others.values()))
        words = self.words
        new = list(stems)
        chunks.update(zip(new, self.merge([b" " + c.encode() for c in new]), strict=True))
        for c in marked:
            chunks[c] = chunks[c[:-1]] + words[c[-1]]
        for c, found in others.items():
            chunks[c] = b"".join([words[w] for w in found])
        out = []
        for plan in plans:
            parts = []
            for kind, x in plan:
                if kind == "known":
                    parts.append(b"".join(x))
                elif kind == "chunks":
                    parts.append(b"".join(map(chunks.__getitem__, x)))
                elif kind == "words":
                    parts.append(b"".join(map(words.__getitem__, x)))
                else:
                    parts.append(np.array([kind], "<u4").tobytes())
            out.append(b"".join(parts))
        return out

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


#: Words and chunks that an encoder remembers between calls.
CACHE = 700_000
_encoders: dict[tuple[str, int], SegmentTreeBPE] = {}


def encoder(path: str, cache: int = CACHE) -> SegmentTreeBPE:
    """One encoder for each file, size of cache and Python worker."""
    if (path, cache) not in _encoders:
        _encoders[path, cache] = SegmentTreeBPE(path, cache)
    return _encoders[path, cache]
