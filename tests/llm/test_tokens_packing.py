import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyframe.llm.bpe import SegmentTreeBPE
from tallyframe.llm.common import table, written
from tallyframe.llm.packing import best_fit_decreasing, lower_bound, pack_documents, pack_pieces
from tallyframe.llm.queries import QUERIES
from tallyframe.llm.tokens import encode_texts

from ..compare import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, OWN = Tokenizer.from_file(PATH), SegmentTreeBPE(PATH)
ODD = ["", " ", "  x", "a  b\n\n c", "don't 'S", "<|endoftext|>", "a <|endoftext|>b", "é日本 😀", "\x1c\x85\xa0a", "x" * 3000, "ab" * 500, "12345 678", "\r\n\t ", "a.b,c!", "word. word, word", "\0"]


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_those_of_the_library(text):
    packed = OWN.encode([text])[0]
    assert np.frombuffer(packed, "<u4").tolist() == ids(text)
    assert OWN.decode(packed) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["the", " the", "'s", " ", "  ", "\n", "12", "é", ".", "Ab", "<|endoftext|>", "　", "ﬁ"]), max_size=12))
def test_mixed_parts(parts):
    text = "".join(parts)
    assert np.frombuffer(OWN.encode([text])[0], "<u4").tolist() == ids(text)


def test_odd_texts_and_a_small_cache():
    small = SegmentTreeBPE(PATH, cache=3, widest=8)
    for bpe in (OWN, small):
        for _ in range(2):
            for text, packed in zip(ODD, bpe.encode(ODD), strict=True):
                assert np.frombuffer(packed, "<u4").tolist() == ids(text), text


def test_encode_texts(spark):
    rows = [*enumerate(ODD), (50, None), (None, "no id"), (51, "same"), (51, "same")]
    df = spark.createDataFrame([(i, t, 1, "d") for i, t in rows], "doc_id long, text string, ids int, decoded string")
    got = encode_texts(df, PATH).collect()
    want = []
    for i, t in rows:
        x = ids(t or "")
        want.append((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(x, skip_special_tokens=False).encode()).hexdigest(), x))
    assert sorted(map(str, want)) == sorted(str((g.doc_id, g.n_tokens, g.ids_sha256, g.decoded_sha256, g.ids)) for g in got)
    assert encode_texts(df.limit(0), PATH).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_best_fit_and_its_bound(lengths):
    x = np.array(lengths)
    where, offset, rooms = best_fit_decreasing(x, 64)
    fill = np.bincount(where, x, minlength=len(rooms))
    assert (fill + rooms == 64).all() and len(rooms) >= lower_bound(x, 64) >= -(-x.sum() // 64)
    for b in range(len(rooms)):
        at = np.argsort(offset[where == b])
        assert (np.cumsum(x[where == b][at]) - x[where == b][at] == offset[where == b][at]).all()


def pieces(spark, lengths):
    df = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    return written(df, "pieces")


def packed_rounds(spark, lengths, per_partition):
    """The packed rows and how many rounds of packing they come from."""
    rows = pack_pieces(pieces(spark, lengths), 100, per_partition).collect()
    return rows, len({r.sequence_id >> 50 for r in rows})


def test_certified_partitions_do_not_exchange(spark):
    # each piece needs a sequence of its own, so every partition meets its bound although all sequences have room
    rows, rounds = packed_rounds(spark, [60] * 400, 40)
    assert rounds == 1 and len({r.sequence_id for r in rows}) == 400


def test_partitions_with_gaps_exchange_until_one_is_left(spark):
    r = random.Random(7)
    lengths = [r.randint(1, 100) for _ in range(3000)]
    rows, rounds = packed_rounds(spark, lengths, 400)
    used, bound = len({x.sequence_id for x in rows}), lower_bound(np.array(lengths), 100)
    first = len({(x.sequence_id) for x in rows if x.sequence_id >> 50 == 0})
    assert rounds > 1 and first > 0 and sorted(x.doc_id for x in rows) == list(range(3000))
    assert used <= 1.02 * bound


def test_queries_against_the_library(spark):
    texts = {x.doc_id: ids(x.text or "") for x in table(spark, SF, "documents").collect()}
    for x in QUERIES["op4_bpe"](spark, SF).collect():
        want = texts[x.doc_id]
        assert (x.n_tokens, x.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256(LIBRARY.decode(want, skip_special_tokens=False).encode()).hexdigest()
    total, places = {}, {}
    for x in QUERIES["op9_packing"](spark, SF).collect():
        want = [*texts[x.doc_id], 2][x.start : x.start + x.length]
        assert x.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes()) and len(want) == x.length
        total[x.doc_id] = total.get(x.doc_id, 0) + x.length
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert total == {i: len(t) + 1 for i, t in texts.items()}
    for parts in places.values():
        ends = [0, *(a + n for a, n in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024


def test_bound_of_large_pieces():
    assert lower_bound(np.array([600] * 10), 1024) == 10


@pytest.mark.parametrize("per_partition", [40, 16_384])
def test_pack_documents(spark, per_partition):
    r = random.Random(5)
    rows = [(i, " ".join("word" for _ in range(r.choice((3, 30, 200, 700, 3000))))) for i in range(150)]
    rows += [(900, None), (901, ""), (None, "no id here"), (902, "twice"), (902, "twice"), (903, "x y " * 2047 + "x")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, piece int, part int")
    got = pack_documents(df, PATH, 1024, 2, per_partition=per_partition).collect()
    tokens = {i: [*ids(t or ""), 2] for i, t in rows}
    seen = {}
    for g in got:
        x = tokens[g.doc_id]
        assert g.ids_crc32 == zlib.crc32(np.array(x[g.start : g.start + g.length], "<u4").tobytes())
        seen.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    per_doc = {}
    for g in got:
        per_doc.setdefault(g.doc_id, set()).add((g.piece, g.start, g.length))
    for i, x in tokens.items():
        n = -(-len(x) // 1024)
        cuts = [0, *(len(x) - 1024 * (n - k) for k in range(1, n + 1))]
        assert per_doc[i] == {(k, a, b - a) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    assert len(got) == sum(-(-len(tokens[i]) // 1024) for i, _ in rows)
    lengths = np.array([g.length for g in got])
    alone = len(best_fit_decreasing(lengths, 1024)[2])  # all pieces in one task
    assert lower_bound(lengths, 1024) <= len(seen) <= alone + (2 if per_partition < 100 else 0)
    assert pack_documents(df.limit(0), PATH).collect() == []
