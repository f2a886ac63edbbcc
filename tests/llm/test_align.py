import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyframe.llm.align import Aligner, align_texts, alignment, linked_ids
from tallyframe.llm.bpe import printable_bytes
from tallyframe.llm.common import table
from tallyframe.llm.queries import QUERIES

from ..compare import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LEFT, RIGHT = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
LEFT.encode_special_tokens = True
OWN = Aligner(A, B)
ODD = ["", None, " ", "  x", "a  b\n\n c", "<|endoftext|> <s> </s>", "é日本 😀", "▁under", "a▁b", "x" * 3000, "ab" * 900, "\r\n\t \0", "12345 678", " ﬁ\xa0", "<0x41>", "日" * 500, "the the the", " " * 40_000 + "x", "\n \t" * 20_000, "z" * 30_000]


def by_hand(text):
    """Groups of A and B ids of one text, walked token by token."""
    whole = b" " + text.encode() if text else b""
    to_byte = printable_bytes()
    a = LEFT.encode(" " + text, add_special_tokens=False).ids if text else []
    b = RIGHT.encode(text) if text else []
    a_raw = [bytes(to_byte[c] for c in LEFT.id_to_token(i)) for i in a]
    b_raw = [bytes([int(RIGHT.id_to_piece(i)[3:5], 16)]) if RIGHT.is_byte(i) else RIGHT.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(a_raw) != whole or b"".join(b_raw) != whole:
        return []
    groups, i, j = [], 0, 0
    while i < len(a):
        left, right, x, y = [a[i]], [b[j]], len(a_raw[i]), len(b_raw[j])
        while x != y:
            if x < y:
                i += 1
                left.append(a[i])
                x += len(a_raw[i])
            else:
                j += 1
                right.append(b[j])
                y += len(b_raw[j])
        groups.append((left, right))
        i, j = i + 1, j + 1
    return groups


def by_force(docs):
    """Of (id, text): the rows of ``alignment``, and the documents of each pair."""
    found = [(i, by_hand(t or "")) for i, t in docs]
    links = [Counter((a, b) for left, right in g for a in left for b in right) for _, g in found]
    count = Counter(p for x in links for p in x)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (i, groups), x in zip(found, links, strict=True):
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        n_best = sum(n for p, n in x.items() if count[p] == best[p[0]])
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(x.values()), sha, n_best, sum(n * count[p] for p, n in x.items())))
    return out, count, best


def key(rows):
    return sorted(map(str, rows))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30) | st.sampled_from([t for t in ODD if t]), max_size=6))
def test_groups_are_those_by_hand(texts):
    found = OWN.align(texts)
    groups = iter(zip(found.group_a.tolist(), found.group_b.tolist(), strict=True))
    a, b = iter(found.a.tolist()), iter(found.b.tolist())
    for text, n in zip(texts, found.n_groups.tolist(), strict=True):
        assert [([next(a) for _ in range(x)], [next(b) for _ in range(y)]) for x, y in (next(groups) for _ in range(n))] == by_hand(text)


@pytest.mark.parametrize("block", [1, 1_500_000])
def test_alignment_by_force(spark, block):
    docs = [*enumerate(ODD), (None, "a null id, the the"), (100, "same text"), (100, "same text"), (7, "the hot the hot"), *((1000 + i, f"the hot word {i}") for i in range(60))]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, block int, places string").repartition(5)
    want, count, best = by_force(docs)
    got = alignment(df, A, B, block=block)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert key(map(tuple, got.collect())) == key(want)
    links = linked_ids(df, A, B, block=block).collect()
    assert {(r.a, r.b): r["count"] for r in links} == count
    assert all(r.best == (r["count"] == best[r.a]) for r in links)


def test_long_groups_one_by_one(monkeypatch):
    texts = [t or "" for t in ODD] + ["the cat " * 50]
    found = OWN.align(texts)
    plain = OWN.links(found)
    monkeypatch.setattr("tallyframe.llm.align.LARGE", 0)
    for x, y in zip(plain, OWN.links(found), strict=True):
        assert np.array_equal(x, y)


def test_align_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    for r in align_texts(df, A, B).collect():
        groups = by_hand(ODD[r.doc_id] or "")
        assert r.a_ids == [i for g in groups for i in g[0]] and r.b_ids == [i for g in groups for i in g[1]]
        assert list(zip(r.group_a, r.group_b, strict=True)) == [(len(x), len(y)) for x, y in groups]
        assert not groups or r.group_ends[-1] == 1 + len(ODD[r.doc_id].encode())
    assert align_texts(df.limit(0), A, B).collect() == []
    assert alignment(df.limit(0), A, B).collect() == []
    assert linked_ids(df.filter(F.col("text").isNull()), A, B).collect() == []


def test_query_by_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert key(map(tuple, QUERIES["op13_alignment"](spark, SF).collect())) == key(by_force(docs)[0])
