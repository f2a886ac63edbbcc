import re
from collections import Counter
from math import log2

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyframe.llm.common import table
from tallyframe.llm.fertility import LEAST_TEXTS, MEASURES, NORMAL, TYPICAL, WIDTH, WINDOW, bands, code_points, entropies, quality_rules, repeated_lines, repeated_words, script_of
from tallyframe.llm.queries import QUERIES

from ..compare import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LEFT, RIGHT = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
LEFT.encode_special_tokens = True


def counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    inside = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(re.search("[^\x20\x09-\x0d]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def entropy(ids):
    total = 0.0
    for i in range(0, len(ids), WINDOW):
        part = ids[i : i + WINDOW]
        share = -sum(n / len(part) * log2(n / len(part)) for n in Counter(part).values()) / log2(len(part)) if len(part) > 1 else 1.0
        total += share * len(part)
    return total / len(ids) if ids else 1.0


def by_force(docs):
    """Of (id, text, lang): id, counts, whether the base rules failed, whether kept."""
    found = []
    for i, text, lang in docs:
        text = text or ""
        n = counts(text)
        a, b = LEFT.encode(text, add_special_tokens=False).ids, RIGHT.encode(text)
        x = {"chars_per_token": len(text) / max(1, len(a)), "fallback_share": sum(map(RIGHT.is_byte, b)) / max(1, len(text.encode())), "token_entropy": entropy(a)}
        found.append((i, lang, script_of(code_points(text)), n, n[0] < 50 or 100 * n[4] > 50 * n[0], x, len(a)))
    band = {}
    for kind in (1, 2):
        for name in {r[kind] for r in found} - {None}:
            rows = [r for r in found if r[kind] == name and not r[4]]
            for m, (grid, least) in MEASURES.items():
                cells = sorted(int(np.floor(r[5][m] / grid + 0.5)) for r in rows)
                if len(cells) >= LEAST_TEXTS:
                    middle = cells[(len(cells) - 1) // 2]
                    away = sorted(abs(c - middle) for c in cells)[(len(cells) - 1) // 2]
                    least *= middle * grid if m == "chars_per_token" else 1
                    band[kind, name, m] = middle * grid, max(WIDTH * NORMAL * away * grid, least)
    out = []
    for i, lang, script, n, failed, x, size in found:
        kept = not failed
        for m in MEASURES:
            centre, half = band.get((1, lang, m)) or band.get((2, script, m)) or (0.0, float("inf"))
            kept &= abs(x[m] - centre) <= half * max(1, TYPICAL / max(size, 1)) ** 0.5
        out.append((i, *n, failed, kept))
    return out


def got(df):
    return [tuple(r) for r in df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "the", "é"]), max_size=12), min_size=1, max_size=5))
def test_repeated_words(texts):
    assert repeated_words(texts).tolist() == [counts(" ".join(t))[4] for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=5), st.integers(1, 40))
def test_entropies(sizes, kinds):
    ids = np.arange(sum(sizes)) * 7 % kinds
    ends = np.cumsum([0, *sizes])
    assert np.allclose(entropies(ids, np.array(sizes)), [entropy(ids[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["", " ", "a", "b\t", "\x0b"]), max_size=8))
def test_repeated_lines(lines):
    assert repeated_lines("\n".join(lines)) == counts("\n".join(lines))[3]


@pytest.mark.parametrize("text,script", [("", None), ("12 !?", None), ("Äbc", "Latin"), ("привет мир a", "Cyrillic"), ("日本語", "Han"), ("ab κλ", "Greek")])
def test_script(text, script):
    assert script_of(code_points(text)) == script


def test_odd_rows_by_force(spark):
    words = [f"w{i}ord" for i in range(300)]
    plain = [(k, " ".join(words[k : k + 80]), "xx") for k in range(40)]
    odd = [(100, None, "xx"), (101, "", None), (102, "a b " * 200, "xx"), (103, " ".join(f"{w}|" for w in words[:90]), "xx"), (104, "!" * 5000, None), (105, "日本" * 3000, None)]
    odd += [(None, plain[0][1], "xx"), (5, plain[5][1], "xx"), (106, " ".join(words), "rare"), (107, "привет " + " ".join(f"сл{i}ово" for i in range(99)), None), (108, "q\r\n" * 70, "xx"), (109, " ".join(words) * 40, "xx")]
    docs = plain + odd
    df = spark.createDataFrame([(*r, "clash", 2) for r in docs], "doc_id long, text string, lang string, script string, n_words int").repartition(3)
    found = quality_rules(df, A, B)
    assert sorted(map(str, got(found))) == sorted(map(str, by_force(docs)))
    rows = {r.doc_id: r for r in found.collect()}
    assert not rows[103].kept and not rows[103].base_failed and rows[107].kept and rows[0].kept
    assert quality_rules(df.limit(0), A, B).collect() == []


def test_copies_of_half_a_language_leave_the_rest_alone(spark):
    rows = [("x", None, 3.0, 0.01, 0.8)] * 60 + [("x", None, 3.0 + 0.005 * k, 0.01, 0.8 + k / 2000) for k in range(40)]
    df = spark.createDataFrame(rows, "lang string, script string, chars_per_token double, fallback_share double, token_entropy double")
    assert {r.measure: round(r.half, 6) for r in bands(df).collect()} == {"chars_per_token": 0.3, "fallback_share": 0.03, "token_entropy": 0.04}


def test_query_by_force(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text", "lang").collect()]
    found = QUERIES["op12_quality_rules"](spark, SF)
    assert sorted(map(str, got(found))) == sorted(map(str, by_force(docs)))


def test_junk_goes_and_good_texts_stay(spark):
    sf = "/root/testdata/sf0.01"
    judged = QUERIES["op12_quality_rules"](spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("n_words >= 50")
    kept = {r.quality: r.kept for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[1] >= 0.98 and kept[0] <= 0.15
