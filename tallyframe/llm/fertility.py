"""Quality rules by tokeniser fertility: how public vocabularies take a text, held against its language's or script's bands."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .align import Aligner, aligner
from .batches import in_turn, slices
from .common import SPACE, written

#: Tokens of a window in which entropy is measured, so that long texts compare with short ones.
WINDOW = 128
#: Measures with the grid on which medians are taken, and the least half-width of a band. That of ``chars_per_token`` is a
#: share of the median. Where copies make up half of a language, deviations are 0, and these alone remain.
MEASURES = {"chars_per_token": (1e-3, 0.1), "fallback_share": (1e-4, 0.03), "token_entropy": (1e-4, 0.04)}
#: Half-width of a band in median absolute deviations, scaled to standard deviations of a normal distribution.
WIDTH, NORMAL = 5.0, 1.4826
#: Shorter texts scatter more: with fewer tokens than this, bands widen by the root of what is missing.
TYPICAL = 256
#: Texts that a language or script must have for a band.
LEAST_TEXTS = 20

#: Blocks of Unicode's larger scripts.
SCRIPTS = (
    (0x41, 0x5A, "Latin"),
    (0x61, 0x7A, "Latin"),
    (0xC0, 0x24F, "Latin"),
    (0x370, 0x3FF, "Greek"),
    (0x400, 0x52F, "Cyrillic"),
    (0x530, 0x58F, "Armenian"),
    (0x590, 0x5FF, "Hebrew"),
    (0x600, 0x6FF, "Arabic"),
    (0x900, 0x97F, "Devanagari"),
    (0x980, 0x9FF, "Bengali"),
    (0xB80, 0xBFF, "Tamil"),
    (0xE00, 0xE7F, "Thai"),
    (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"),
    (0x1E00, 0x1EFF, "Latin"),
    (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x30FF, "Kana"),
    (0x3400, 0x4DBF, "Han"),
    (0x4E00, 0x9FFF, "Han"),
    (0xAC00, 0xD7AF, "Hangul"),
    (0x20000, 0x323AF, "Han"),
)
_starts = np.array([a for a, _, _ in SCRIPTS])
_stops = np.array([b for _, b, _ in SCRIPTS])
_names = sorted({s for _, _, s in SCRIPTS})
_script = np.array([_names.index(s) for _, _, s in SCRIPTS])

_words = re.compile(rf"[^{SPACE}]+").findall
SYMBOLS = "#*$%&|<>"


class _Codes(dict):
    """A number for each word."""

    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        return self[word]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def script_of(points: np.ndarray) -> str | None:
    """The script of most letters; of several, the first by name. None without a letter of a known script."""
    at = np.searchsorted(_starts, points, "right") - 1
    counts = np.bincount(_script[at[(at >= 0) & (points <= _stops[at])]], minlength=len(_names))
    return _names[int(counts.argmax())] if counts.any() else None


def repeated_words(words: list[list[str]]) -> np.ndarray:
    """The words of each text that lie in a window of three words which the text has twice or more."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    codes = _Codes()
    word = np.fromiter((codes[w] for x in words for w in x), np.int64, n.sum())
    text = np.repeat(np.arange(len(words)), n)
    first = np.flatnonzero(text[:-2] == text[2:]) if len(word) > 2 else np.empty(0, np.int64)
    k = len(codes) + 1
    pair = pd.factorize(word[first] * k + word[first + 1])[0]
    window = pd.factorize(pair * k + word[first + 2])[0]
    window = pd.factorize(text[first] * (len(window) + 1) + window)[0]
    twice = first[np.bincount(window)[window] >= 2] if len(window) else first
    hit = np.zeros(len(word), bool)
    for step in range(3):
        hit[twice + step] = True
    return np.bincount(text[hit], minlength=len(words))


def repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    return len(lines) - len(set(lines))


def entropies(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The entropy of each text's tokens as a share of the highest, a mean over its windows by their tokens; 1 below two tokens."""
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
    per_text = -(-n // WINDOW)
    window = np.repeat(np.cumsum(per_text) - per_text, n) + place // WINDOW
    size = np.bincount(window, minlength=per_text.sum())
    keys, count = np.unique(window * (int(ids.max(initial=0)) + 1) + ids, return_counts=True)
    of = keys // (int(ids.max(initial=0)) + 1)
    plogp = np.bincount(of, count * np.log2(count), minlength=len(size))
    most = np.log2(np.maximum(size, 2))
    share = np.where(size > 1, (np.log2(np.maximum(size, 1)) - plogp / np.maximum(size, 1)) / most, 1.0)
    total = np.bincount(text, share[window], minlength=len(n))
    return np.where(n > 0, total / np.maximum(n, 1), 1.0)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")
_TYPE = ", ".join(["doc_id long, lang string, script string", *(f"{c} long" for c in _COUNTS), *(f"{c} double" for c in MEASURES)])


def _measured(work: Aligner, texts: list[str]) -> list[list]:
    words = [_words(t) for t in texts]
    found = [work.encode_bytes(t) for t in texts]
    n = np.fromiter(map(len, found), np.int64, len(found))
    ids = np.concatenate([np.empty(0, np.uint32), *found]).astype(np.int64)
    points = [code_points(t) for t in texts]
    n_bytes = [len(t.encode()) for t in texts]
    fallback = [float(work.fallback_bytes[p].sum()) / max(1, b) for p, b in zip(points, n_bytes, strict=True)]
    chars = np.fromiter(map(len, texts), np.int64, len(texts))
    return [
        [script_of(p) for p in points],
        [len(w) for w in words],
        [sum(map(len, w)) for w in words],
        [sum(map(t.count, SYMBOLS)) for t in texts],
        [repeated_lines(t) for t in texts],
        repeated_words(words).tolist(),
        n.tolist(),
        (chars / np.maximum(n, 1)).tolist(),
        fallback,
        entropies(ids, n).tolist(),
    ]


def measures(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts of each whole text and what two vocabularies make of it.

    Returns ``doc_id``, ``lang``, ``script`` (of most letters, or null), ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``n_tokens``, ``chars_per_token`` and ``token_entropy`` (byte-level vocabulary) and ``fallback_share`` (bytes
    of the text that become byte pieces, as the piece vocabulary lacks their character). A null text counts as empty, without words or tokens. Rows are independent; other columns are dropped.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(bytes_path, pieces_path)
        names = ["doc_id", "lang", "script", *_COUNTS, *MEASURES]
        kinds = [pa.string(), *[pa.int64()] * len(_COUNTS), *[pa.float64()] * len(MEASURES)]
        for batch in in_turn(batches):
            for at, texts in slices(batch.column(2)):
                found = _measured(work, [t or "" for t in texts])
                given = [batch.column(i).slice(at, len(texts)) for i in range(2)]
                yield pa.RecordBatch.from_arrays(given + [pa.array(c, k) for c, k in zip(found, kinds, strict=True)], names)

    return rows.mapInArrow(run, _TYPE)


def _medians(cells: DataFrame) -> DataFrame:
    """The lower median of ``cell`` by ``kind``, ``name`` and ``measure``, from counts of cells: no group is gathered whole."""
    keys = ["kind", "name", "measure"]
    counts = cells.groupBy(*keys, "cell").agg(F.count("*").alias("n"))
    so_far, total = F.sum("n").over(Window.partitionBy(*keys).orderBy("cell")), F.sum("n").over(Window.partitionBy(*keys))
    return counts.select(*keys, "cell", so_far.alias("upto"), total.alias("n")).filter("2 * upto >= n").groupBy(*keys).agg(F.min("cell").alias("median"), F.first("n").alias("n"))


def bands(found: DataFrame, least_texts: int = LEAST_TEXTS, width: float = WIDTH) -> DataFrame:
    """The range of each measure by language and by script, over all rows of ``found`` that have them.

    Returns ``kind`` ('lang' or 'script'), ``name``, ``measure``, ``centre`` (the median) and ``half`` (the band's half-width: ``width``
    scaled median absolute deviations, but no less than the measure's own least). Both medians are exact on a grid, so one row
    can shift a band by a cell at most, and junk below half of a language hardly widens it. Names with fewer texts
    than ``least_texts`` have no band. Null names have none either.
    """
    each = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("name")) for kind in ("lang", "script")))).alias("of")
    grid = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.round(F.col(m) / g).cast("long").alias("cell")) for m, (g, _) in MEASURES.items()))).alias("x")
    cells = found.select(each, *MEASURES).select("of.*", *MEASURES).filter("name IS NOT NULL").select("kind", "name", grid).select("kind", "name", "x.*")
    middle = written(_medians(cells), "medians")
    away = cells.join(middle.select("kind", "name", "measure", "median"), ["kind", "name", "measure"])
    away = _medians(away.withColumn("cell", F.abs(F.col("cell") - F.col("median"))).drop("median"))
    both = middle.filter(F.col("n") >= least_texts).join(away.select("kind", "name", "measure", F.col("median").alias("away")), ["kind", "name", "measure"])
    pick = lambda i: F.create_map(*(F.lit(x) for m, v in MEASURES.items() for x in (m, v[i])))[F.col("measure")]
    centre = F.col("median") * pick(0)
    least = pick(1) * F.when(F.col("measure") == "chars_per_token", centre).otherwise(1.0)
    half = F.greatest(F.lit(width * NORMAL) * F.col("away") * pick(0), least)
    return both.select("kind", "name", "measure", centre.alias("centre"), half.alias("half"))


def base_failed() -> Column:
    """Too few words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_texts: int = LEAST_TEXTS, width: float = WIDTH) -> DataFrame:
    """Judge each whole text by counts and by its language's or script's bands.

    Returns one row per input row: ``id_col``, the counts of ``measures``, ``base_failed``, ``kept``, then the measures and
    ``outside``, the names of those beyond their band. A text that fails the base rules is not kept. Of the others,
    those are kept that lie within all bands of their language, or, where the language is null or has too few
    texts, of their script; bands are wider for texts of few tokens. A text without either band is kept, as nothing speaks against it. Bands are learned from all texts
    that pass the base rules.

    Null texts count as empty and fail. Null ids and repeated rows are rows of their own. An empty table gives an
    empty result. Other columns are dropped.
    """
    found = written(measures(docs, bytes_path, pieces_path, id_col, text_col, lang_col).withColumn("base_failed", base_failed()), "measures")
    sides = F.map_from_entries(F.collect_list(F.struct("measure", F.struct("centre", "half"))))
    known = written(bands(found.filter("NOT base_failed"), least_texts, width), "bands").groupBy("kind", "name").agg(sides.alias("band"))
    out = found
    for kind in ("lang", "script"):
        out = out.join(known.filter(F.col("kind") == kind).select(F.col("name").alias(kind), F.col("band").alias(f"{kind}_band")), kind, "left")
    out = out.withColumn("band", F.coalesce("lang_band", "script_band"))
    wider = F.sqrt(F.greatest(F.lit(1.0), F.lit(TYPICAL) / F.greatest("n_tokens", F.lit(1))))
    beyond = [F.when(F.abs(F.col(m) - F.col("band")[m]["centre"]) > F.col("band")[m]["half"] * wider, F.lit(m)) for m in MEASURES]
    outside = F.array_compact(F.array(*beyond))
    kept = ~F.col("base_failed") & (F.size("outside") == 0)
    return out.withColumn("outside", outside).select(F.col("doc_id").alias(id_col), *_COUNTS, "base_failed", kept.alias("kept"), *MEASURES, "outside")
