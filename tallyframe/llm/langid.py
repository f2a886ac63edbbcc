"""Language identification as multilingual mixture inference.

A text's byte trigrams are drawn from a mixture of languages. Expectation-maximisation estimates the
proportions from the trigram likelihoods of each language; which languages belong to the text is chosen by
penalised likelihood.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .batches import in_turn
from .common import with_text

#: Buckets of the trigram table.
BUCKETS = 1 << 14
#: At most about so many training texts of each language, chosen by a hash of the text.
TRAINING_TEXTS = 2_000
UNDETERMINED = "und"
#: Candidates for letters; signs such as fractions are among them and ``isalpha`` tells them apart.
LETTER = re.compile(r"[^\W\d_]")
#: Trigrams that decide how sure a single language is; with more, the certainty of any text would be 1.
SENTENCE = 60
NOT_WORD = re.compile(r"[\W\d_]+")


def trigrams(text: str) -> np.ndarray:
    """The bucket of each byte trigram of the lower-cased text, runs of other than letters as one space."""
    b = np.frombuffer(NOT_WORD.sub(" ", f" {text.lower()} ").encode(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    h = h * np.uint32(2654435761)
    return (h >> np.uint32(32 - 14)).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    probability: np.ndarray  # bucket x language


def fit(docs: DataFrame, train: Column, lang_col: str = "lang", text_col: str = "text", texts: int = TRAINING_TEXTS) -> LanguageModel:
    """Trigram probabilities of each language, from the rows of ``train`` with a language and a text.

    Of a language with many rows, a share is taken so that about ``texts`` remain. The driver gets one row
    for each language and bucket at most. Without training rows the model has no languages.
    """
    rows = docs.filter(train).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.empty((BUCKETS, 0)))
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, texts / sizes[k]))))
    rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in in_turn(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                got += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for lang, got in totals.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(got[at])], ["lang", "bucket", "n"])

    counted = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.full((BUCKETS, len(languages)), 0.5)
    for r in counted.collect():
        counts[r["bucket"], languages.index(r["lang"])] += r["n"]
    return LanguageModel(languages, counts / counts.sum(0))


def proportions(counts: np.ndarray, probability: np.ndarray, close: float = 0.25, rounds: int = 5000) -> tuple[np.ndarray, float]:
    """Mixture proportions by expectation-maximisation, and the log-likelihood.

    The likelihood is concave in the proportions, so its steepest slope towards a column bounds what is left to
    gain; rounds end when that is at most ``close``, or after ``rounds``: then the proportions are those of the last
    round, whose likelihood is no lower than any before.
    """
    k = probability.shape[1]
    pi, total = np.full(k, 1 / k), counts.sum()
    for _ in range(rounds if k > 1 else 0):
        pull = (counts / (probability @ pi)) @ probability
        if pull.max() - total <= close:
            break
        pi = pi * pull / total
    return pi, float(counts @ np.log(probability @ pi))


def choose(counts: np.ndarray, probability: np.ndarray, cost: float) -> tuple[list[int], np.ndarray]:
    """The columns of highest penalised likelihood, and their proportions; each column after the first costs ``cost``.

    From the best single column, the column whose addition gains most is added while that pays, and a column that
    no longer pays is taken out. The likelihood is concave in the proportions, so its slope towards a column
    bounds what that column can add: only those whose slope exceeds the cost are tried, and without any the
    search ends. Each step raises the penalised likelihood.
    """
    chosen = [int(np.argmax(counts @ np.log(probability)))]
    share, best = proportions(counts, probability[:, chosen])
    while True:
        slope = (counts / (probability[:, chosen] @ share)) @ probability - counts.sum()
        slope[chosen] = -np.inf
        tried = [(*proportions(counts, probability[:, [*chosen, c]]), c) for c in np.flatnonzero(slope > cost).tolist()]
        more, likely, c = max(tried, key=lambda t: t[1], default=(share, -np.inf, -1))
        if likely - best <= cost:
            return chosen, share
        chosen, share, best = [*chosen, c], more, likely
        for c in chosen[:-1]:
            fewer = [x for x in chosen if x != c]
            less, likely = proportions(counts, probability[:, fewer])
            if best - likely < cost:
                chosen, share, best = fewer, less, likely


def infer(text: str | None, model: LanguageModel, penalty: float = 4.0) -> tuple[str, float, list[tuple[str, float]]]:
    """The main language, the share of the text that it explains, and all languages with their shares.

    Besides the languages, one component draws each trigram alike: it takes what no learned language explains,
    such as garbled text or an unknown language, and so lowers the score. A component more must raise the
    log-likelihood by ``penalty`` times log(trigrams) / 2. Trigrams overlap, so the penalty is above the one
    for independent draws. If all is in the alike component, the likeliest language is given with a low score.
    """
    if not text or not model.languages or not any(m[0].isalpha() for m in LETTER.finditer(text)):
        return UNDETERMINED, 0.0, []
    found = np.bincount(trigrams(text), minlength=BUCKETS)
    at = np.flatnonzero(found)
    if not len(at):
        return UNDETERMINED, 0.0, []
    counts, p = found[at].astype(np.float64), model.probability[at]
    n, k = counts.sum(), p.shape[1]
    chosen, share = choose(counts, np.concatenate([p, np.full((len(at), 1), 1 / BUCKETS)], 1), penalty * np.log(n + 1) / 2)
    mixed = sorted(((float(s), c) for c, s in zip(chosen, share, strict=True) if c < k), reverse=True)
    known = min(1.0, sum(s for s, _ in mixed))
    languages = [(model.languages[c], s) for s, c in mixed]
    if len(mixed) > 1:
        return languages[0][0], min(1.0, mixed[0][0]), languages
    # how sure one language is against each other one, on the trigrams of one short sentence at most
    scores = counts @ np.log(p) / n * min(n, SENTENCE)
    main = mixed[0][1] if mixed else int(np.argmax(scores))
    sure = np.exp(scores - scores.max())
    return model.languages[main], float(known * sure[main] / sure.sum()), languages


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The language of each whole text: ``id_col``, the columns of ``keep``, ``lang_pred``, ``score`` (0 to 1), ``languages``.

    A text that is null or has no letter is ``und`` with score 0 and no languages. Rows are independent:
    repeated rows and null ids need no special case, an empty table gives an empty result, and other columns
    are dropped. ``keep`` may name the text too; a kept column must not be named as one of the results.
    """
    names = [id_col, *keep]
    rows, at = with_text(docs, names, text_col)
    schema = StructType([*rows.schema.fields[: len(names)], *StructType.fromDDL("lang_pred string, score double, languages array<struct<lang string, share double>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_turn(batches):
            found = [infer(t.as_py(), model) for t in batch.column(at)]
            mixed = pa.array([[{"lang": a, "share": s} for a, s in f[2]] for f in found], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), mixed], [*names, "lang_pred", "score", "languages"])

    return rows.mapInArrow(run, schema)
