"""Quality classifier by positive-unlabelled learning.

Texts that labels trust as good are the positives, texts without a label are the unlabelled mixture. A
logistic model minimises the non-negative unbiased risk: the positives' risk weighted with the class
prior, plus the unlabelled texts' risk as negatives less the positives' share of it, which is kept from
falling below zero. The prior itself is estimated from how rarely the positives score as low as the
unlabelled do, on rows that the scoring model has not seen. The model sees a text's words and byte trigrams,
hashed into bins, and its shape.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .batches import in_turn
from .common import with_text

#: At most about so many training rows of each kind reach the driver, chosen by a hash of the id.
TRAINING_ROWS = 8_000
#: Numbers of a text's shape, bins of its words and of its byte trigrams.
SHAPE, WORD_BINS, GRAM_BINS = 24, 128, 256
FEATURES = SHAPE + WORD_BINS + GRAM_BINS
#: The scale of a bin beside that of a number of the shape.
BIN_SCALE = 0.3
#: Texts whose features a task holds at once.
SLICE = 500
LETTERS = re.compile(r"[^\W\d_]")
UPPER_LETTERS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
MARKS = re.compile(r"[^\w\s]")
ENDS = re.compile(r"[.!?…]['\")\]]*(?=\s|$)")


def bins(text: str, words: Counter) -> np.ndarray:
    """Square roots of how often the words and the byte trigrams of a whole text fall into their bins, each half of unit length."""
    out = np.zeros(WORD_BINS + GRAM_BINS, np.float32)
    if words:
        place = np.fromiter((zlib.crc32(w.lower().encode()) % WORD_BINS for w in words), np.int64, len(words))
        out[:WORD_BINS] = np.sqrt(np.bincount(place, np.fromiter(words.values(), float, len(words)), WORD_BINS) / words.total())
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    if len(raw) > 2:
        place = ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)) >> np.uint32(24)
        out[WORD_BINS:] = np.sqrt(np.bincount(place, minlength=GRAM_BINS) / len(place))
    return out


def features(text: str | None) -> np.ndarray:
    """A whole text's shape and its bins of words and byte trigrams."""
    text = text or ""
    words = text.split()
    return np.concatenate([shape(text, words), bins(text, Counter(words))])


def shape(text: str, words: list[str]) -> np.ndarray:
    """Words, marks, capitals, lines, repetition and compressibility of a whole text."""
    out = np.zeros(SHAPE, np.float32)
    n, chars = len(words), len(text)
    if not n:
        out[0] = 1
        return out
    marks, letters = Counter(MARKS.findall(text)), len(LETTERS.findall(text))
    ended = sum(marks.values())
    counts = Counter(words)
    lines = text.split("\n")
    same = sum(map(str.__eq__, words, words[1:]))
    top = counts.most_common(1)[0][1]
    plain = marks["."] + marks[","] + marks["'"] + marks["-"]
    out[1] = np.log1p(n)
    out[2] = np.log1p(chars / n)
    out[3] = letters / chars
    out[4] = len(UPPER_LETTERS.findall(text)) / max(1, letters)
    out[5] = (ended - plain) / n
    out[6] = plain / n
    out[7] = marks["!"] / n
    out[8] = marks["|"] / n
    out[9] = (marks["*"] + marks["#"] + marks["%"] + marks["&"] + marks["$"]) / n
    out[10] = sum(map(str.isdigit, text)) / chars
    out[11] = same / n
    out[12] = top / n if n > 8 else 0
    out[13] = len(counts) / n
    out[14] = len(ENDS.findall(text)) / n
    out[15] = len(lines) / n
    out[16] = len(set(lines)) / len(lines)
    out[17] = sum(not any(map(str.isalpha, w)) for w in counts) / len(counts)
    out[18] = sum(map(str.isupper, words)) / n
    out[19] = min(1.0, max(map(len, counts)) / 100)
    out[20] = sum(w[:1].isupper() for w in words) / n
    sample = text.encode()
    out[21] = min(2.0, len(zlib.compress(sample, 1)) / len(sample))
    out[22] = np.log1p(len(counts))
    out[23] = n < 4
    return out


def expanded(x: np.ndarray) -> np.ndarray:
    """The features, and the square roots of the shape's shares, which tell none from a few."""
    return np.concatenate([x, np.sqrt(np.maximum(x[:, 3:21], 0))], 1)


WIDTH = FEATURES + 18


def weighed(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Expanded features as the model takes them: standardised, without outliers, bins scaled down."""
    z = np.clip((x - mean) / scale, -8, 8)
    z[:, SHAPE:FEATURES] *= BIN_SCALE
    return z


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (weighed(expanded(x), self.mean, self.scale) @ self.weight).astype(float) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _risk_gradient(z: np.ndarray, target: float) -> np.ndarray:
    """Of the logistic loss, towards 1 or 0."""
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target


def _descend(p: np.ndarray, u: np.ndarray, prior: float, steps: int, decay: float, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk; where the unlabelled part is negative, that part is climbed back."""
    w = np.zeros(p.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    p, u = (np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1) for x in (p, u))
    # products in the features' own precision, sums and steps in double
    slope = lambda x, r: (x.T @ r.astype(x.dtype)).astype(float) / len(x)
    for t in range(1, steps + 1):
        zp, zu = ((x @ w.astype(x.dtype)).astype(float) for x in (p, u))
        unlabelled = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        part = slope(u, _risk_gradient(zu, 0)) - prior * slope(p, _risk_gradient(zp, 0))
        g = prior * slope(p, _risk_gradient(zp, 1)) + part if unlabelled >= 0 else -part
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The largest share of positives that the scores of unlabelled rows allow; the model must have seen neither.

    Above a score t, the unlabelled are at least prior * P(positive >= t). The least ratio of the two upper tails
    is the estimate; t goes up to the lowest quarter of the positives, where both tails are known well.
    """
    cut = np.quantile(positive, np.linspace(0.02, 0.25, 12))
    tail_p = (positive[None, :] >= cut[:, None]).mean(1)
    tail_u = (unlabelled[None, :] >= cut[:, None]).mean(1)
    return float(np.clip(np.min(tail_u / tail_p), 0.05, 0.99))


def train_model(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400) -> QualityModel:
    """Fit from rows of ``features``; with no rows of a kind, a model that calls everything good."""
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 2.0, 1.0)
    p, u = expanded(positive), expanded(unlabelled)
    both = np.concatenate([p, u])
    mean, scale = both.mean(0, dtype=float).astype(both.dtype), both.std(0, dtype=float).astype(both.dtype) + np.float32(1e-3)
    del both
    p, u = (weighed(x, mean, scale) for x in (p, u))
    decay = 1e-3 + 4 / min(len(p), len(u))  # few rows bear a plain model only
    scored = []
    for side in (0, 1) if min(len(p), len(u)) > 1 else ():  # each half is scored by a model of the other
        w, b = _descend(p[side::2], u[side::2], 0.5, steps // 2, decay=2 * decay)  # any prior orders the texts
        scored.append(class_prior(p[1 - side :: 2] @ w + b, u[1 - side :: 2] @ w + b))
    prior = float(np.mean(scored)) if scored else 0.5
    w, b = _descend(p, u, prior, steps, decay=decay)
    return QualityModel(mean, scale, w, b, prior)


def _featured(rows: DataFrame, schema: str, keep: int) -> DataFrame:
    """``rows`` with its last column, the text, replaced by the features as 32-bit numbers, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_turn(batches):
            x = [features(t.as_py()).astype("<f4").tobytes() for t in batch.column(keep)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(x, pa.binary())], [*batch.schema.names[:keep], "x"])

    return rows.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, train: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAINING_ROWS) -> QualityModel:
    """Fit on the rows of ``train``: positives have label 1, the unlabelled have no label.

    Of either kind, a share is taken so that about ``rows`` remain (a hash of the id decides). Labels of 0
    are not used. Null ids match no label.
    """
    good = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_label_id")).agg(F.max(label_col).alias("_label"))
    drawn = docs.filter(train).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    ids = drawn.select("_id").join(good, F.col("_id") == F.col("_label_id"), "left").filter("_label IS NULL OR _label = 1")
    sizes = {r["kind"]: r["n"] for r in ids.groupBy(F.col("_label").isNotNull().alias("kind")).agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("_label").isNull(), rows / max(1, sizes.get(False, 0))).otherwise(rows / max(1, sizes.get(True, 0)))
    keys = ids.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < share * 1_000_000).select(F.col("_id").alias("_key"), F.col("_label").isNotNull().alias("good"))
    # about 2 * rows keys, so they go to the texts and not the texts to them
    chosen = drawn.join(F.broadcast(keys.distinct()), F.col("_id") == F.col("_key")).select("good", "_text")
    got = _featured(chosen, "good boolean, x binary", 1).collect()
    part = lambda kind: np.frombuffer(b"".join(r["x"] for r in got if r["good"] is kind), "<f4").reshape(-1, FEATURES)
    return train_model(part(True), part(False))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns of ``keep``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) of each whole text.

    A null text counts as empty; an empty text has a score too. Rows are independent: repeated rows and
    null ids need no special case, an empty table gives an empty result, and other columns are dropped. A
    kept column must not be named as one of the results.
    """
    names = [id_col, *keep]
    rows, at = with_text(docs, names, text_col)
    schema = StructType([*rows.schema.fields[: len(names)], *StructType.fromDDL("score double, predicted int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_turn(batches):
            if batch.num_rows:
                texts = batch.column(at)
                found = np.concatenate([model.score(np.array([features(t.as_py()) for t in texts.slice(a, SLICE)])) for a in range(0, len(texts), SLICE)])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found), pa.array((found >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    return rows.mapInArrow(run, schema)
