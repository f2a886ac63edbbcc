"""Supervised text baselines by size of the training set: many small fits side by side, each row predicted by models that haven't seen it.

Every row belongs to one fold. A fold's training rows come from the other folds: a pool of bounded size by hash order,
then nested prefixes of another hash order, one of each observed class first. Each (task, label field, fold, size) is a fit
of its own in a task of its own, and all rows of the fold are predicted by it. Texts become word and word-pair counts,
hashed into ``2 ** BITS`` features, with sublinear counts, inverse document frequencies of the training rows and unit
length; a class-balanced logistic regression takes its strength by cross-validation inside the training rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written
from .corpus import digest_order, top_per_key
from .resample import hash_draw

BITS = 18
SIZES = (50, 100, 250, 500, 1000, 2000)
FOLDS, POOL = 5, 3000
#: Strengths that cross-validation tries, the one taken without it, and the training rows it needs.
STRENGTHS, STRENGTH, LEAST_TUNED = (0.1, 1.0, 10.0), 1.0, 100
#: Columns of a Gram matrix that are multiplied as a dense block at once.
DENSE = 2_048
#: Words whose hashes a worker remembers.
MEMORY = 300_000
FIT = ("task", "label_field", "fold", "size")

_words = re.compile(r"\w\w+").findall


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        found = zlib.crc32(word.encode("utf-8", "replace"))
        if len(self) < MEMORY:
            self[word] = found
        return found


_hashes = _Hashes()


@dataclass
class Counts:
    """How often each row holds each feature: parallel arrays, sorted by row and feature."""

    rows: int
    row: np.ndarray
    feature: np.ndarray
    n: np.ndarray


def features(texts: Sequence[str | None]) -> Counts:
    """Hashed words of two characters or more, in lower case, and pairs of neighbours."""
    hashed = [np.fromiter(map(_hashes.__getitem__, _words((t or "").lower())), np.uint64) for t in texts]
    n = np.fromiter(map(len, hashed), np.int64, len(hashed))
    word = np.concatenate([np.empty(0, np.uint64), *hashed])
    row = np.repeat(np.arange(len(texts)), n)
    mask = np.uint64((1 << BITS) - 1)
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & mask
    near = row[1:] == row[:-1]
    pair = mix(word[:-1] * np.uint64(0x100000001B3) + word[1:])[near]
    keys = np.concatenate([row << BITS | mix(word).astype(np.int64), row[1:][near] << BITS | pair.astype(np.int64)])
    keys, count = np.unique(keys, return_counts=True)
    return Counts(len(texts), keys >> BITS, keys & ((1 << BITS) - 1), count)


def tfidf(counts: Counts, columns: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in ``columns`` and weight of each known feature; rows have unit length."""
    at = np.minimum(np.searchsorted(columns, counts.feature), max(len(columns) - 1, 0))
    known = columns[at] == counts.feature if len(columns) else np.zeros(len(at), bool)
    row, at = counts.row[known], at[known]
    x = (1 + np.log(counts.n[known])) * idf[at]
    length = np.sqrt(np.bincount(row, x * x, counts.rows))
    return row, at, x / length[row]


def gram(rows: int, row: np.ndarray, at: np.ndarray, x: np.ndarray, columns: int) -> np.ndarray:
    """All inner products of sparse rows: common columns as dense blocks, rare ones pair by pair."""
    out = np.zeros((rows, rows))
    df = np.bincount(at, minlength=columns)
    often = np.flatnonzero(df > rows // 50)
    place = np.full(columns, -1)
    place[often] = np.arange(len(often))
    for start in range(0, len(often), DENSE):
        here = (place[at] >= start) & (place[at] < start + DENSE)
        block = np.zeros((rows, min(DENSE, len(often) - start)))
        block[row[here], place[at[here]] - start] = x[here]
        out += block @ block.T
    rare = place[at] < 0
    order = np.argsort(at[rare], kind="stable")
    row, at, x = row[rare][order], at[rare][order], x[rare][order]
    n = np.bincount(at, minlength=columns)
    first = np.cumsum(n) - n
    left = np.repeat(np.arange(len(at)), n[at])
    right = np.arange(len(left)) - np.repeat(np.cumsum(n[at]) - n[at], n[at]) + first[at[left]]
    out += np.bincount(row[left] * rows + row[right], x[left] * x[right], rows * rows).reshape(rows, rows)
    return out


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 200, close: float = 1e-5, kept: int = 10) -> np.ndarray:
    """The least point of a smooth convex function that also gives its gradient, by limited-memory BFGS."""
    value, slope = f(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(slope).max() <= close:
            break
        way, scales = slope.copy(), []
        for s, y, r in reversed(steps):
            scales.append(r * (s @ way))
            way -= scales[-1] * y
        if steps:
            s, y, r = steps[-1]
            way *= (s @ y) / (y @ y)
        for (s, y, r), scale in zip(steps, reversed(scales), strict=True):
            way += (scale - r * (y @ way)) * s
        fall, size = slope @ way, 1.0 if steps else 1 / max(1.0, np.abs(slope).sum())
        while True:
            new = x - size * way
            new_value, new_slope = f(new)
            if new_value <= value - 1e-4 * size * fall or size < 1e-12:
                break
            size /= 2
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12:
            steps = [*steps[-kept + 1 :], (s, y, 1 / (s @ y))]
        x, value, slope = new, new_value, new_slope
        if size < 1e-12:
            break
    return x


def logistic(z: np.ndarray, y: np.ndarray, classes: int, strength: float) -> np.ndarray:
    """Weights, one column a class and the last row the intercepts, of class-balanced logistic regression.

    Two classes have one column, of the second. The loss is half the squared weights plus ``strength`` times the weighted sum of log losses.
    """
    n, width = z.shape
    present = np.bincount(y, minlength=classes)
    weight = strength * (n / (np.count_nonzero(present) * np.maximum(present, 1)))[y]
    columns = 1 if classes == 2 else classes
    target = (y[:, None] == np.arange(classes))[:, -columns:].astype(float)

    def loss(flat: np.ndarray) -> tuple[float, np.ndarray]:
        w = flat.reshape(width + 1, columns)
        score = z @ w[:-1] + w[-1]
        if columns == 1:
            value = weight @ np.logaddexp(0, np.where(target > 0, -score, score))[:, 0]
            p = 0.5 * (1 + np.tanh(score / 2))
        else:
            top = score.max(1, keepdims=True)
            total = np.log(np.exp(score - top).sum(1, keepdims=True)) + top
            value = weight @ (total[:, 0] - (score * target).sum(1))
            p = np.exp(score - total)
        miss = weight[:, None] * (p - target)
        slope = np.vstack([z.T @ miss + w[:-1], miss.sum(0)])
        return value + 0.5 * (w[:-1] ** 2).sum(), slope.ravel()

    return minimised(loss, np.zeros((width + 1) * columns)).reshape(width + 1, columns)


def chosen(score: np.ndarray) -> np.ndarray:
    return (score[:, 0] > 0).astype(int) if score.shape[1] == 1 else score.argmax(1)


def macro_f1(y: np.ndarray, p: np.ndarray) -> float:
    """Mean F1 of the classes that are found on either side."""
    each = [2 * ((y == c) & (p == c)).sum() / ((y == c).sum() + (p == c).sum()) for c in np.union1d(y, p)]
    return float(np.mean(each))


def tuned(z: np.ndarray, y: np.ndarray, classes: int) -> float:
    """The strength with the best mean macro F1 over up to three folds, each with its share of every class."""
    n = np.bincount(y, minlength=classes)
    if len(y) < LEAST_TUNED or n[n > 0].min() < 2:
        return STRENGTH
    folds = max(2, min(3, int(n[n > 0].min())))
    fold = np.empty(len(y), int)
    for c in range(classes):
        mine = np.flatnonzero(y == c)
        fold[mine] = np.arange(len(mine)) % folds
    scores = []
    for strength in STRENGTHS:
        each = []
        for k in range(folds):
            w = logistic(z[fold != k], y[fold != k], classes, strength)
            each.append(macro_f1(y[fold == k], chosen(z[fold == k] @ w[:-1] + w[-1])))
        scores.append(np.mean(each))
    return STRENGTHS[int(np.argmax(np.round(scores, 9)))]


def fitted(texts: list[str | None], gold: list[str]) -> dict:
    """One fit: ``classes``, ``strength``, ``columns`` (features), ``idf``, ``weights`` (by column and class) and ``intercepts``.

    The rows' inner products are factored, so that all fits, those of the folds too, run on as many dense columns as there
    are rows; weights of features follow from the factor.
    """
    classes, y = np.unique(np.array(gold, dtype=object).astype(str), return_inverse=True)
    counts = features(texts)
    columns, df = np.unique(counts.feature, return_counts=True)
    idf = np.log((1 + counts.rows) / (1 + df)) + 1
    if len(classes) == 1 or not len(columns):
        most = int(np.bincount(y).argmax())
        return {"classes": [str(classes[most])], "strength": STRENGTH, "columns": [], "idf": [], "weights": [], "intercepts": [0.0]}
    row, at, x = tfidf(counts, columns, idf)
    factor = np.linalg.cholesky(gram(counts.rows, row, at, x, len(columns)) + 1e-9 * np.eye(counts.rows))
    strength = tuned(factor, y, len(classes))
    w = logistic(factor, y, len(classes), strength)
    by_row = np.linalg.solve(factor.T, w[:-1])
    weights = np.stack([np.bincount(at, x * by_row[row, k], len(columns)) for k in range(w.shape[1])], 1)
    return {"classes": classes.tolist(), "strength": strength, "columns": columns.tolist(), "idf": idf.tolist(), "weights": weights.ravel().tolist(), "intercepts": w[-1].tolist()}


def with_fold(rows: DataFrame, key: str, folds: int = FOLDS, seed: str = "folds") -> DataFrame:
    """Adds ``fold``, which a hash of the key decides."""
    return rows.withColumn("fold", hash_draw(F.lit(folds), F.lit(seed), key).cast("int"))


def training_prefixes(golds: DataFrame, key: str, sizes: Sequence[int] = SIZES, folds: int = FOLDS, pool: int = POOL, seed: str = "train") -> DataFrame:
    """Nested training rows: ``task, label_field, fold, key, gold, place, n_pool``; those of a size have the places below it.

    ``golds`` has task, label_field, ``key``, gold and fold. A fold's pool is the ``pool`` first rows of the others by digest order; only so many
    rows of each fold move. In the pool the first row of each class by the fold's own order comes before all others.
    """
    digest = digest_order(seed, key)
    cell = ["task", "label_field"]
    near = top_per_key(golds, [*cell, "fold"], [digest, F.col(key)], pool)
    others = near.withColumn("_other", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))))
    others = top_per_key(others.drop("fold").withColumnRenamed("_other", "fold"), [*cell, "fold"], [digest, F.col(key)], pool)
    own = digest_order(f"{seed} order", "fold", key)
    cells = W.partitionBy(*cell, "fold")  # at most ``pool`` rows
    of_class = F.row_number().over(W.partitionBy(*cell, "fold", "gold").orderBy(own, key))
    others = others.withColumn("_first", of_class == 1).withColumn("n_pool", F.count("*").over(cells))
    place = F.row_number().over(cells.orderBy(F.desc("_first"), own, key)) - 1
    return others.withColumn("place", place).filter(F.col("place") < max(sizes)).select(*cell, "fold", key, "gold", "place", "n_pool")


_MODEL = "task string, label_field string, fold int, size int, classes array<string>, strength double, columns array<int>, idf array<double>, weights array<double>, intercepts array<double>"


def fit_models(prefixes: DataFrame, texts: DataFrame, key: str, text: str = "text", sizes: Sequence[int] = SIZES, largest: bool = False) -> DataFrame:
    """A fit for each task, label field, fold and size whose pool is large enough, or for the ``largest`` such size alone.

    Each is one group of at most ``size`` rows.
    """
    held = F.filter(F.array(*map(F.lit, sorted(sizes))), lambda s: s <= F.col("n_pool"))
    held = F.slice(held, -1, 1) if largest else held
    rows = prefixes.filter(F.size(held) > 0).select("*", F.explode(held).alias("size")).filter("place < size").select(*FIT, key, "place", "gold")
    few = rows.select(key).distinct()
    found = texts.join(few, key, "left_semi").select(key, F.col(text).alias("_text"))
    rows = rows.join(found, key)

    def fit(name: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table["place"].to_numpy())
        model = fitted(table["_text"].take(order).to_pylist(), table["gold"].take(order).to_pylist())
        cell = {c: [v.as_py()] for c, v in zip(FIT, name, strict=True)}
        return pa.table(cell | {k: [v] for k, v in model.items()}, schema=_arrow())

    return rows.groupBy(*FIT).applyInArrow(fit, _MODEL)


def _arrow() -> pa.Schema:
    numbers = {"columns": pa.int32(), "idf": pa.float64(), "weights": pa.float64(), "intercepts": pa.float64()}
    fields = [("task", pa.string()), ("label_field", pa.string()), ("fold", pa.int32()), ("size", pa.int32()), ("classes", pa.list_(pa.string())), ("strength", pa.float64())]
    return pa.schema([*fields, *((k, pa.list_(v)) for k, v in numbers.items())])


def predict_out_of_fold(texts: DataFrame, models: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Every row under all models of its fold: ``key, task, label_field, fold, size, pred``. ``texts`` has ``fold``.

    Rows are dealt out by fold and split, and each split gets the models of its fold before its rows: at most one for each task, label field and
    size, each of no more than ``2 ** BITS`` features, however many rows there are. No model reaches the driver.
    """
    splits = -(-2 * texts.sparkSession.sparkContext.defaultParallelism // FOLDS)
    kind = texts.schema[key].dataType
    parts = {"columns": F.col("columns"), "idf": F.col("idf"), "weights": F.col("weights").cast("array<float>"), "intercepts": F.col("intercepts")}
    fits = written(models, "models").select("fold", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("_split"), F.lit(0).alias("_order"), F.struct("task", "label_field", "size", "classes", *(c.alias(n) for n, c in parts.items())).alias("_model"))
    rows = texts.filter("fold IS NOT NULL").select("fold", F.pmod(F.xxhash64(key), F.lit(splits)).cast("int").alias("_split"), F.lit(1).alias("_order"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    both = rows.unionByName(fits, allowMissingColumns=True)
    both = both.repartitionById(FOLDS * splits, F.pmod(F.col("fold") * splits + F.col("_split"), F.lit(FOLDS * splits))).sortWithinPartitions("fold", "_split", "_order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, found = None, []
        for batch in batches:
            fold, split, order = (batch.column(c).to_numpy() for c in ("fold", "_split", "_order"))
            cuts = [0, *(np.flatnonzero((np.diff(fold) != 0) | (np.diff(split) != 0)) + 1).tolist(), len(fold)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                if place != (fold[start], split[start]):
                    place, found = (fold[start], split[start]), []
                first = start + int(np.searchsorted(order[start:end], 1))
                found += [_loaded(batch.column("_model"), i) for i in range(start, first)]
                for at in range(first, end, 500):
                    few = slice(at, min(at + 500, end))
                    counts = features(batch.column("_text")[few].to_pylist())
                    for model in found:
                        yield _predicted(batch.column("_key")[few], int(fold[start]), counts, *model)

    out = both.mapInArrow(run, f"_key {kind.simpleString()}, task string, label_field string, fold int, size int, pred string")
    return out.withColumnRenamed("_key", key)


def _loaded(models: pa.StructArray, i: int) -> tuple:
    """A model of a batch, in arrays of its own."""
    task, field, size, classes = (models.field(c)[i].as_py() for c in ("task", "label_field", "size", "classes"))
    columns, idf, weights, intercepts = (np.array(models.field(c)[i].values.to_numpy(zero_copy_only=False)) for c in ("columns", "idf", "weights", "intercepts"))
    n = len(columns)
    return task, field, size, classes, columns.astype(np.int64), idf, weights.reshape(n, -1) if n else None, intercepts


def _predicted(keys: pa.Array, fold: int, counts: Counts, task: str, field: str, size: int, classes: list[str], columns: np.ndarray, idf: np.ndarray, weights: np.ndarray | None, intercepts: np.ndarray) -> pa.RecordBatch:
    score = np.tile(intercepts, (counts.rows, 1))
    if len(columns):
        row, place, x = tfidf(counts, columns, idf)
        score += np.stack([np.bincount(row, x * weights[place, k], counts.rows) for k in range(weights.shape[1])], 1)
    pred = [classes[i] for i in chosen(score)] if len(classes) > 1 else classes * counts.rows
    fixed = [pa.array([v] * counts.rows, t) for v, t in ((task, pa.string()), (field, pa.string()), (fold, pa.int32()), (size, pa.int32()))]
    return pa.RecordBatch.from_arrays([keys, *fixed, pa.array(pred, pa.string())], ["_key", *FIT, "pred"])


def crossover(curve: DataFrame, size: str, score: str, reference: Column, by: Sequence[str]) -> DataFrame:
    """The smallest size whose mean score over folds reaches the reference; null where none does."""
    means = curve.groupBy(*by, size).agg(F.avg(score).alias("_m"), F.max(reference).alias("_r"))
    return means.groupBy(*by).agg(F.min(F.when(F.col("_m") >= F.col("_r"), F.col(size))).alias("crossover"), F.max("_r").alias("reference"))
