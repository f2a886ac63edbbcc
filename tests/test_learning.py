"""Supervised baselines against dense fits and prefixes taken by hand."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyframe.operators import learning as s

WORDS = {"a": "alpha beta gamma delta common words".split(), "b": "uno dos tres cuatro common words".split(), "c": "eins zwei drei vier common words".split()}


def texts(n, seed=1):
    rnd = random.Random(seed)
    labels = [rnd.choice("aabbc") for _ in range(n)]
    return labels, [" ".join(rnd.choice(WORDS[c] + ["noise", "common"]) for _ in range(rnd.randint(0, 12))) for c in labels]


def counted(text):
    words = [zlib.crc32(w.encode()) for w in re.findall(r"\w\w+", text.lower())]
    mix = lambda x: (x * 0x9E3779B97F4A7C15 % 2**64 >> 40) % 2**s.BITS
    return Counter([mix(w) for w in words] + [mix((a * 0x100000001B3 + b) % 2**64) for a, b in zip(words, words[1:], strict=False)])


def dense(train, test):
    """TF-IDF matrices of both, with frequencies of the first."""
    rows = [counted(t) for t in train]
    columns = sorted(set().union(*rows))
    df = np.array([sum(c in r for r in rows) for c in columns])
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    out = []
    for group in (rows, [counted(t) for t in test]):
        x = np.array([[(1 + np.log(r[c])) * i if r[c] else 0.0 for c, i in zip(columns, idf, strict=True)] for r in group])
        out.append(x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-12))
    return out


def scores(x, y, k, z, strength=1.0, steps=30_000):
    """Balanced softmax regression, or logistic regression of two classes, by plain descent; scores of ``z``."""
    n = np.bincount(y, minlength=k)
    weight = strength * (len(y) / (k * n))[y][:, None]
    columns = 1 if k == 2 else k
    target = (y[:, None] == np.arange(k))[:, -columns:]
    one = np.hstack([x, np.ones((len(x), 1))])
    decay = np.vstack([np.ones((x.shape[1], 1)), [[0.0]]])
    w = np.zeros((one.shape[1], columns))
    rate = 1 / (1 + 0.5 * weight.sum())
    for _ in range(steps):
        score = one @ w
        p = 1 / (1 + np.exp(-score)) if columns == 1 else np.exp(score) / np.exp(score).sum(1, keepdims=True)
        w -= rate * (one.T @ (weight * (p - target)) + decay * w)
    return np.hstack([z, np.ones((len(z), 1))]) @ w


@pytest.mark.parametrize("kinds", ["abc", "ab"])
def test_fit_equals_a_dense_one(kinds):
    labels, rows = texts(70)
    labels, rows = zip(*[(c, t) for c, t in zip(labels, rows, strict=True) if c in kinds], strict=True)
    train, test = list(rows[:40]), list(rows[40:]) + ["", "never seen tokens", "alpha uno"]
    model = s.fitted(train, list(labels[:40]))
    x, z = dense(train, test)
    classes = sorted(set(labels[:40]))
    want = scores(x, np.array([classes.index(c) for c in labels[:40]]), len(classes), z)
    row, at, v = s.tfidf(s.features(test), np.array(model["columns"]), np.array(model["idf"]))
    weights = np.array(model["weights"]).reshape(len(model["columns"]), -1)
    got = np.stack([np.bincount(row, v * weights[at, k], len(test)) for k in range(weights.shape[1])], 1) + model["intercepts"]
    assert model["classes"] == classes and model["strength"] == 1.0
    assert np.abs(got - want).max() < 2e-3


def test_gram_of_common_and_rare_columns():
    rows = texts(150)[1] + [""]
    counts = s.features(rows)
    columns, df = np.unique(counts.feature, return_counts=True)
    row, at, x = s.tfidf(counts, columns, np.log((1 + len(rows)) / (1 + df)) + 1)
    wide = np.zeros((len(rows), len(columns)))
    wide[row, at] = x
    assert df.max() > len(rows) // 50 >= df.min()
    assert np.allclose(s.gram(len(rows), row, at, x, len(columns)), wide @ wide.T)


def test_strength_is_chosen_inside_the_training_rows():
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(120, 5))
    y = (x[:, 0] > 0).astype(int)
    best = {c: np.mean([s.macro_f1(y[f == k], s.chosen(x[f == k] @ (w := s.logistic(x[f != k], y[f != k], 2, c))[:-1] + w[-1])) for k in range(3)]) for c in s.STRENGTHS for f in [order(y)]}
    assert s.tuned(x, y, 2) == max(best, key=lambda c: (round(best[c], 9), -c))
    assert s.tuned(x[:50], y[:50], 2) == s.STRENGTH


def order(y):
    fold = np.empty(len(y), int)
    for c in np.unique(y):
        fold[y == c] = np.arange((y == c).sum()) % 3
    return fold


def digest(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def prefixes_by_hand(golds, sizes, folds, pool):
    out = set()
    for fold in range(folds):
        here = sorted((r for r in golds if r[3] != fold), key=lambda r: (digest("train", r[1]), r[1]))[:pool]
        by_own = sorted(here, key=lambda r: (digest("train order", fold, r[1]), r[1]))
        first = {}
        for r in by_own:
            first.setdefault(r[2], r)
        order = [r for r in by_own if first[r[2]] is r] + [r for r in by_own if first[r[2]] is not r]
        out |= {(fold, r[1], r[2], i, len(here)) for i, r in enumerate(order) if i < max(sizes)}
    return out


def test_prefixes_and_predictions(spark):
    labels, rows = texts(90, 5)
    df = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(zip(rows, labels, strict=True))] + [(90, None, "a")], "id long, text string, gold string")
    docs = s.with_fold(df, "id", 3)
    fold = {r.id: r.fold for r in docs.collect()}
    assert all(f == int(digest("folds", i)[:8], 16) % 3 for i, f in fold.items())
    golds = docs.selectExpr("'t' AS task", "'f' AS label_field", "id", "gold", "fold")
    sizes, pool = (10, 20, 40), 50
    found = s.training_prefixes(golds, "id", sizes, 3, pool)
    assert {(r.fold, r.id, r.gold, r.place, r.n_pool) for r in found.collect()} == prefixes_by_hand([("t", r.id, r.gold, r.fold) for r in golds.collect()], sizes, 3, pool)
    models = s.fit_models(found, docs, "id", sizes=(*sizes, 51))
    assert {(m.fold, m["size"]) for m in models.collect()} == {(f, n) for f in range(3) for n in sizes}
    assert {m["size"] for m in s.fit_models(found, docs, "id", sizes=(*sizes, 51), largest=True).collect()} == {40}
    got = {(r.id, r["size"]): r.pred for r in s.predict_out_of_fold(docs, models, "id").collect()}
    assert len(got) == 91 * 3
    data, train = {r.id: (r.text or "", r.gold) for r in docs.collect()}, found.collect()
    for f in range(3):
        test = sorted(i for i in fold if fold[i] == f)
        for size in sizes:
            mine = sorted((r for r in train if r.fold == f and r.place < size), key=lambda r: r.place)
            assert not {r.id for r in mine} & set(test)
            classes = sorted({r.gold for r in mine})
            x, z = dense([data[r.id][0] for r in mine], [data[i][0] for i in test])
            want = scores(x, np.array([classes.index(r.gold) for r in mine]), len(classes), z, steps=8_000)
            for i, score in zip(test, want, strict=True):
                if np.sort(score)[-1] - np.sort(score)[-2] > 0.02:
                    assert got[i, size] == classes[int(score.argmax())]


def test_one_class_and_no_words(spark):
    assert s.fitted(["x y", ""], ["k", "k"])["classes"] == ["k"]
    assert s.fitted(["", None, ""], ["k", "j", "k"])["classes"] == ["k"]


def test_crossover(spark):
    rows = [("t", n, f, v) for n, values in ((50, (0.2, 0.4)), (100, (0.5, 0.7)), (250, (0.9, 0.9))) for f, v in enumerate(values)] + [("u", 50, 0, 0.1), ("v", 50, 0, None)]
    df = spark.createDataFrame(rows, "task string, size int, fold int, f1 double").selectExpr("*", "CASE task WHEN 't' THEN 0.6 ELSE 0.5 END AS best")
    assert {r.task: r.crossover for r in s.crossover(df, "size", "f1", df["best"], ["task"]).collect()} == {"t": 100, "u": None, "v": None}
