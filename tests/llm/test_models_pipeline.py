import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import common, langid, quality
from tallyframe.llm.common import held_out, table
from tallyframe.llm.queries import ORACLE_SQL, QUERIES

from ..compare import SF, database, rows

SF2 = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_against_sql(spark, name):
    found, expected = QUERIES[name](spark, SF).toPandas(), database().sql(ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns) and rows(found) == rows(expected)


def test_language_held_out(spark):
    got = QUERIES["op1_language_id"](spark, SF2).join(table(spark, SF2, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_language_of_mixed_and_odd_texts(spark):
    docs = table(spark, SF2, "documents")
    model = langid.fit(docs, ~held_out())
    by = {r.lang: r.text for r in docs.groupBy("lang").agg(F.max_by("text", "n_chars").alias("text")).collect()}
    _, _, mixed = langid.infer(by["de"][:2000] + " " + by["es"][:1000], model)
    shares = {k: v for k, v in mixed}
    assert set(shares) == {"de", "es"} and abs(shares["de"] - 2 / 3) < 0.1
    odd = [(1, None), (2, ""), (3, "123 ½ ² Ⅷ !!"), (None, by["en"][:200]), (5, "日本語"), (6, by["fr"] * 20), (7, "qzx wvk jjq xkcd pqrz vvqx zzkj wqx"), (8, "Привет мир, как дела сегодня")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in odd], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[None].lang_pred == "en" and got[6].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in got.values()) and all(got[i].score < 0.1 and got[i].lang_pred in model.languages for i in (5, 7, 8))
    long = langid.infer(by["en"] * 5 + " " + by["fr"][:300], model)[2]  # a passage of far less than 1%
    assert {k for k, _ in long} == {"en", "fr"}
    assert langid.identify(df.limit(0), model).collect() == []
    empty = langid.fit(df.limit(0), F.lit(True))
    assert langid.infer("some text", empty)[0] == "und"


def test_mixture_proportions():
    p = np.array([[0.7, 0.1], [0.2, 0.2], [0.1, 0.7]])
    counts = 1000 * (p @ np.array([0.25, 0.75]))
    assert np.allclose(langid.proportions(counts, p, 1e-6)[0], [0.25, 0.75], atol=1e-3)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op10_quality"](spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").toPandas()
    assert len(got) == 10_000 and got["score"].between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    held = got[got.held_out & got.quality.notna()]
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert len(bad) > 100 and (bad.predicted == 0).mean() > 0.95 and good.predicted.mean() > 0.99


def test_chosen_languages_have_the_best_penalised_likelihood():
    r = np.random.default_rng(1)
    for _ in range(60):
        p = r.dirichlet(np.full(40, 0.3), 5).T + 1e-6
        on = r.choice(5, r.integers(1, 4), replace=False)
        counts = r.multinomial(400, (p[:, on] / p[:, on].sum(0)) @ r.dirichlet(np.full(len(on), 2.0))).astype(float)
        cost = 8.0
        best = {}
        for size in range(1, 6):
            for s in itertools.combinations(range(5), size):
                best[s] = langid.proportions(counts, p[:, list(s)])[1] - cost * (size - 1)
        got, share = langid.choose(counts, p, cost)
        assert best[tuple(sorted(got))] >= max(best.values()) - 0.5 and abs(share.sum() - 1) < 1e-6


@pytest.mark.parametrize("text", ["", "a", "ab", "Das Wort das wort %%% é日", "x " * 300])
def test_bins_of_words_and_trigrams(text):
    words, grams = np.zeros(quality.WORD_BINS), np.zeros(quality.GRAM_BINS)
    for w in text.split():
        words[zlib.crc32(w.lower().encode()) % quality.WORD_BINS] += 1
    raw = text.encode()
    for i in range(len(raw) - 2):
        grams[(int.from_bytes(raw[i : i + 3], "big") * 2654435761 % 2**32) >> 24] += 1
    want = np.concatenate([np.sqrt(x / max(1, x.sum())) for x in (words, grams)])
    assert np.allclose(quality.features(text)[quality.SHAPE :], want, atol=1e-6)


def test_words_tell_what_the_shape_does_not():
    """Texts of one shape, good and bad by their words alone."""
    r = np.random.default_rng(5)
    make = lambda names: " ".join(r.choice(names, 60))
    good, bad = [f"{a}olan" for a in "bcdfghjk"], [f"{a}urim" for a in "bcdfghjk"]
    p = np.array([quality.features(make(good)) for _ in range(400)])
    u = np.array([quality.features(make(good if r.random() < 0.5 else bad)) for _ in range(800)])
    model = quality.train_model(p, u)
    score = lambda names: model.score(np.array([quality.features(make(names)) for _ in range(100)]))
    assert (score(good) >= 0.3).mean() > 0.97 and (score(bad) < 0.3).mean() > 0.97 and abs(model.prior - 0.5) < 0.1


def test_quality_of_odd_texts(spark):
    docs, labels = table(spark, SF2, "documents"), table(spark, SF2, "labels")
    model = quality.fit(docs, labels, ~held_out())
    assert 0.5 < model.prior < 0.99
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "x", 5), (4, "word " * 50_000, 5)], "doc_id long, text string, score int")
    got = quality.score(df, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(df.limit(0), model).collect() == []
    none = quality.fit(docs.limit(0), labels.limit(0), F.lit(True))
    assert quality.score(df, none).filter("predicted = 0").isEmpty()


def test_class_prior_of_a_known_mixture():
    r = np.random.default_rng(0)
    good, bad = r.normal(3, 1, 4000), r.normal(-3, 1, 4000)
    mixed = np.concatenate([good[:2100], bad[:900]])
    assert abs(quality.class_prior(good[2100:], mixed) - 0.7) < 0.06


def test_pipeline(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["language_id", "quality", "exact_dedup", "near_dedup", "packing"] and cp.ORACLE_SQL is None
    docs = table(spark, SF, "documents")
    kept = docs
    ids = []
    for _, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns
        ids.append({r.doc_id for r in kept.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and len(ids[0]) == 200
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert {i for i in ids[1] if labels.get(i) == 1} == {i for i in ids[0] if labels.get(i) == 1}
    assert len({r.t for r in kept.select(F.lower("text").alias("t")).collect()}) == len(ids[2] & ids[3])
    out = cp.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == ids[3]


def test_a_run_leaves_only_the_input_of_its_last_stage(spark, tmp_path, monkeypatch):
    import corpus_pipeline as cp

    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}")
    cp.run(spark, SF).count()
    left = {p.name.rpartition("-")[0] for p in tmp_path.iterdir()}
    assert "near_dedup" in left and left <= {"near_dedup", "pieces", *(f"packed{i}" for i in range(9))}


def test_stages_with_columns_named_like_results(spark):
    import corpus_pipeline as cp

    docs = table(spark, SF, "documents").limit(40)
    junk = spark.createDataFrame([(9001, "qzx wvk jjq xkcd pqrz vvqx zzkj wqx", "en", "s", 0)], docs.schema)
    clash = {c: F.lit(i) for i, c in enumerate(("score", "lang_pred", "predicted", "languages", "row", "_row", "_id", "_text", "keep_id", "kept", "component_id", "a b"))}
    rows_ = docs.unionByName(junk).withColumns(clash)
    for _, stage in cp.STAGES[:-1]:
        after = stage(spark, rows_, SF)
        assert after.columns == rows_.columns
        rows_ = spark.createDataFrame(after.collect(), rows_.schema)
    assert 9001 not in {r.doc_id for r in rows_.collect()} and rows_.count() > 20
    assert {r["a b"] for r in rows_.collect()} == {11}


def test_pipeline_with_odd_rows(spark):
    import corpus_pipeline as cp

    docs = table(spark, SF, "documents").limit(60)
    text = docs.first().text
    odd = spark.createDataFrame([(None, text, None, None, None), (9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, text * 50, None, None, None)], docs.schema)
    rows_ = docs.unionByName(odd)
    for _, stage in cp.STAGES[:-1]:
        rows_ = stage(spark, rows_, SF)
    assert {r.doc_id for r in rows_.collect()}.isdisjoint({9001, 9002})
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_pipeline_drops_copies_row_by_row(spark):
    import corpus_pipeline as cp

    words = [" ".join(f"{w}{i}" for i in range(60)) for w in "abcdef"]
    near = words[3] + " end"
    given = [
        (5, words[0]), (9, words[0].upper()), (5, words[1]),  # a repeated id: one copy, one text of its own
        (7, words[2]), (7, words[2]), (None, words[2]),  # a repeated row and a copy without an id
        (None, words[4]), (None, words[4]),  # copies without ids only
        (11, words[3]), (12, near), (12, words[5]), (None, near + " more"),  # near copies, one with another text's id, one without an id
    ]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    order = lambda rows_: sorted(rows_, key=str)
    exact = [(9, words[0].upper()), (5, words[1]), (7, words[2]), (None, words[4]), *given[-4:]]
    found = cp.without_copies(spark, docs, SF)
    assert order(map(tuple, found.collect())) == order(exact)
    found = cp.without_near_copies(spark, found, SF)
    assert order(map(tuple, found.collect())) == order([r for r in exact if r not in (given[9], given[11])])
    # this stage alone on the copies too
    found = cp.without_near_copies(spark, docs.filter("text LIKE 'c0 %' OR text LIKE 'e0 %'"), SF)
    assert order(map(tuple, found.collect())) == order([(7, words[2]), (None, words[4])])
