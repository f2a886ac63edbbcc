import pytest
from pyspark.sql import functions as F

from tallyframe.functions import parse as p
from tallyframe.functions import text as t

LANG = p.AnswerSpec("categorical", ("topic",), ("War", "Trade", "Trade policy"))
YES = p.AnswerSpec("binary", ("relevant",))
BOTH = p.AnswerSpec("multi_binary", ("a", "b"))
SCORE = p.AnswerSpec("score", ("s",), low=0, high=10)


@pytest.mark.parametrize(
    ("text", "spec", "pred"),
    [
        ('{"relevant": 1}', YES, {"relevant": "1"}),
        ('```json\n{"Relevant": "yes"}\n```', YES, {"relevant": "1"}),
        ("```\n0\n```", YES, {"relevant": "0"}),
        ('[{"relevant": false}]', YES, {"relevant": "0"}),
        ("'1'.", YES, {"relevant": "1"}),
        ('{"relevant": 1.0} and more', YES, {"relevant": "1"}),
        ('{"topic": "trade."}', LANG, {"topic": "Trade"}),
        ("It is about trade policy here", LANG, {"topic": "Trade policy"}),
        ('{"a": true, "b": "no"}', BOTH, {"a": "1", "b": "0"}),
        ('{"s": "7.5"}', SCORE, {"s": "7.5"}),
        ("8", SCORE, {"s": "8"}),
    ],
)
def test_good_answers(text, spec, pred):
    assert p.parse_answer(text, spec) == (pred, None)


@pytest.mark.parametrize(
    ("text", "spec"),
    [("", YES), (None, YES), ('{"other": 1}', YES), ("maybe", YES), ('{"topic": "Peace, not War"}', LANG), ("War or Trade", LANG), ("postwar", LANG), ('{"a": 1}', BOTH), ("1", BOTH), ('{"s": 11}', SCORE), ('{"s": true}', SCORE)],
)
def test_bad_answers(text, spec):
    pred, error = p.parse_answer(text, spec)
    assert pred is None and error


STANCE = p.AnswerSpec("categorical", ("stance",), ("Support", "Not Support", "Oppose"))


@pytest.mark.parametrize(
    ("text", "spec", "pred"),
    [
        ("2 - Oppose", STANCE, {"stance": "Oppose"}),
        ('"Oppose because"', STANCE, {"stance": "Oppose"}),
        ("Support, Not Support", STANCE, {"stance": "Not Support"}),
        ('["Oppose"]', STANCE, {"stance": "Oppose"}),
        ("Oppose, Support", STANCE, None),
        ('{"relevant": [1]}', YES, None),
        ('{"relevant": "(1)"}', YES, None),
        ("[1]", YES, None),
        ('well, {"relevant": 1}', YES, None),
        ("true story", YES, {"relevant": "1"}),
        ('{"s": "[7]"}', SCORE, None),
        ('"7"', SCORE, {"s": "7"}),
        ("7.50!", SCORE, {"s": "7.5"}),
        ('{"Relevant ": 0, "relevant": 1}', YES, {"relevant": "1"}),
    ],
)
def test_answers_at_the_edge(text, spec, pred):
    assert p.parse_answer(text, spec)[0] == pred


@pytest.mark.parametrize("text", ['{"s": "N/A"}', '{"s": null}', '{"s": ""}', "none", "", "null", '"n/a"'])
def test_void_scores(text):
    assert p.parse_answer(text, SCORE) == (None, "not_applicable")


@pytest.mark.parametrize("text", ['[{"relevant": 1}, {"relevant": 0}]', '{"results": [{"relevant": 1}, {"relevant": 0}]}', '{"relevant": 1}\n{"relevant": 0}', "[1, 0]"])
def test_batches(text):
    assert [x[1] for x in p.parse_batch(text, 2, YES)] == [{"relevant": "1"}, {"relevant": "0"}]


@pytest.mark.parametrize("text", ["[1]", "[1, 0, 1]", "nothing", None])
def test_a_batch_of_another_size_is_void(text):
    assert all(x[1] is None and x[2] for x in p.parse_batch(text, 2, YES))


def test_strict_objects(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ('{"a": 1.0}',), ('{"a": true}',), ('{"a": 1, "b": 0}',), ("no",)], "raw string")
    assert [r[0] for r in rows.select(p.strict_object(F.col("raw"), ["a"])).collect()] == [True, False, False, False, False]
    odd = ['{"a": {"a": 1}}', '{"a": 2}', '{"a": "1"}', '{"a": [1]}', "[1]", None, '{"a": 0, "b": {"a": 1}}', '{"x": "\\"a\\": 1", "a": 1}']
    rows = spark.createDataFrame([(x,) for x in odd], "raw string")
    assert not any(r[0] for r in rows.select(p.strict_object(F.col("raw"), ["a"])).collect())
    typed = spark.createDataFrame([('{"s": 1.5}',), ('{"s": 7}',), ('{"s": "7"}',), ('{"s": 70}',)], "raw string")
    assert [r[0] for r in typed.select(p.strict_object(F.col("raw"), ["s"], "score", low=0, high=10)).collect()] == [True, True, False, False]
    named = spark.createDataFrame([('{"l": "x"}',), ('{"l": "z"}',), ('{"l": 1}',)], "raw string")
    assert [r[0] for r in named.select(p.strict_object(F.col("raw"), ["l"], "label", labels=("x", "1"))).collect()] == [True, False, False]


def test_text_functions(spark):
    rows = spark.createDataFrame([("  a  b\n", "05Jan2014 10:11:12", "(1999; 2004)", "x #SemST", None)], "a string, d string, y string, h string, n string")
    got = rows.select(
        t.clean_text("a").alias("a"), t.clean_text("n").alias("n"), t.word_count("n").alias("w"), t.parsed_time("d").cast("string").alias("d"), t.cited_year("y").alias("y"), t.cited_year("y", True).alias("z"),
        t.without_hashtag("h", "SemST").alias("h"), t.clean_html_text(F.lit("a &lt; b &amp; c")).alias("u"), t.money(F.lit("0.1234561")).cast("string").alias("m"), t.canonical_sha256({"b": F.lit(1), "a": F.lit("x")}).alias("s"),
    ).first()
    import hashlib

    assert (got.a, got.n, got.w, got.d, got.y, got.z, got.h, got.u) == ("a b", "", 0, "2014-01-05 10:11:12", 1999, 2004, "x", "a < b & c")
    assert got.m == "0.123457" and got.s == hashlib.sha256(b'{"a":"x","b":1}').hexdigest()


def test_unmapped_labels_stop(spark):
    rows = spark.createDataFrame([("x",), ("q",)], "c string")
    with pytest.raises(Exception, match="no mapping for q"):
        rows.select(t.mapped_or_fail("c", {"x": "y"})).collect()
