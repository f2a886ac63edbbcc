"""Numbers from texts, orders, lines of tables, audits of stages, slopes against a null, sums under weights."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import text as t
from tallyframe.operators import contracts as q
from tallyframe.operators import corpus as c
from tallyframe.operators import metrics as m
from tallyframe.operators import ranking as k
from tallyframe.operators import reshape as r
from tallyframe.operators import resample as b
from tallyframe.operators import state
from tallyframe.operators.baseline import nearest_centroid_out_of_fold
from tallyframe.operators.draws import weighted_sums
from tallyframe.sources import sinks


def test_numbers_from_texts(spark):
    df = spark.createDataFrame([(" 1.5 ",), ("",), (None,), ("x1",), ("-2",)], "v string")
    assert [x[0] for x in df.select(t.number("v")).collect()] == [1.5, None, None, None, -2.0]
    assert [x[0] for x in df.filter("v <> 'x1' OR v IS NULL").select(t.number("v", on_bad="raise")).collect()] == [1.5, None, None, -2.0]
    with pytest.raises(Exception, match="no number: x1"):
        df.select(t.number("v", on_bad="raise")).collect()


def test_natural_order(spark):
    df = spark.createDataFrame([("b10",), ("b9",), ("a",), ("a10",), (None,), ("99999999999999999999x",)], "v string")
    assert [x.v for x in df.orderBy(t.natural_key("v")).collect()] == ["b9", "a10", "b10", "99999999999999999999x", None, "a"]


def test_columns_in_order(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`z.a` int, y_1 int, x int, y_2 int")
    assert r.columns_in_order(df, ["x"], ["y_"]).columns == ["x", "y_1", "y_2", "z.a"]
    assert r.columns_in_order(df, ["y_2"], ["y_"], rest=False).columns == ["y_2", "y_1"]


def test_rendered_tables(spark):
    df = spark.createDataFrame([("a|b_&<", 0.12345, None)], "name string, f1 double, `x_y` int")
    assert sinks.rendered(df, "markdown", 2) == "| name | f1 | x_y |\n| --- | --- | --- |\n| a\\|b_&< | 0.12 |  |"
    assert sinks.rendered(df, "latex", 2) == "\\begin{tabular}{lll}\nname & f1 & x\\_y \\\\ \\hline\na|b\\_\\&< & 0.12 &  \\\\\n\\end{tabular}"
    assert sinks.rendered(df, "html", 1) == "<table>\n<tr><th>name</th><th>f1</th><th>x_y</th></tr>\n<tr><td>a|b_&amp;&lt;</td><td>0.1</td><td></td></tr>\n</table>"
    with pytest.raises(ValueError, match="more than 3"):
        sinks.rendered(spark.range(4), "html", most=3)


def test_stage_findings(spark):
    rows = [("p", "t", "1", 10, 5, "stop"), ("p", "t", "2", None, 5, "stop"), ("p", "t", "3", 95, 8, "length"), ("p", "t", "3", 1, 1, "stop"), ("p", "t", "9", 1, 11, "stop"), ("r", "t", "1", 1, 10, "stop")]
    answers = spark.createDataFrame(rows, "stage string, task string, item_id string, prompt_tokens int, output_tokens int, finish_reason string")
    expected = spark.createDataFrame([("p", "t", x) for x in "1234"] + [("r", "t", "1"), ("s", "t", "1")], "stage string, task string, item_id string")
    limits = spark.createDataFrame([("p", 100, 10), ("r", 100, 10)], "stage string, context int, max_output int")
    got = {(x.stage, x.item_id, x.finding) for x in q.answer_findings(answers, expected, limits).collect()}
    assert got == {("p", "2", "no usage"), ("p", "3", "repeated"), ("p", "3", "over context"), ("p", "3", "truncated"), ("p", "4", "missing"), ("p", "9", "not expected"), ("p", "9", "output over limit"), ("r", "1", "truncated"), ("s", "1", "missing")}
    cover = {x.stage: (x.due, x.answered, x.passed) for x in q.stage_coverage(answers.filter("item_id = '1' AND stage = 'p'"), expected.filter("item_id = '1'"), limits).collect()}
    assert cover == {"p": (1, 1, True), "r": (1, 0, False), "s": (1, 0, False)}


def test_cells_without_rows_are_broken(spark):
    panel = spark.createDataFrame([("t", "1"), ("t", "2"), ("u", "1")], "task string, item_id string")
    rows = spark.createDataFrame([("t", "m", "1", "h"), ("t", "m", "2", "h"), ("u", "m", "9", "h"), ("u", "n", "1", "old")], "task string, model string, item_id string, panel_hash string")
    got = {(x.task, x.model): (x.rows, x.matched, x.panel, x.same_panel) for x in q.broken_cells(rows, panel, "h", rows.select("model")).collect()}
    assert got == {("u", "m"): (1, 0, 1, True), ("u", "n"): (1, 1, 1, False), ("t", "n"): (0, 0, 2, False)}
    assert ("t", "n") not in {(x.task, x.model) for x in q.broken_cells(rows, panel, "h").collect()}


def test_reusable_and_missing_keys(spark):
    expected = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "k string")
    done = spark.createDataFrame([("a", None), ("a", None), ("b", "bad"), ("z", None)], "k string, e string")
    kept, missing = state.split_reusable(expected, done, ["k"], F.col("e").isNull())
    assert [x.k for x in kept.collect()] == ["a"] and sorted(x.k for x in missing.collect()) == ["b", "c"]


def test_speed_up_and_stacked_cells(spark):
    rows = spark.createDataFrame([("a", 1, 4.0), ("a", 10, 2.0), ("b", 10, 1.0)], "g string, n int, s double")
    assert {(x.g, x.n): (x.speed_up, x.delta) for x in k.speed_up(rows, ["g"], "n", "s").collect()} == {("a", 1): (1.0, 0.0), ("a", 10): (2.0, -2.0), ("b", 10): (None, None)}
    cells = {(x.dimension, x.cell): (x["mean"], x.n) for x in k.stacked(rows, [["g"], ["g", "n"], []], "s").collect()}
    assert cells == {("g", "a"): (3.0, 2), ("g", "b"): (1.0, 1), ("g+n", "a/1"): (4.0, 1), ("g+n", "a/10"): (2.0, 1), ("g+n", "b/10"): (1.0, 1), ("all", "all"): (7 / 3, 3)}


def test_several_fields_and_label_tuples(spark):
    rows = [("t", "multi_binary", "m", str(i), f, g, p, None) for i, (a, b_) in enumerate([("11", "11"), ("10", "11"), ("01", "00"), ("11", "10")]) for f, g, p in (("x", a[0], b_[0]), ("y", a[1], b_[1]))]
    df = spark.createDataFrame(rows, "task string, kind string, model string, item_id string, label_field string, gold string, pred string, parse_error string")
    got = m.multi_binary_behaviour(df).first()
    assert got.fields == 2 and got.accuracy == pytest.approx((1.0 + 0.25) / 2) and got.f1 == pytest.approx((1.0 + 0.4) / 2)
    tuples = m.effective_tuples(df).first()
    assert tuples.n_labels == 3 and tuples.effective_labels == pytest.approx(np.exp(-(0.5 * np.log(0.5) + 2 * 0.25 * np.log(0.25))))


def test_texts_of_a_sample(spark):
    sample = spark.createDataFrame([(1, "a"), (2, "b")], "id int, n string")
    assert {x.id: x.text for x in c.with_item_texts(sample, spark.createDataFrame([(1, "whole")], "id int, text string"), ["id"]).collect()} == {1: "whole", 2: None}


def draws(seed, task, iteration, n):
    out = []
    for chunk in range(-(-n // 8)):
        raw = hashlib.sha256(f"{seed}|{task}|{iteration}|{chunk}".encode()).hexdigest()
        out += [int(raw[8 * i : 8 * i + 8], 16) % n for i in range(8)]
    return out[:n]


@pytest.mark.parametrize("n", [3, 70])
def test_weighted_sums_by_force(spark, n):
    rnd = random.Random(n)
    rows = [(task, pos, rnd.choice(["a", None, "b"]), rnd.random()) for task, size in (("x", n), ("y", 2 * n)) for pos in range(size) for _ in range(rnd.randint(0, 2))]
    sizes = spark.createDataFrame([("x", n), ("y", 2 * n), ("none", 5)], "task string, n long")
    df = spark.createDataFrame(rows, "task string, pos long, g string, v double").repartition(3)
    got = {(x.task, x.g, x.b): (x.s, x.n) for x in weighted_sums(df, sizes, 6, "seed", "task", "pos", ["g"], {"s": F.col("v"), "n": F.lit(1.0)}, chunk=4).collect()}
    want = {}
    for task, size in (("x", n), ("y", 2 * n)):
        for iteration in range(1, 7):
            weight = np.bincount(draws("seed", task, iteration, size), minlength=size)
            for name in {g for x, _, g, _ in rows if x == task}:
                mine = [(weight[pos], v) for x, pos, g, v in rows if x == task and g == name]
                want[task, name, iteration] = (sum(w * v for w, v in mine), sum(w for w, _ in mine))
    assert got.keys() == want.keys() and all(got[key] == pytest.approx(want[key]) for key in want)


def test_slope_against_a_null(spark):
    rnd = random.Random(1)
    rows = [(f"u{i:02d}", float(i), 2.0 * i + rnd.random()) for i in range(12)]
    df = spark.createDataFrame(rows, "u string, x double, y double")
    got = b.slope_against(df, "u", "x", "y", 50, 2.0).first()
    x, y = np.array([v[1] for v in rows]), np.array([v[2] for v in rows])
    gaps = []
    for iteration in range(1, 51):
        w = np.bincount(draws("mean", "u", iteration, 12), minlength=12)
        gaps.append(np.polyfit(x, y, 1, w=np.sqrt(w))[0] - 2 if (w > 0).sum() > 1 else np.nan)
    assert got.slope == pytest.approx(np.polyfit(x, y, 1)[0]) and got.difference == pytest.approx(got.slope - 2)
    assert np.allclose([got.low, got.high], np.quantile(gaps, [0.025, 0.975]), atol=1e-6)
    assert got.p_value == pytest.approx(min(1, 2 * (1 + min(sum(g <= 0 for g in gaps), sum(g >= 0 for g in gaps))) / 51))


def test_centroids_of_other_folds(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, i % 3, "ab"[i % 2], (rnd.normal(size=4) + (i % 2) * 2).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, fold long, label string, v array<double>")
    got = {x.id: x.pred for x in nearest_centroid_out_of_fold(df, "v", "label", "id", "fold").collect()}
    for i, fold, _, v in rows:
        dots = {}
        for name in "ab":
            mean = np.mean([w for _, f, g, w in rows if f != fold and g == name], 0)
            dots[name] = np.dot(v, mean / np.linalg.norm(mean))
        assert got[i] == max(dots, key=dots.get)
