import pytest
from pyspark.sql import functions as F

from tallyframe.operators import metrics as m
from tallyframe.operators import ranking as k
from tallyframe.operators import resample as b

SCHEMA = "task string, kind string, model string, label_field string, item_id string, gold string, pred string, gold_num double, pred_num double, parse_error string"
LABELS = "task string, kind string, label_field string, label string, pos int, ordinal boolean"


def decisions(spark, kind, rows, task="t", model="a"):
    data = [(task, kind, model, task, str(i), g, p, float(g) if kind == "score" else None, float(p) if kind == "score" and p else None, e) for i, (g, p, e) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def labels(spark, kind, names, ordinal=False):
    return spark.createDataFrame([("t", kind, "t", x, i, ordinal) for i, x in enumerate(names)], LABELS)


def test_no_positive_predicted(spark):
    rows = decisions(spark, "binary", [("1", "0", None), ("0", "0", None), ("0", "0", None)])
    got = m.binary_behaviour(rows).first()
    assert (got.precision, got.recall, got.f1, got.negative_recall) == (0, 0, 0, 1)


def test_all_malformed_binary(spark):
    rows = decisions(spark, "binary", [("1", None, "x"), ("0", None, "x")])
    got = m.binary_behaviour(rows).first()
    assert (got.f1, got.recall, got.accuracy, got.valid_rate) == (0, 0, 0, 0)
    assert got.pred_rate is None and got.bias is None
    assert m.headline_f1(m.with_policy(rows, "wrong"), labels(spark, "binary", ["1"])).first().headline_f1 == 0


def test_label_without_support(spark):
    rows = decisions(spark, "categorical", [("x", "x", None), ("y", "x", None), ("y", "y", None), ("x", None, "bad")])
    names = labels(spark, "categorical", ["x", "y", "z"])
    drop, wrong = m.with_policy(rows, "drop"), m.with_policy(rows, "wrong")
    one = lambda df, only: m.headline_f1(df, names, only).first().headline_f1
    assert one(drop, True) == pytest.approx((2 / 3 + 2 / 3) / 2)
    assert one(drop, False) == pytest.approx((2 / 3 + 2 / 3) / 3)
    assert one(wrong, True) == pytest.approx((2 / 4 + 2 / 3) / 2)


def test_empty_frame_has_no_headline(spark):
    rows = decisions(spark, "binary", []) if False else decisions(spark, "binary", [("1", "1", None)]).limit(0)
    assert m.headline_f1(rows, labels(spark, "binary", ["1"])).collect() == []


def test_policy_name_is_checked(spark):
    with pytest.raises(ValueError, match="drop or wrong"):
        m.with_policy(decisions(spark, "binary", [("1", "1", None)]), "ignore")


def test_answer_outside_domain_is_wrong(spark):
    rows = decisions(spark, "categorical", [("x", "q", None), ("x", "x", None)])
    got = m.with_policy(rows, "wrong", labels(spark, "categorical", ["x", "y"])).filter("item_id = '0'").first()
    assert got.pred == m.MISS


def test_constant_answers_have_no_correlation(spark):
    rows = decisions(spark, "score", [("1", "5", None), ("2", "5", None), ("9", "5", None)])
    got = m.score_metrics(rows, 0, 10).first()
    assert got.pearson_r is None and got.spearman_r is None and got.mae == pytest.approx(11 / 3)


def test_not_applicable_is_the_middle(spark):
    rows = decisions(spark, "score", [("1", "1", None), ("2", "2", None), ("3", "3", None), ("9", None, "not_applicable"), ("4", None, "bad")])
    got = m.score_metrics(rows, 0, 10).first()
    assert got.mae == pytest.approx(1.0) and got.mae_answered == 0 and got.n_scored == 4


def test_near_misses_beat_far_ones(spark):
    names = labels(spark, "categorical", list("abcd"), True)
    near = decisions(spark, "categorical", [("a", "a", None), ("b", "b", None), ("c", "b", None), ("d", "c", None)])
    far = decisions(spark, "categorical", [("a", "a", None), ("b", "b", None), ("c", "a", None), ("d", "a", None)])
    x, y = m.ordinal_metrics(near, names).first(), m.ordinal_metrics(far, names).first()
    assert x.accuracy == y.accuracy and x.weighted_kappa > y.weighted_kappa and x.mae_steps < y.mae_steps


def test_rare_class_recall_takes_all_ties(spark):
    rows = decisions(spark, "categorical", [("x", "x", None), ("y", "x", None), ("z", "z", None), ("z", None, "bad")])
    assert m.rare_class_recall(rows).first().rare_recall == pytest.approx(0.5)


def test_mcc_conventions(spark):
    rows = decisions(spark, "binary", [("1", "1", None), ("0", "1", None)])
    assert m.mcc(rows).first().mcc == 0 and m.mcc(rows, None).first().mcc is None


def test_chance_of_majority_negative(spark):
    rows = decisions(spark, "binary", [("0", "0", None)] * 3 + [("1", "0", None)])
    got = m.chance_baselines(rows).first()
    assert (got.majority_f1, got.accuracy, got.stratified_f1) == (0, 0.75, 0.25)


def test_weighted_counts_equal_repeated_rows(spark):
    """A replicate's F1 from weights is the F1 of its rows written out."""
    rows = decisions(spark, "categorical", [("x", "x", None), ("y", "x", None), ("y", "y", None), ("x", "y", None), ("x", "x", None)]).withColumn("id", F.col("item_id").cast("long"))
    names = labels(spark, "categorical", ["x", "y"])
    reps = {r.b: r.f1 for r in b.f1_replicates(rows, names, 8).collect()}
    drawn = {(r.b, r.pos): r.w for r in b.item_weights(spark.createDataFrame([("t", 5)], "task string, n long"), 8).collect()}
    data = [(r.gold, r.pred) for r in rows.orderBy("id").collect()]
    for n in range(1, 9):
        out = [data[p] for (i, p), w in drawn.items() if i == n for _ in range(w)]
        assert len(out) == 5
        f1 = [2 * sum(g == p == x for g, p in out) / max(1, sum(g == x for g, _ in out) + sum(p == x for _, p in out)) for x in "xy"]
        assert reps[n] == pytest.approx(sum(f1) / 2)


def test_identical_models_differ_by_nothing(spark):
    rows = spark.createDataFrame([("t1", "a", 0.5), ("t1", "b", 0.5), ("t2", "a", 0.7), ("t2", "b", 0.7)], "task string, model string, f1 double")
    d = rows.join(rows.selectExpr("task", "model AS reference", "f1 AS g"), "task").filter("model < reference").withColumn("d", F.col("f1") - F.col("g"))
    got = b.mean_interval(d, "task", "d", 20, ["model", "reference"]).first()
    assert (got["mean"], got.low, got.high) == (0, 0, 0)


def test_tie_sets_no_frontier_and_ineligible_rows_carry_it(spark):
    rows = spark.createDataFrame([("s", 1, "a", 0.5, True), ("s", 2, "b", 0.9, False), ("s", 3, "c", 0.5, True), ("s", 4, "d", 0.6, True)], "series string, date int, model string, f1 double, ok boolean")
    got = {r.model: (r.sets_frontier, r.frontier) for r in k.running_frontier(rows, "series", "date", "f1", F.col("ok")).collect()}
    assert got == {"a": (True, 0.5), "b": (False, 0.5), "c": (False, 0.5), "d": (True, 0.6)}


def test_pareto_ignores_a_criterion_with_nulls(spark):
    rows = spark.createDataFrame([("a", 0.9, None), ("b", 0.8, 1.0)], "model string, f1 double, cost double")
    assert [r.model for r in k.pareto_front(rows, ["f1"], ["cost"]).collect()] == ["a"]


def test_sign_test(spark):
    got = spark.range(1).select(b.binomial_tail(F.lit(3), F.lit(4)).alias("p"), b.binomial_tail(F.lit(0), F.lit(4)).alias("all")).first()
    assert got.p == pytest.approx(5 / 16) and got["all"] == pytest.approx(1)
