"""What differed from SQL or outgrew a process on larger tables."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyframe import api
from tallyframe.operators import corpus as c
from tallyframe.operators import concurrent, panel
from tallyframe.operators import contracts as q
from tallyframe.operators import learning as s
from tallyframe.operators import metrics as m
from tallyframe.operators import reshape, state
from tallyframe.plans import catalog, fixtures, running_jobs, supervised
from tallyframe.streaming import checkpoints

from .compare import SF, database, rows


def both(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return rows(catalog.QUERIES[name](spark, str(folder)).toPandas()), rows(con.sql(catalog.ORACLE_SQL[name]).df())


def test_no_model_reaches_the_driver(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"w{i % 3} common", "ab"[i % 2]) for i in range(60)], "id long, text string, gold string")
    docs = s.with_fold(df, "id", 3)
    golds = docs.selectExpr("'t' AS task", "'f' AS label_field", "id", "gold", "fold")
    models = s.fit_models(s.training_prefixes(golds, "id", (10,), 3, 50), docs, "id", sizes=(10,))

    def collected(self):
        raise AssertionError("a model came to the driver")

    with monkeypatch.context() as patch:
        patch.setattr(type(models), "collect", collected)
        found = s.predict_out_of_fold(docs, models, "id")
    assert found.select("id").distinct().count() == found.count() == 60


@pytest.mark.parametrize("name", ["learning_curve", "crossover_sizes"])
def test_predictions_are_not_broadcast(spark, monkeypatch, name):
    docs = spark.range(4000).selectExpr("id AS doc_id", "cast(id % 5 AS int) AS fold")
    fields = spark.createDataFrame([("lang", "categorical", "lang"), ("content", "multi_binary", "quality"), ("content", "multi_binary", "toxic")], "task string, kind string, label_field string")
    golds = docs.crossJoin(fields).selectExpr("task", "kind", "label_field", "doc_id", "CASE WHEN task = 'lang' THEN if(doc_id % 2 = 0, 'en', 'de') ELSE cast(doc_id % 2 AS string) END AS gold", "fold")
    wrong = "label_field <> 'quality' AND doc_id % 40 < size"  # 40: as many as can be
    found = golds.crossJoin(spark.createDataFrame([(10,), (20,)], "size int")).selectExpr("doc_id", "task", "label_field", "fold", "size", f"CASE WHEN NOT ({wrong}) THEN gold WHEN task = 'lang' THEN if(gold = 'en', 'de', 'en') ELSE if(gold = '1', '0', '1') END AS pred")
    monkeypatch.setattr(supervised, "predictions", lambda spark, sf_dir, largest: (golds, supervised.written(found, "synthetic")))
    monkeypatch.setattr(s, "SIZES", (10, 20, 30))
    plans, plain = [], supervised.written
    monkeypatch.setattr(supervised, "written", lambda df, name: plans.append(df) or plain(df, name))
    df = catalog.QUERIES[name](spark, SF)
    joins = [x for f in (*plans, df) for x in re.findall(r"(\w+Join) \[([^\]]*)\]", f._jdf.queryExecution().executedPlan().toString())]
    assert {kind for kind, keys in joins if "doc_id" in keys} == {"SortMergeJoin"}
    if name == "learning_curve":
        got = {(r.task, r["size"], r.fold): (r.headline_f1, r.accuracy, r.n_test) for r in df.collect()}
        known = lambda size: (1 - size / 40, 1 - size / 40, 800)
        assert got == {(t, size, f): (known(size) if t == "lang" else (round((2 - size / 40) / 2, 6), *known(size)[1:])) if size < 30 else (None, None, None) for t in ("lang", "content") for size in (10, 20, 30) for f in range(5)}


@pytest.mark.parametrize("name", ["decoded_titles", "unescaped_titles"])
def test_titles_as_sql_has_them(spark, tmp_path, name):
    titles = ["a &amp;lt; b", "cut &amp", "&eacute;&nbsp;&#233;", " x   y\v\t z ", "&quot;&#39;&gt;", ""]
    pages = spark.createDataFrame([(i, f"<title>{t}</title>") for i, t in enumerate(titles)] + [(90, "none"), (91, None)], "page_id long, html string")
    found, expected = both(spark, tmp_path, name, pages=pages)
    assert found == expected


def test_halves_of_tokens_go_to_the_even_number(spark, tmp_path):
    prices = [(i, "1-URGENT", 100.0 * (4436 + i % 64) + 50) for i in range(2, 260)]
    found, expected = both(spark, tmp_path, "stage_findings", orders=spark.createDataFrame(prices, "o_orderkey long, o_orderpriority string, o_totalprice double"))
    assert found == expected


def test_means_next_to_a_half_do_not_depend_on_partitions(spark, tmp_path):
    values = [1.1, 2.2, 0.3, 0.7, 5.7, 1e-16, 3.3, 1.4, 0.1, 0.2, 0.15, 0.05]
    events = spark.createDataFrame([(i, u, "click" if i % 3 else "view", values[(i * 7 + u) % 12] + u / 2) for i in range(600) for u in range(5)], "event_id long, user_id long, event_type string, value double")
    pair = lambda df: sorted(map(tuple, c.pairs_under_both(df.withColumn("shown", F.col("event_type") == "click"), "user_id", "shown", "value", "event_id").collect()))
    want = []
    for u in range(5):
        sums, n = [0.0, 0.0], [0, 0]
        for i in range(600):
            sums[i % 3 == 0] += values[(i * 7 + u) % 12] + u / 2
            n[i % 3 == 0] += 1
        want.append(sums[0] / n[0] - sums[1] / n[1])
    for dealt in (events.coalesce(1), events.repartition(7), events.repartition(3, "value")):
        assert [r[3] for r in pair(dealt)] == want


def test_tasks_of_calls_grow_with_the_requests(spark, monkeypatch):
    monkeypatch.setattr(concurrent, "SHARE", 10)
    requests = spark.range(95).selectExpr("'t' AS task", "'m' AS model", "cast(id AS string) AS item_id", "cast(id AS string) AS user_content")
    found = concurrent.answer_concurrently(requests, lambda: lambda model, system, text: text)
    assert found.rdd.getNumPartitions() == 10 and {(r.item_id, r.raw_content) for r in found.collect()} == {(str(i), str(i)) for i in range(95)}


def test_rounds_of_effects_see_cells(spark, monkeypatch):
    seen, plain = [], panel._less_effects

    def counted(rows, effects, columns):
        seen.append(rows.count())
        return plain(rows, effects, columns)

    monkeypatch.setattr(panel, "_less_effects", counted)
    df = spark.range(400).selectExpr("id % 3 AS a", "id % 4 AS b", "id * 37 % 101 AS y")
    assert panel.absorbed(df, ["a", "b"], ["y"]).count() == 400
    assert set(seen[:-1]) == {12} and seen[-1] == 400


def exchanges(df):
    """Keys and tasks of the exchanges by hash that a plan makes."""
    found = re.findall(r"Exchange hashpartitioning\(([^)]*), (\d+)\)", df._jdf.queryExecution().executedPlan().toString())
    return {(tuple(re.sub(r"#\d+L?", "", key).split(", ")), int(tasks)) for key, tasks in found}


@pytest.mark.parametrize("name", ["checkpoint_cells", "reusable_answers", "batch_agreement"])
def test_answers_are_dealt_by_item_to_tasks_that_grow(spark, monkeypatch, name):
    monkeypatch.setattr(reshape, "SHARE", 50)
    df, duck = catalog.QUERIES[name](spark, SF), database()
    by_item = {(key, tasks) for key, tasks in exchanges(df) if "item_id" in key}
    assert len(by_item) == 1 and by_item.pop()[1] > 40  # the items, and nothing for each answer
    assert rows(df.toPandas()) == rows(duck.sql(catalog.ORACLE_SQL[name]).df())


def test_cells_count_repeated_and_strange_rows_in_one_pass(spark):
    panel = spark.createDataFrame([("t", "a"), ("t", "b"), (None, "c")], "task string, item_id string")
    have = [("t", "m", "a", "h"), ("t", "m", "a", "h"), ("t", "n", "a", None), ("t", "n", "b", "h"), ("t", "o", "b", None), ("t", "o", None, "h"), (None, "m", "c", "h")]
    df = spark.createDataFrame(have, "task string, model string, item_id string, panel_hash string")
    got = {(r.task, r.model): (r.rows, r.matched, r.panel, r.same_panel) for r in q.broken_cells(df, panel, "h").collect()}
    assert got == {("t", "m"): (2, 1, 2, True), ("t", "o"): (2, 1, 2, True), (None, "m"): (1, 0, 0, True)}


def test_metrics_of_counted_pairs_are_those_of_the_rows(spark):
    dec, labels = fixtures.decisions(spark, SF), fixtures.label_def(spark)
    pairs = m.label_pairs(dec)
    assert pairs.count() < dec.count() / 3 and pairs.agg(F.sum("n")).first()[0] == dec.filter("kind <> 'score'").count()
    for policy in ("drop", "wrong"):
        one, many = m.with_policy(pairs, policy), m.with_policy(dec, policy)
        for counted, plain in (
            (m.headline_f1(one, labels, weight="n"), m.headline_f1(many, labels)),
            (m.accuracy(one, "n"), m.accuracy(many)),
            (m.mcc(one, weight="n"), m.mcc(many)),
            (m.ordinal_metrics(one, labels, "n"), m.ordinal_metrics(many, labels)),
        ):
            assert rows(counted.toPandas()) == rows(plain.toPandas())


def test_summary_reads_the_answers_a_few_times(spark):
    scans = catalog.QUERIES["summary_report"](spark, SF)._jdf.queryExecution().executedPlan().toString().count("/labels.parquet")
    assert scans <= 8  # two tasks of labels, each counted, timed and listed


def test_reusable_keys_with_repeats_and_nulls(spark):
    expected = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", 1), (None, 1)], "k string, j int")
    done = spark.createDataFrame([("a", 1, None), ("a", 1, "e"), ("b", 1, "e"), ("d", 1, None), (None, 1, None)], "k string, j int, e string")
    found = state.reusable_keys(expected, done, ["k", "j"], F.col("e").isNull())
    assert set(map(tuple, found.collect())) == {("a", 1, True), ("b", 1, False), ("c", 1, False), (None, 1, False)} and "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_batched_answers_against_several_single_ones(spark):
    have = [(1, "a", "f", "x"), (1, "a", "f", "y"), (5, "a", "f", "x"), (1, "b", "f", "x"), (5, "b", "f", "x"), (1, "c", "f", None), (5, "c", "f", "x"), (5, "d", "f", "x"), (1, None, "f", "x"), (5, None, "f", "x"), (1, "e", "f", "x"), (1, "e", "g", "y"), (5, "e", "f", "x"), (5, "e", "g", "z")]
    df = spark.createDataFrame(have, "batch_size int, item_id string, label_field string, pred string").selectExpr("'t' AS task", "'m' AS model", "*")
    found = api.batch_agreement(df)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.batch_size: (round(r.agreement, 6), r.compared) for r in found.collect()} == {1: (1.0, 3), 5: (round(1 / 3, 6), 3)}


def test_progress_is_one_grouping_in_tasks_that_grow(spark, monkeypatch):
    monkeypatch.setattr(checkpoints, "SHARE", 1)
    panel = spark.range(100).selectExpr("'t' AS task", "'m' AS model", "cast(id AS string) AS item_id")
    found = checkpoints.cell_progress(panel.filter("item_id <> '7'").unionAll(panel.limit(1)), panel)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString() and (("item_id", "task", "model"), 20) in exchanges(found)
    assert tuple(found.first())[2:-1] == (100, 99, 1, 0, False)


def test_saved_answers_are_put_down_by_as_many_tasks_as_items_need(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(reshape, "SHARE", 50)
    monkeypatch.setattr(running_jobs, "new_folder", lambda spark, name: f"{tmp_path}/{name}")
    found = catalog.QUERIES["saved_answers"](spark, SF).collect()
    batches = list((tmp_path / "answers" / "out" / "rows").glob("batch_id=*"))
    assert len(list((tmp_path / "answers" / "in").glob("*.parquet"))) > 40 and len(batches) == 3
    assert len(found) == 25 and all(r.complete for r in found)
