"""Streams that are killed, calls that fail, archives with bad rows, nested values."""

import json
import threading
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.variants import private_values, walk
from tallyframe.operators.concurrent import Pace, Retryable, answer_concurrently
from tallyframe.sources.archives import write_zips, zip_csv, zip_xml
from tallyframe.streaming.checkpoints import cell_progress, run_in_batches, saved_rows


def test_a_killed_stream_neither_loses_nor_repeats(spark, tmp_path):
    rows = spark.range(100).selectExpr("'t' AS task", "concat('m', id % 3) AS model", "cast(id AS string) AS item_id", "id * 2 AS pred")
    rows.repartition(10).write.parquet(f"{tmp_path}/in")
    work = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []

    def killed(saved, number):
        seen.append((number, saved.count()))
        if number == 4:
            raise RuntimeError("killed after the batch was saved, before its number was")

    with pytest.raises(Exception, match="killed"):
        run_in_batches(work, f"{tmp_path}/out", killed).awaitTermination()
    part = saved_rows(spark, f"{tmp_path}/out", rows.schema)
    assert 0 < part.count() < 100 and part.agg(F.max("batch_id")).first()[0] == 4
    assert not any(r.complete for r in cell_progress(part, rows).collect())
    run_in_batches(work, f"{tmp_path}/out", lambda saved, n: seen.append((n, saved.count()))).awaitTermination()
    assert [n for n, _ in seen].count(4) == 2  # the batch ran twice
    whole = saved_rows(spark, f"{tmp_path}/out", rows.schema)
    assert sorted(map(tuple, whole.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    run_in_batches(work, f"{tmp_path}/out").awaitTermination()
    assert whole.count() == 100
    got = {r.model: (r.expected, r.saved, r.repeated, r.extra, r.complete, r.keys_sha256) for r in cell_progress(whole, rows).collect()}
    assert {k: v[:5] for k, v in got.items()} == {"m0": (34, 34, 0, 0, True), "m1": (33, 33, 0, 0, True), "m2": (33, 33, 0, 0, True)} and len({v[5] for v in got.values()}) == 3


def test_progress_tells_missing_repeated_and_strange_keys(spark):
    panel = spark.createDataFrame([("t", m, k) for m in ("full", "less", "none") for k in "abc"], "task string, model string, item_id string")
    rows = spark.createDataFrame([("t", "full", k) for k in "cab"] + [("t", "less", "a"), ("t", "less", "a"), ("t", "less", "z"), ("t", "new", "a")], panel.schema)
    got = {r.model: (r.expected, r.saved, r.repeated, r.extra, r.complete) for r in cell_progress(rows, panel).collect()}
    assert got == {"full": (3, 3, 0, 0, True), "less": (3, 1, 1, 1, False), "none": (3, 0, 0, 0, False), "new": (0, 0, 0, 1, False)}


def test_pace_is_never_passed():
    pace, starts = Pace(200), []
    threads = [threading.Thread(target=lambda: [(pace.wait(), starts.append(time.monotonic())) for _ in range(5)]) for _ in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    starts.sort()
    assert len(starts) == 30 and starts[-1] - starts[0] >= 29 / 200 - 0.01


def make_client():
    state = {"open": 0, "most": 0, "tries": {}}
    lock = threading.Lock()

    def call(model, system, text):
        with lock:
            state["open"] += 1
            state["most"] = max(state["most"], state["open"])
            n = state["tries"][text] = state["tries"].get(text, 0) + 1
        time.sleep(0.002)
        with lock:
            state["open"] -= 1
        number = int(text)
        if number % 10 == 1:
            raise KeyError("never")
        if number % 10 == 2:
            raise Retryable("always busy", 0.0)
        if number % 10 == 3 and n < 3:
            raise Retryable("busy", 0.001)
        return f"{number}:{n}:{state['most']}"

    return call


def test_concurrent_calls(spark):
    rows = spark.range(0, 200, 1, 1).selectExpr("'t' AS task", "'m' AS model", "cast(id AS string) AS item_id", "cast(id AS string) AS user_content")
    found = answer_concurrently(rows, make_client, open_calls=5, tries=3, first_wait=0.001, tasks=3).withColumn("_place", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()).collect()
    dealt = rows.repartition(3, "task", "model", "item_id").withColumn("_part", F.spark_partition_id()).collect()
    assert [(r._part, r.item_id) for r in sorted(found, key=lambda r: r._place)] == [(r._part, r.item_id) for r in dealt]  # order kept
    for r in found:
        number = int(r.item_id)
        if number % 10 in (1, 2):
            assert r.raw_content is None and r.parse_error == {1: "KeyError: 'never'", 2: "Retryable: always busy"}[number % 10]
        else:
            value, n, most = map(int, r.raw_content.split(":"))
            assert (value, n) == (number, 3 if number % 10 == 3 else 1) and most <= 5 and r.parse_error is None
    assert max(int(r.raw_content.split(":")[2]) for r in found if r.raw_content) > 1
    assert answer_concurrently(rows.limit(0), make_client).collect() == []


def test_archives(spark, tmp_path):
    folder = tmp_path / "zips" / "deep"
    folder.mkdir(parents=True)
    with zipfile.ZipFile(folder / "a.zip", "w") as z:
        z.writestr("data/x.csv", 'n,text,v\r\n1,"two\r\nlines, and a comma",2.5\r\nx,b,\r\n3,short\r\n\r\n4,é,nan\r\n')
        z.writestr("data/y.csv", "v,n,text\n7,5,swapped\n")
        z.writestr("other/z.csv", "a\n1\n")
        z.writestr("doc.xml", '<r xmlns="u"><s allScores="1,2" id="k">t<b>u</b></s><s/><s allScores=""/></r>')
    with zipfile.ZipFile(folder / "b.zip", "w") as z:
        z.writestr("data/x.csv", "n,text,v\n")
        z.writestr("data/empty.csv", "")
    found = zip_csv(spark, str(tmp_path / "zips"), "data/*.csv", "n int, v double, text string")
    assert found.rdd.getNumPartitions() == 4  # one a member
    got = {(r.member, r.line): (r.n, r.v, r.text, r.bad) for r in found.collect()}
    assert got[("data/x.csv", 3)] == (1, 2.5, "two\r\nlines, and a comma", [])
    assert got[("data/x.csv", 4)] == (None, None, "b", ["n"]) and got[("data/x.csv", 5)] == (None, None, None, ["*"])
    assert got[("data/x.csv", 7)][0] == 4 and got[("data/y.csv", 2)] == (5, 7.0, "swapped", []) and len(got) == 5
    with pytest.raises(Exception, match="bad row a.zip data/x.csv 4 n"):
        zip_csv(spark, str(folder / "a.zip"), "data/x.csv", "n int, text string", on_bad="fail").collect()
    with pytest.raises(Exception, match="no column n"):
        zip_csv(spark, str(folder), "other/*", "n int").collect()
    xml = zip_xml(spark, f"file://{folder}", "*.xml", "allScores").collect()
    assert [(r.tag, r.attributes, r.text) for r in xml] == [("s", {"allScores": "1,2", "id": "k"}, "tu"), ("s", {"allScores": ""}, "")]


def test_written_archives_are_read_back(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else f'a "q", {i}\n', f"f{i % 3}") for i in range(50)]
    df = spark.createDataFrame(rows, "n long, text string, name string").repartition(4)
    for _ in range(2):  # a second run leaves the same archives
        write_zips(df, f"file://{tmp_path}/z", "name", ["n", "text"])
    got = zip_csv(spark, f"file://{tmp_path}/z", "*", "n long, text string").collect()
    assert sorted((r.n, r.text, r.member) for r in got) == sorted((n, t, f"data/{m}.csv") for n, t, m in rows)


def nodes(value, path="$", name=None):
    yield path, name
    items = value.items() if isinstance(value, dict) else ((f"[{i}]", v) for i, v in enumerate(value)) if isinstance(value, list) else ()
    for k, v in items:
        yield from nodes(v, path + k if isinstance(value, list) else f"{path}.{k}", k)


def test_walk_of_any_depth(spark):
    deep = "leaf /home/x"
    for i in range(9):
        deep = {"k": [deep, i]} if i % 2 else [{"Token": deep}]
    values = [{"a": 1, "b": {"text": None, "c": [[], {}, ["sk-ant-1"]]}}, deep, [], {}, "plain /Users/", None, 3, {"[0]": {"token": True}}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(99, None)], "id int, text string").withColumn("v", F.parse_json("text"))
    got = sorted((r.id, r.path) for r in walk(df, "id", "v").collect())
    want = sorted([(i, p) for i, v in enumerate(values) for p, _ in nodes(v)] + [(99, "$")])
    assert got == want
    bad = {(r.id, r.path, r.reason) for r in private_values(df, "id", "v", ["token", "TEXT"], ["/home/", "/Users/", "sk-ant-"]).collect()}
    names = {(i, p, f"name {n.lower()}") for i, v in enumerate(values) for p, n in nodes(v) if n and n.lower() in ("token", "text")}
    marks = {(0, "$.b.c[2][0]", "mark sk-ant-"), (4, "$", "mark /Users/")} | {(1, p, "mark /home/") for p, _ in nodes(deep) if p == max((q for q, _ in nodes(deep)), key=len)}
    assert bad == names | marks
