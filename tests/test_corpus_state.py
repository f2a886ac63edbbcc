import datetime
import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import contracts as q
from tallyframe.operators import corpus as c
from tallyframe.operators import inference as i
from tallyframe.operators import state as s
from tallyframe.sources import readers as r
from tallyframe.sources import sinks as k
from tallyframe.streaming.ledger import latest_runs_stream


def test_build_items(spark):
    rows = spark.createDataFrame([(1, " a  b ", "x"), (2, "a b", "x"), (3, "c", "x"), (4, "c", "y"), (5, "", "x"), (6, "d", None), (7, "e", "old"), (8, "f", "skip")], "id int, body string, gold string")
    got = c.build_items(rows, "t", "id", "body", "gold", "id", labels={"old": "y"}, exclude=["skip"], allowed=["x", "y"])
    assert sorted((x.item_id, x.text, x.gold) for x in got.collect()) == [("t_1", "a b", "x"), ("t_7", "e", "y")]
    with pytest.raises(Exception, match="label not allowed"):
        c.build_items(rows, "t", "id", "body", "gold", "id", allowed=["x"]).collect()


def test_duplicate_ids_in_order(spark):
    rows = spark.createDataFrame([("a", 2), ("b", 1), ("a", 3), ("a", 1)], "item_id string, pos int")
    assert [x.item_id for x in c.unique_ids(rows, "item_id", "pos").orderBy("pos", "item_id").collect()] == ["a", "b", "a__dup1", "a__dup2"]


def test_samples_are_disjoint(spark):
    got = c.two_stage_sample(spark.range(50).withColumnRenamed("id", "pos"), 10, 5, "x", "pos").collect()
    assert len({x.pos for x in got}) == 15 and sorted(x.ordinal for x in got) == list(range(15))


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, x string, v int")
    new = spark.createDataFrame([("2", "c", True), ("3", "d", False)], "id string, x string, w boolean")
    got = {x.id: (x.x, x.v, x.w) for x in s.merge_into(old, new, ["id"]).collect()}
    assert got == {"1": ("a", 0, None), "2": ("c", None, True), "3": ("d", None, False)}


def test_contracts(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "id int, x string")
    with pytest.raises(q.ContractError, match="repeats keys"):
        q.checked_join(rows, rows.select("id"), ["id"], "many_to_one")
    with pytest.raises(q.ContractError, match="missing columns: y"):
        q.require_columns(rows, ["id", "y"])
    with pytest.raises(q.ContractError, match="dropped"):
        q.require_loss(rows, rows.limit(1))
    assert spark.range(1).select(q.within_gate(F.lit(0.05))).first()[0]
    assert q.differences(rows, rows).isEmpty()
    ok = lambda a, b: spark.range(1).select(q.returned_model_ok(F.lit(a), F.lit(b))).first()[0]
    assert ok("m", "m") and ok("m", "m-2024-01-02") and not ok("m-2024-01-02", "m-2024-01-02-x") and not ok("m", "n")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('item_id\ttext\n007\ta "quoted" text\n', encoding="utf-8")
    assert r.csv(spark, str(tmp_path / "a.tsv"), "item_id string, text string", sep="\t", quote=None).first() == ("007", 'a "quoted" text')
    (tmp_path / "l.csv").write_bytes("id,t\n1,caf\xe9\n".encode("latin-1"))
    assert r.csv(spark, str(tmp_path / "l.csv"), "id string, t string", encoding="ISO-8859-1").first().t == "café"
    with gzip.open(tmp_path / "z.csv.gz", "wt") as f:
        f.write("id,t\n1,\n")
    assert r.csv_text(spark, str(tmp_path / "z.csv.gz"), ["id", "t"]).first() == ("1", "")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in.csv", "id,n\nx,4\ny,\n")
    assert r.zip_csv(spark, str(tmp_path / "z.zip"), "in.csv", "id string, n int").collect() == [("x", 4), ("y", None)]
    (tmp_path / "k.json").write_text(json.dumps({"p1": {"v": ["a", "b"]}, "p2": {"v": []}}))
    assert {x.key: x.value.v for x in r.keyed_json(spark, str(tmp_path / "k.json"), "struct<v: array<string>>").collect()} == {"p1": ["a", "b"], "p2": []}
    (tmp_path / "x.xml").write_text("<r><e s='1'>t</e><e s='2'>u</e></r>")
    assert r.xml(spark, str(tmp_path / "x.xml"), "e").count() == 2
    (tmp_path / "p.json").write_text(json.dumps({"rows": [{"task": "t", "item": {"item_id": "1", "user_content": "c", "gt": {"y": "1"}}, "pilot": True}]}))
    assert r.panel(spark, str(tmp_path / "p.json")).first().gold == {"y": "1"}
    (tmp_path / "s.txt").write_text("JobID|JobName|State|Elapsed\n1|a|COMPLETED|60\n1.batch|b|COMPLETED|60\n")
    assert r.job_accounting(spark, str(tmp_path / "s.txt")).collect() == [("1", "a", "COMPLETED", 60)]
    (tmp_path / "bad.jsonl").write_text('{"run_id": "a"}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        r.ledger(spark, str(tmp_path / "bad.jsonl"), "run_id string").collect()
    rows = spark.createDataFrame([("a", 0.123456, None), ("b", 2.0, "")], "m string, x double, n string")
    k.write_csv(rows.coalesce(1), str(tmp_path / "out"), digits=3)
    assert next((tmp_path / "out").glob("part*")).read_text().splitlines() == ["m,x,n", "a,0.123,", "b,2.000,"]
    with pytest.raises(Exception, match="(?i)exists"):
        k.write_csv(rows, str(tmp_path / "out"))
    k.append_events(rows, str(tmp_path / "log"))
    assert all("n" not in json.loads(x) for p in (tmp_path / "log").glob("part*") for x in p.read_text().splitlines())
    with pytest.raises(ValueError, match="belongs to"):
        k.require_sidecar("/data/out/x", ["/data/out"])
    assert k.forbidden_columns(spark.createDataFrame([((1,),)], "a struct<secret_text: int>"), ["secret"]) == ["a.secret_text"]
    assert k.markdown(rows.select("m")).splitlines() == ["| m |", "| --- |", "| a |", "| b |"]
    (tmp_path / "man").mkdir()
    (tmp_path / "man" / "b.json").write_text('{"name": "b", "order": 1}')
    (tmp_path / "man" / "a.json").write_text('{"name": "a", "order": 2}')
    assert [x["name"] for x in r.manifests(str(tmp_path / "man"), "task")] == ["b", "a"]


def test_latest_responses(spark):
    asked = spark.createDataFrame([("1",), ("2",)], "custom_id string")
    got = spark.createDataFrame([("1", 1, "old"), ("1", 2, "new")], "custom_id string, batch_seq int, body string")
    out = {x.custom_id: (x.body, x.failure) for x in i.with_responses(asked, got).collect()}
    assert out == {"1": ("new", None), "2": (None, "missing")}


EVENTS = [("r1", "2024-01-01 00:00:00", "start", None), ("r1", "2024-01-01 01:00:00", "update", 5), ("r2", "2024-01-02 00:00:00", "start", None), ("r1", "2024-01-01 02:00:00", "finish", None)]


def test_ledger_batch_and_stream_agree(spark, tmp_path):
    schema = "run_id string, timestamp string, event string, rows_written long"
    src = tmp_path / "events"
    src.mkdir()
    for n, part in enumerate((EVENTS[:2], EVENTS[2:])):
        (src / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("run_id", "timestamp", "event", "rows_written"), e, strict=True))) for e in part))
    stream = latest_runs_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)))
    seen = {}

    def keep(df, _):
        for x in df.collect():
            seen[x.run_id] = x

    done = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(keep).start()
    done.awaitTermination(120)
    batch = {x.run_id: x for x in s.latest_runs(r.json_lines(spark, str(src), schema).withColumn("timestamp", F.to_timestamp("timestamp")), fields=["rows_written"]).collect()}
    for run in ("r1", "r2"):
        for f in ("started_at", "updated_at", "ended_at", "last_event", "events", "rows_written"):
            assert seen[run][f] == batch[run][f], (run, f)
    assert batch["r1"].rows_written == 5 and batch["r1"].ended_at == datetime.datetime(2024, 1, 1, 2)
    board = s.status_board(spark.createDataFrame(list(batch.values())))
    assert {(x.run_id, x.bucket) for x in board.collect()} == {("r1", "completed"), ("r2", "active")}


def test_numbers_over_many_ranges(spark):
    from tallyframe.operators.numbering import numbered

    rows = spark.createDataFrame([(g, o, p) for g in "ab" for o in (2, 1) for p in (7, 0, 3, 11, 5)], "g string, o int, p long")
    got = sorted((x.g, x.o, x.p, x.n) for x in numbered(rows, "p", by=["g"], outer=["o"], name="n", width=4).collect())
    assert [x[3] for x in got] == [*range(10)] * 2
    tasks = spark.createDataFrame([("t", 2), ("s", 1)], "task string, task_order int")
    items = spark.createDataFrame([("t", 0), ("s", 1), ("s", 0)], "task string, pos int")
    assert [(x.task, x.pos) for x in i.flatten_requests(items, tasks).orderBy("request_index").collect()] == [("s", 0), ("s", 1), ("t", 0)]
