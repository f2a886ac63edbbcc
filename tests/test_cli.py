"""Manifests, and the command line from items to a summary and a ledger."""

import json

import pytest
from pyspark.sql import functions as F

from tallyframe import cli
from tallyframe.sources.manifests import ManifestError, label_table, model_table, task_table

TASK = {"label_kind": "categorical", "label_key": "colour", "labels": ["red", "blue"], "prompt": "Which colour?", "ground_truth": {"column": "c"}}


def put(folder, name, spec):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(spec if isinstance(spec, str) else json.dumps(spec))


def test_task_manifests(spark, tmp_path):
    put(tmp_path / "t", "b.json", TASK | {"order": 2})
    put(tmp_path / "t", "a.yaml", "label_kind: binary\nlabel_key: yes_no\nground_truth: {column: g}\norder: 2\nstatus: excluded\nsampling: {n_first: 5, seed: 3}\n")
    put(tmp_path / "t" / "deep", "c.yml", "name: many\nlabel_kind: multi_binary\nlabels: [x, y]\nground_truth: {}\n")
    put(tmp_path / "t", "notes.txt", "not a manifest")
    folder, tree = str(tmp_path / "t"), str(tmp_path / "t")
    assert [r.name for r in task_table(spark, folder=folder).collect()] == ["a", "b"]
    assert [(r.name, r.order, r.status) for r in task_table(spark, tree=tree).collect()] == [("a", 2, "excluded"), ("b", 2, "active"), ("many", 999, "active")]
    assert [r.name for r in task_table(spark, folder=folder, active_only=True).collect()] == ["b"]
    named = task_table(spark, file=f"{folder}/a.yaml", active_only=True).first()
    assert (named.name, named.n_first, named.n_second, named.seed) == ("a", 5, 0, 3)
    labels = {(r.task, r.label_field, r.label, r.pos) for r in label_table(task_table(spark, tree=tree)).collect()}
    assert labels == {("a", "yes_no", "1", 1), ("b", "colour", "red", 0), ("b", "colour", "blue", 1), ("many", "x", "1", 1), ("many", "y", "1", 1)}
    for kwargs in ({}, {"file": "x", "folder": "y"}):
        with pytest.raises(ValueError, match="exactly one"):
            task_table(spark, **kwargs)


@pytest.mark.parametrize(
    "spec,why",
    [
        (TASK | {"label_kind": "ranked"}, "label_kind is 'ranked'"),
        ({k: v for k, v in TASK.items() if k != "label_kind"}, "label_kind is missing"),
        (TASK | {"labels": []}, "needs labels"),
        (TASK | {"labels": ["a", "a"]}, "listed twice"),
        (TASK | {"order": "first"}, "order is no int"),
        (TASK | {"ground_truth": {"label_map": {"r": "rouge"}}}, "labels that the task lacks: rouge"),
        (TASK | {"label_kind": "binary", "ground_truth": {"exclude_labels": ["x"]}}, "for categorical tasks"),
        (TASK | {"sampling": {"n_first": -1}}, "negative"),
        ("- a list", "mapping"),
    ],
)
def test_bad_task_manifests(spark, tmp_path, spec, why):
    put(tmp_path, "t.yaml", spec)
    with pytest.raises(ManifestError, match=f"t.yaml: .*{why}"):
        task_table(spark, folder=str(tmp_path))


def test_model_manifests(spark, tmp_path):
    put(tmp_path, "a.yaml", "name: small\nbackend: ollama\n")
    put(tmp_path, "b.yaml", "name: big\nbackend: openai\norder: 1\ncost_per_call_usd: 2\nreasoning_effort: low\nthink: true\n")
    rows = model_table(spark, folder=str(tmp_path)).collect()
    assert [(r.name, r.display_name, r.compute_class, r.think, r.cost_per_call_usd) for r in rows] == [("big", "big", "api", True, 2.0), ("small", "small", "local", False, None)]
    for text, why in (("name: x\nbackend: abacus\n", "not one of"), ("name: small\nbackend: openai\n", "one name"), ("name: x\nbackend: vllm\nmax_output_tokens: 0\n", "positive"), ("backend: vllm\n", "name is missing"), ("name: x\nbackend: vllm\nreasoning_effort: huge\n", "reasoning_effort is 'huge'")):
        put(tmp_path, "c.yaml", text)
        with pytest.raises(ManifestError, match=why):
            model_table(spark, folder=str(tmp_path))


@pytest.fixture
def job(spark, tmp_path):
    put(tmp_path / "tasks", "colour.json", TASK)
    put(tmp_path / "tasks", "shape.json", TASK | {"order": 1000, "status": "excluded"})
    model = str(tmp_path / "mended")
    put(tmp_path / "models", "m.json", {"name": model, "backend": "ollama"})
    put(tmp_path / "models", "n.json", {"name": "other", "backend": "openai", "cost_per_call_usd": 0.01})
    rows = [("colour", str(k), f"it is {'broken' if k % 5 == 0 else 'red' if k % 2 else 'blue'}", {"colour": "red" if k % 2 else "blue"}) for k in range(20)]
    spark.createDataFrame(rows, "task string, item_id string, user_content string, gold map<string,string>").write.parquet(f"{tmp_path}/items")
    return tmp_path, model, ["--items", f"{tmp_path}/items", "--tasks", f"{tmp_path}/tasks", "--models", f"{tmp_path}/models"]


def test_runs_resume_and_summary(spark, job, capsys):
    path, model, where = job
    client = ["--client", "tests.cli_clients:echo"]
    assert {r["model"]: r["calls"] for r in cli.main(["run", *where, "--dry-run"], spark)} == {model: 20, "other": 20}
    assert cli.main(["run", *where, "--dry-run", "--skip", "other/colour", "--json"], spark) == [{"model": model, "task": "colour", "calls": 20}]
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["calls"] == 20
    first = cli.main(["run", *where, *client, "--only-model", model, "--output", f"{path}/one"], spark)
    assert [(r["rows"], r["malformed"], r["batch_size"]) for r in first] == [(20, 4, 1)]
    (path / "mended").write_text("now")
    again = ["run", *where, "--only-model", model, "--merge-into", f"{path}/one", "--resume"]
    assert cli.main([*again, "--dry-run"], spark)[0]["calls"] == 4
    assert [(r["rows"], r["malformed"]) for r in cli.main([*again, *client, "--output", f"{path}/two"], spark)] == [(20, 0)]
    both = cli.main(["run", *where, *client, "--only-model", model, "--batch-sizes", "1,5", "--output", f"{path}/three"], spark)
    assert sorted((r["batch_size"], r["rows"], r["malformed"]) for r in both) == [(1, 20, 0), (5, 20, 0)]
    rows = cli.main(["summary", "--predictions", f"{path}/three", *where, "--output", f"{path}/sums"], spark)
    assert [(r["batch_size"], r["n"], r["parse_ok"], r["compute_class"]) for r in rows] == [(1, 20, 20, "local"), (5, 20, 20, "local")]
    assert rows[0]["accuracy"] == pytest.approx(0.9) and rows[0]["agreement"] == 1.0 and rows[1]["agreement"] == 1.0  # 'broken' answers blue
    with pytest.raises(Exception, match="(?i)exists"):
        cli.main(["summary", "--predictions", f"{path}/three", *where, "--output", f"{path}/sums"], spark)
    with pytest.raises(SystemExit, match="no such name: nobody"):
        cli.main(["run", *where, "--dry-run", "--only-model", "nobody"], spark)
    with pytest.raises(SystemExit, match="needed"):
        cli.main(["run", *where], spark)


def test_ledger(spark, tmp_path):
    at = ["--ledger", f"{tmp_path}/ledger"]
    cli.main(["ledger", "start", *at, "--run-id", "a", "--at", "2026-01-01T00:00:00"], spark)
    cli.main(["ledger", "update", *at, "--run-id", "a", "--rows-written", "7", "--at", "2026-01-01T01:00:00"], spark)
    cli.main(["ledger", "start", *at, "--run-id", "b", "--status", "queued", "--at", "2026-01-02T00:00:00"], spark)
    cli.main(["ledger", "finish", *at, "--run-id", "a", "--note", "fine", "--at", "2026-01-01T02:00:00"], spark)
    cli.main(["ledger", "fail", *at, "--run-id", "c", "--at", "2026-01-03T00:00:00"], spark)
    got = {r["run_id"]: r for r in cli.main(["ledger", "status", *at], spark)}
    assert [(k, got[k]["bucket"], got[k]["status"], got[k]["events"]) for k in "abc"] == [("a", "done", "completed", 3), ("b", "active", "queued", 1), ("c", "failed", "failed", 1)]
    assert got["a"]["rows_written"] == 7 and got["a"]["started_at"] == "2026-01-01T00:00:00" and got["a"]["note"] == "fine"
    with pytest.raises(SystemExit, match="a run ends as"):
        cli.main(["ledger", "finish", *at, "--run-id", "b", "--status", "asleep"], spark)
    assert spark.read.json(f"{tmp_path}/ledger").filter(F.col("note").isNotNull()).count() == 1
