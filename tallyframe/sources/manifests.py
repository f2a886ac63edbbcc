"""Task and model manifests: YAML or JSON files that Spark reads, checked field by field, with defaults, as tables.

A manifest is small and there is one for each task or model, so they are checked on the driver; what they describe is not read here.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a manifest's fields may hold.
LABEL_KINDS = ("binary", "categorical", "multi_binary", "score")
BACKENDS = ("ollama", "openai", "anthropic", "together", "vllm")
COMPUTE_CLASSES = ("local", "api")
EFFORTS = ("none", "minimal", "low", "medium", "high")
EXCLUDED = "excluded"


class ManifestError(ValueError):
    """A manifest that can't be used, with its file."""


def _load(text: str, path: str) -> dict[str, Any]:
    try:
        spec = json.loads(text)
    except ValueError:
        try:
            import yaml

            spec = yaml.safe_load(text)
        except ImportError:
            raise ManifestError(f"{path}: no JSON, and no YAML library is installed") from None
    if not isinstance(spec, dict):
        raise ManifestError(f"{path}: a manifest is a mapping")
    return spec


def _files(spark: SparkSession, file: str | None, folder: str | None, tree: str | None) -> list[tuple[str, dict]]:
    """The manifests of exactly one of: a file, a folder, a folder with all below it; in order of their paths."""
    if sum(x is not None for x in (file, folder, tree)) != 1:
        raise ValueError("name exactly one of file, folder and tree")
    reader = spark.read if tree is None else spark.read.option("recursiveFileLookup", True)
    if file is None:
        reader = reader.option("pathGlobFilter", "*.{yaml,yml,json}")
    rows = reader.text(file or folder or tree, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return [(r.path, _load(r.value, r.path.rpartition("/")[2])) for r in rows.orderBy("path").collect()]


class _Checks:
    def __init__(self, path: str, spec: Mapping[str, Any]):
        self.name, self.spec = path.rpartition("/")[2], spec

    def fail(self, what: str) -> None:
        raise ManifestError(f"{self.name}: {what}")

    def need(self, key: str, kind: type | tuple[type, ...] = str) -> Any:
        if key not in self.spec:
            self.fail(f"{key} is missing")
        return self.given(key, kind)

    def given(self, key: str, kind: type | tuple[type, ...], default: Any = None) -> Any:
        value = self.spec.get(key)
        if value is None:
            return default
        if not isinstance(value, kind) or (isinstance(value, bool) and kind is not bool):
            self.fail(f"{key} is no {kind.__name__ if isinstance(kind, type) else 'number'}")
        return value

    def one_of(self, key: str, values: Sequence[str], default: str | None = None, needed: bool = False) -> str | None:
        value = self.need(key) if needed else self.given(key, str, default)
        if value is not None and value not in values:
            self.fail(f"{key} is {value!r}, not one of {', '.join(values)}")
        return value

    def only(self, known: Sequence[str]) -> None:
        if unknown := sorted(set(self.spec) - set(known)):
            self.fail(f"unknown fields: {', '.join(unknown)}")


def _named_once(found: list[dict]) -> list[dict]:
    names = [s["name"] for s in found]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ManifestError(f"two manifests have one name: {', '.join(twice)}")
    return sorted(found, key=lambda s: (s["order"], s["name"]))


def _task(path: str, spec: dict) -> dict:
    c = _Checks(path, spec)
    kind = c.one_of("label_kind", LABEL_KINDS, needed=True)
    labels = [str(x) for x in c.given("labels", list, [])]
    gold = c.need("ground_truth", dict)
    if kind in ("categorical", "multi_binary") and not labels:
        c.fail(f"a {kind} task needs labels")
    if len(set(labels)) != len(labels):
        c.fail("a label is listed twice")
    if kind != "multi_binary" and not c.given("label_key", str):
        c.fail("label_key is missing")
    renamed, excluded = gold.get("label_map") or {}, gold.get("exclude_labels") or []
    if (renamed or excluded) and kind != "categorical":
        c.fail(f"label_map and exclude_labels are for categorical tasks, not {kind}")
    if strange := sorted({str(v) for v in renamed.values()} - set(labels)):
        c.fail(f"label_map gives labels that the task lacks: {', '.join(strange)}")
    sampling = {k: int(v) for k, v in ({"n_first": 0, "n_second": 0, "seed": 0} | c.given("sampling", dict, {})).items()}
    if min(sampling["n_first"], sampling["n_second"]) < 0:
        c.fail("a sample size is negative")
    stem = c.name.rpartition(".")[0]
    return {
        "name": c.given("name", str, stem), "order": c.given("order", int, 999), "kind": kind, "label_key": c.given("label_key", str), "labels": labels, "category": c.given("category", str), "prompt": c.given("prompt", str),
        "status": c.given("status", str, "active"), "gold_column": gold.get("column"), "label_map": {str(k): str(v) for k, v in renamed.items()}, "exclude_labels": [str(x) for x in excluded], "ordinal": c.given("ordinal", bool, False), **sampling,
    }


def _model(path: str, spec: dict) -> dict:
    c = _Checks(path, spec)
    backend = c.one_of("backend", BACKENDS, needed=True)
    most, price = c.given("max_output_tokens", int), c.given("cost_per_call_usd", (int, float))
    if most is not None and most < 1:
        c.fail("max_output_tokens must be positive")
    if price is not None and price < 0:
        c.fail("cost_per_call_usd is negative")
    name = c.need("name")
    return {
        "name": name, "order": c.given("order", int, 999), "backend": backend, "display_name": c.given("display_name", str, name),
        "compute_class": c.one_of("compute_class", COMPUTE_CLASSES, "local" if backend in ("ollama", "vllm") else "api"),
        "think": c.given("think", bool, False), "reasoning_effort": c.one_of("reasoning_effort", EFFORTS), "max_output_tokens": most,
        "expected_response_model": c.given("expected_response_model", str), "cost_per_call_usd": None if price is None else float(price),
    }


def _table(spark: SparkSession, read: Callable[[str, dict], dict], schema: str, files: list[tuple[str, dict]]) -> DataFrame:
    found = _named_once([read(path, spec) for path, spec in files])
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(s[n] for n in names) for s in found], schema)


TASK = "name string, order int, kind string, label_key string, labels array<string>, category string, prompt string, status string, gold_column string, label_map map<string,string>, exclude_labels array<string>, ordinal boolean, n_first int, n_second int, seed int"
MODEL = "name string, order int, backend string, display_name string, compute_class string, think boolean, reasoning_effort string, max_output_tokens int, expected_response_model string, cost_per_call_usd double"


def task_table(spark: SparkSession, file: str | None = None, folder: str | None = None, tree: str | None = None, active_only: bool = False) -> DataFrame:
    """Task manifests by order and name. With ``active_only``, excluded tasks are left out of folders, but a file that is named is always read."""
    files = _files(spark, file, folder, tree)
    if active_only and file is None:
        files = [(path, spec) for path, spec in files if spec.get("status") != EXCLUDED]
    return _table(spark, _task, TASK, files)


def model_table(spark: SparkSession, file: str | None = None, folder: str | None = None, tree: str | None = None) -> DataFrame:
    """Model manifests by order and name."""
    return _table(spark, _model, MODEL, _files(spark, file, folder, tree))


def label_table(tasks: DataFrame) -> DataFrame:
    """Declared labels of a table of tasks, as the metrics take them: ``task, kind, label_field, label, pos, ordinal``."""
    one = F.struct(F.col("label_key").alias("label_field"), F.lit("1").alias("label"), F.lit(1).alias("pos"))
    several = F.transform("labels", lambda x, i: F.struct(F.when(F.col("kind") == "multi_binary", x).otherwise(F.col("label_key")).alias("label_field"), F.when(F.col("kind") == "multi_binary", "1").otherwise(x).alias("label"), F.when(F.col("kind") == "multi_binary", 1).otherwise(i).alias("pos")))
    rows = tasks.filter("kind <> 'score'").select(F.col("name").alias("task"), "kind", "ordinal", F.inline(F.when(F.col("kind") == "binary", F.array(one)).otherwise(several)))
    return rows.select("task", "kind", "label_field", "label", "pos", "ordinal")
