"""What the plans must and must not hold."""

import hashlib

import numpy as np
import pytest

from tallyframe.plans import catalog
from tallyframe.plans.fixtures import label_def
from tallyframe.plans.scoring import wrong

from .compare import SF


def plan(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["leaderboard", "matthews", "ordinal_task", "bootstrap_intervals", "build_item_table", "run_ledger", "latency_and_cost"])
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan(spark, name)


def test_scans_read_only_what_is_used(spark):
    text = plan(spark, "leaderboard")
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in text and "html" not in text


def test_counts_are_combined_before_the_shuffle(spark):
    text = plan(spark, "per_class_f1")
    assert "partial_sum" in text and "BroadcastHashJoin" in text
    assert "Python" not in text and "Arrow" not in text


def test_release_pairs_take_2000_replicates(spark):
    rows = wrong(spark, SF).filter("kind <> 'score'").select("task", "model", "id", "gold", "pred").toPandas()
    labels = label_def(spark).toPandas()
    f1 = {}
    for task, part in rows.groupby("task"):
        ids = sorted(part.id.unique())
        n, known = len(ids), sorted(set(labels[labels.task == task].label) & set(part.gold))
        digest = lambda b, j: hashlib.sha256(f"boot|{task}|{b}|{j // 8}".encode()).hexdigest()[8 * (j % 8) : 8 * (j % 8) + 8]  # noqa: B023, E731
        draws = [[int(digest(b, j), 16) % n for j in range(n)] for b in range(1, 2001)]
        weights = np.array([np.bincount(d, minlength=n) for d in draws], float)
        for model, one in part.groupby("model"):
            w, scores = weights[:, np.searchsorted(ids, one.id)], []
            for x in known:
                g, p = (one.gold == x).to_numpy(), (one.pred == x).to_numpy()
                both = w @ g + w @ p
                scores.append(np.divide(2 * (w @ (g & p)), both, out=np.zeros(len(w)), where=both > 0))
            f1.setdefault(model, {})[task] = np.mean(scores, axis=0)
    found = catalog.QUERIES["release_pairs"](spark, SF).toPandas()
    assert len(found) == len(f1) * (len(f1) - 1)
    for r in found.itertuples():
        d = np.mean([f1[r.model][t] - f1[r.reference][t] for t in f1[r.model]], axis=0)
        assert np.allclose([r.item_ci_low, r.item_ci_high], np.quantile(d, [0.025, 0.975]), atol=1e-6)


@pytest.mark.parametrize("name", ["date_arithmetic", "batched_answers"])
def test_no_window_over_a_whole_table(spark, name):
    windows = [line for line in plan(spark, name).splitlines() if "Window [" in line]
    assert all("_range" in line for line in windows)
