"""Counts of patterns under many replicates, against draws by hand."""

import random
from collections import Counter

import pytest

from tallyframe.operators.codes import replicate_counts

from .test_accounts import draws


@pytest.mark.parametrize(("most", "segment"), [(4096, 1 << 27), (4096, 16), (2, 1 << 27)])
def test_replicate_counts_by_force(spark, most, segment):
    rnd = random.Random(5)
    rows = [(task, f"u{i:03d}", model, rnd.choice(["a", "b", None]), rnd.choice(["a", None])) for task, size in (("x", 70), ("y", 23)) for i in range(size) for model in ("m1", "m2")[: rnd.randint(1, 2)]]
    rows += [("z", f"u{i:03d}", "m1", "a", "a") for i in range(9)]
    df = spark.createDataFrame(rows, "task string, id string, model string, gold string, pred string").repartition(3)
    found = replicate_counts(df, 6, "seed", "task", "id", ["model", "gold", "pred"], most=most, segment=segment, chunk=4).collect()
    want = Counter()
    for task, size in (("x", 70), ("y", 23), ("z", 9)):
        for b in range(1, 7):
            times = Counter(draws("seed", task, b, size))
            for t, unit, model, gold, pred in rows:
                if t == task:
                    want[task, model, gold, pred, b] += times[int(unit[1:])]
    assert len(found) == len({(r.task, r.model, r.gold, r.pred, r.b) for r in found})
    assert {(r.task, r.model, r.gold, r.pred, r.b): r.w for r in found if r.w} == {c: n for c, n in want.items() if n}
