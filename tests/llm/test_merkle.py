import hashlib
import random
from functools import reduce

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.llm.merkle import Forest, fold, leaf_digest, level_sizes, manifest
from tallyframe.llm.queries import ORACLE_SQL, QUERIES

from ..compare import SF, database, rows


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(leaves, arity):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
    return out


def way(tree, i, arity):
    out = []
    for level in tree[:-1]:
        a = i - i % arity
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + arity])))
        i //= arity
    return out


def by_force(leaves, arity):
    """Of (id, group, leaf): the same with subroot, root and proof."""
    groups = {}
    for row in sorted(leaves, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([r[2] for r in groups[g]], arity) for g in names}
    upper = levels([trees[g][-1][0] for g in names], arity)
    out = []
    for k, g in enumerate(names):
        out += [(*row, trees[g][-1][0], upper[-1][0], way(trees[g], i, arity) + way(upper, k, arity)) for i, row in enumerate(groups[g])]
    return out


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 300), st.integers(2, 17), st.integers(1, 8), st.randoms())
def test_forests_merge_in_any_order(n, arity, parts, rnd):
    leaves = [digest(str(i)) for i in range(n)]
    forests = [Forest(n, arity) for _ in range(parts)]
    for i in rnd.sample(range(n), n):
        rnd.choice(forests).add(0, i, leaves[i])
    rnd.shuffle(forests)
    whole = reduce(Forest.merge, forests)
    tree = levels(leaves, arity)
    assert whole.root == tree[-1][0] and not whole.open
    assert [len(x) for x in tree] == level_sizes(n, arity)
    runs = [(k, r, "".join(level[r * arity : (r + 1) * arity])) for k, level in enumerate(tree[:-1]) for r in range(-(-len(level) // arity))]
    assert sorted(whole.done) == sorted(runs)


@pytest.mark.parametrize("arity,partitions", [(2, 40), (3, 7), (16, 40)])
def test_manifest_by_force(spark, arity, partitions):
    rnd = random.Random(arity)
    data = [(rnd.choice([None, *range(900)]), rnd.choice([None, "", "a", "ä", "-", "hot", "hot", "hot", "hot", "hot"]), digest(str(rnd.randrange(2000)))) for _ in range(1500)]
    data += [(5, f"lone {i}", digest(f"x{i}")) for i in range(30)] + data[:20]
    held = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        df = spark.createDataFrame(data, "doc_id long, source string, leaf string").withColumn("_key", F.lit(1)).withColumn("proof", F.lit("clash"))
        found = manifest(df.withColumn("extra", F.col("doc_id") + 1), keep=("extra",), arity=arity)
        got = found.withColumn("folded", fold(F.col("leaf"), F.col("proof"))).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found.columns == ["doc_id", "source", "leaf", "extra", "subroot", "root", "proof"]
    have = [(g.doc_id, g.source, g.leaf, g.subroot, g.root, [tuple(p) for p in g.proof]) for g in got]
    assert sorted(map(str, have)) == sorted(map(str, by_force(data, arity)))
    assert all(g.folded == g.root and g.extra == (None if g.doc_id is None else g.doc_id + 1) for g in got)


def test_lone_leaf_and_empty_table(spark):
    one = spark.createDataFrame([(None, None, digest("x"))], "doc_id long, source string, leaf string")
    assert [tuple(r) for r in manifest(one).collect()] == [(None, None, digest("x"), digest("x"), digest("x"), [])]
    assert manifest(one.limit(0)).collect() == []


def test_leaf_digest(spark):
    df = spark.createDataFrame([(7, "é", None), (None, "", "-")], "a int, b string, c string")
    got = [r[0] for r in df.select(leaf_digest(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [digest("1:72:é-"), digest("-0:1:-")]


def test_query_equals_its_sql(spark):
    found = QUERIES["op11_merkle"](spark, SF).toPandas()
    assert rows(found) == rows(database().sql(ORACLE_SQL["op11_merkle"]).df())
    assert not found.verified.all() and found.verified.mean() > 0.7
