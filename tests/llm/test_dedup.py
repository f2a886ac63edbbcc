import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyframe.llm.common import table
from tallyframe.llm.components import components
from tallyframe.llm.exact_dedup import exact_dedup
from tallyframe.llm.line_dedup import line_dedup
from tallyframe.llm.near_dup import near_duplicates
from tallyframe.llm.queries import QUERIES
from tallyframe.llm.shingles import SetSketch, shingle_set

from ..compare import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, keep_id int, component_id string, n long, digest string, registers int, key int, `rows` int"


def docs(spark, rows):
    """Documents with other columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "x", 2, "d", 3, 4, 5) for i, t in rows], SCHEMA)


def texts(n=300, seed=1):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    out = [" ".join(r.choices(words, k=r.randint(8, 60))) for _ in range(n)]
    for t in out[:40]:
        for _ in range(r.randint(1, 5)):
            w = t.split()
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w).upper() if r.random() < 0.3 else " ".join(w))
    base = r.choices(words, k=120)  # a large group of near copies, some too far from the first
    for _ in range(200):
        w = list(base)
        for _ in range(r.randint(1, 4)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    out += ["", None, " \n", "one two", "One two", "É a b c d e", "é a b c d e", "a" * 200_000, "x " * 50_000]
    r.shuffle(out)
    return list(enumerate(out))


def test_exact_dedup(spark):
    rows = [*texts(), (None, "one two"), (None, "only null id"), (7777, "twice"), (7777, "twice")]
    got = exact_dedup(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    want = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in got)


def test_exact_dedup_compares_content_where_digests_collide(spark):
    rows = [(1, "same"), (2, "SAME"), (3, "four"), (4, "other"), (5, "thing"), (6, "other"), (7, "lonely one"), (8, None), (9, "")]
    got = {x.doc_id: (x.keep_id, x.group_size, x.kept) for x in exact_dedup(docs(spark, rows), digest=lambda t: F.octet_length(t)).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True), 4: (6, 2, False), 6: (6, 2, True), 5: (5, 1, True), 7: (7, 1, True), 8: (9, 2, False), 9: (9, 2, True)}


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    found = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                found[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        lost = [len(key(x)) >= 10 and len(found[key(x)]) > 1 and i is not None and i != min(found[key(x)], key=lambda j: (j is not None, j or 0)) and i != min(j for j in found[key(x)] if j is not None) for x in lines]
        out.append((i, len(lines), sum(lost), "\n".join(x for x, gone in zip(lines, lost, strict=True) if not gone)))
    return sorted(map(str, out))


def test_line_dedup(spark):
    r = random.Random(3)
    pool = ["a common line %d" % i for i in range(8)] + ["short", "", "  A Common Line 1\t", "\x0bcommon éléphant line", "\xa0a common line 2"]
    rows = [(i, "\n".join(r.choices(pool, k=r.randint(1, 6)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a line found twice here\na line found twice here"), (103, "\n".join(f"own line number {i}" for i in range(3000)))]
    rows += [(104, "repeated row text"), (104, "repeated row text")]
    got = line_dedup(docs(spark, rows)).collect()
    assert sorted(str((x.doc_id, x.n_lines, x.n_dropped, x.kept_text)) for x in got) == brute_lines(rows)


def brute_near(rows, least):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= least * len(x | y):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


@pytest.mark.parametrize("least", [80, 85])
def test_near_duplicates(spark, least):
    rows = texts()
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_duplicates(docs(spark, rows), least=least).collect()}
    assert got == brute_near(rows, least)


def test_query_near_dup_against_brute_force(spark):
    found = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in QUERIES["op8_near_dup"](spark, SF).collect()}
    assert found == brute_near([(x.doc_id, x.text) for x in table(spark, SF, "documents").collect()], 85)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (2, "A B C D E F"), (3, None)]
    got = sorted(map(str, (tuple(x) for x in near_duplicates(docs(spark, rows)).collect())))
    assert got == sorted(map(str, [(None, 2, None, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True)]))


def test_near_duplicates_of_an_id_with_an_empty_and_a_real_text(spark):
    rows = []
    for i in range(12):  # the digest of the empty set is below that of some of these texts
        text = " ".join(f"w{i}x{k}" for k in range(60))
        rows += [(i, ("", None, " \n")[i % 3]), (i, text), (i + 100, text + " end")]
    got = {(x.doc_id, x.component_id) for x in near_duplicates(docs(spark, rows)).collect()}
    assert got == {(i, i) for i in range(12)} | {(i + 100, i) for i in range(12)}


@pytest.mark.parametrize("f", [exact_dedup, line_dedup, near_duplicates])
def test_empty_tables(spark, f):
    assert f(docs(spark, [])).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(500, 501), (501, 501), (None, 1)], "a long, b long")
    got = {x.node: x.component for x in components(links).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 500: 500, 501: 500}


def test_sketch_estimates_similarity():
    sketch = SetSketch(324)
    text = [f"v{i}" for i in range(2000)]
    other = text[:1800] + [f"u{i}" for i in range(200)]
    a, b = shingle_set(" ".join(text)), shingle_set(" ".join(other))
    x, y = sketch.registers([a, b]).astype(int)
    real = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    import numpy as np

    est = sketch.estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([float(len(a))]), np.array([float(len(b))]))[0]
    assert abs(est - real) < 0.1
    both = sketch.registers([np.unique(np.concatenate([a, b]))]).astype(int)[0]
    assert (both == np.maximum(x, y)).mean() == 1.0  # registers of a union are the larger ones
