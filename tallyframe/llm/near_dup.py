"""Near-duplicate detection with SetSketch registers.

1. Documents with the same shingle set are one class; its smallest id stands for it.
2. Bands of registers deal the classes to buckets. Each bucket links its members to one leader only.
3. A link's similarity is estimated from both sets of registers; what can reach the threshold is verified
   on the full shingle sets, and verified links are joined to components.
4. In buckets that still hold several components, the members outside the leader's component are compared
   with all members of other components, block by block, on registers; what can reach the threshold is
   verified too. A pair is compared in the first band it shares. So no pair that shares a bucket is left
   out, and a group of many near copies costs a link for each member and not for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import in_turn, slices
from .common import written
from .components import components
from .shingles import SetSketch, shingle_set

#: Registers of a band, and bands: a pair at similarity 0.8 shares no band once in 10 million pairs.
BAND, BANDS = 6, 54
#: An estimate may be this much below the threshold: over five standard deviations at 324 registers.
MARGIN = 0.11
#: Members of a block, partners that one task verifies, and rows of a partition in verification.
BLOCK, PARTNERS, ROWS = 128, 32, 4_096


def sketches(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n`` (size of the shingle set), ``digest`` of the set and ``registers``, one row each.

    A null text, and one without words, has an empty set and neither digest nor registers. Rows are
    independent: null ids and repeated rows need no special case, an empty table gives an empty result, and
    other columns are dropped.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = SetSketch(BAND * BANDS)
        for batch in in_turn(batches):
            for a, texts in slices(batch.column(1)):
                sets = [shingle_set(t, words) for t in texts]
                levels = sketch.registers(sets)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(a, len(texts)),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "digest": pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                        "registers": pa.array([r.tobytes() if len(s) else None for s, r in zip(sets, levels, strict=True)], pa.binary()),
                    }
                )

    return rows.mapInArrow(run, "doc_id long, n long, digest binary, registers binary")


def _digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _levels(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BAND * BANDS)


def _likely(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b), those whose estimated similarity may reach ``least``."""
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))
    rows = rows.select("a", "b", "n_a", "n_b", "r_a", "r_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = SetSketch(BAND * BANDS)
        for batch in in_turn(batches):
            if batch.num_rows:
                x, y = _levels(batch.column(4)), _levels(batch.column(5))
                sizes = [batch.column(c).to_numpy().astype(np.float64) for c in (2, 3)]
                # a higher level is an earlier hit
                found = sketch.estimate((x > y).sum(1), (x < y).sum(1), *sizes)
                yield batch.select([0, 1]).filter(pa.array(found >= least - MARGIN))

    return rows.mapInArrow(run, "a long, b long")


def _verified(wanted: DataFrame, docs: DataFrame, words: int, least: int) -> DataFrame:
    """Links (a, b) with 100 * intersection >= least * union on the full shingle sets.

    ``wanted`` has ``task``, ``doc_id`` and ``partners``: the ids in the same task to compare with. A task
    holds two blocks of documents at most. The work goes by rows and not by bytes, so the partitions are
    counted from the rows.
    """
    wanted = written(wanted, "wanted")
    parts = max(wanted.sparkSession.sparkContext.defaultParallelism, -(-wanted.count() // ROWS))
    rows = wanted.join(docs, "doc_id").select("task", "doc_id", "partners", "text")
    rows = rows.repartition(parts, "task").sortWithinPartitions("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, asked = None, {}, []

        def links() -> pa.RecordBatch:
            out = []
            for a, partners in asked:
                x = held[a]
                for b in partners:
                    y = held.get(b)
                    if y is None or 100 * min(len(x), len(y)) < least * max(len(x), len(y)):
                        continue
                    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    both = int((x[at] == y).sum())
                    if 100 * both >= least * (len(x) + len(y) - both):
                        out.append((a, b))
            columns = list(zip(*out, strict=True)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

        for batch in in_turn(batches):
            for task, doc, partners, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                if task != now:
                    if asked:
                        yield links()
                    now, held, asked = task, {}, []
                found = shingle_set(text.as_py(), words)
                if not len(found):  # a row without shingles has no sketch either
                    continue
                if doc not in held or _digest(found) < _digest(held[doc]):  # of a repeated id, the same text as its sketch
                    held[doc] = found
                if partners:
                    asked.append((doc, partners))
        if asked:
            yield links()

    return rows.mapInArrow(run, "a long, b long")


def _rest_of_buckets(members: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Compare what the leaders left apart; gives rows for ``_verified``.

    ``members`` has ``band``, ``key``, ``doc_id``, ``component`` and the bucket's ``leader`` and ``home``
    (the leader's component).
    """
    members = members.drop("size").withColumn("away", F.col("component") != F.col("home"))
    sizes = members.groupBy("band", "key", "away").agg(F.count("*").alias("size"))
    open_keys = sizes.filter("away").select("band", "key")
    rows = members.join(open_keys, ["band", "key"], "left_semi").join(sizes, ["band", "key", "away"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / BLOCK)))
    rows = rows.join(reps.select("doc_id", "n", "registers"), "doc_id")
    fields = F.struct("doc_id", "component", "n", "registers", (F.col("doc_id") == F.col("leader")).alias("leads"))
    blocks = rows.groupBy("band", "key", "away", "block").agg(F.collect_list(fields).alias("rows"))
    blocks = written(blocks, "blocks")
    left = blocks.filter("away").select("band", "key", F.col("block").alias("left_block"), F.col("rows").alias("left"))
    right = blocks.select("band", "key", "away", "block", F.col("rows").alias("right"))
    both = left.join(right, ["band", "key"]).filter("NOT away OR block >= left_block")
    task = F.xxhash64("band", "key", "left_block", "away", "block")
    both = both.select(task.alias("task"), "band", (F.col("away") & (F.col("block") == F.col("left_block"))).alias("same"), "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = SetSketch(BAND * BANDS)
        for batch in in_turn(batches):
            for row in range(batch.num_rows):
                task, band, same = (batch.column(c)[row].as_py() for c in range(3))
                (ids, comps, ns, regs, leads), (ids2, comps2, ns2, regs2, leads2) = (batch.column(c)[row].values.flatten() for c in (3, 4))
                n, n2 = ns.to_numpy().astype(np.float64), ns2.to_numpy().astype(np.float64)
                ok = comps.to_numpy()[:, None] != comps2.to_numpy()[None, :]
                ok &= np.minimum(n[:, None], n2) >= least * np.maximum(n[:, None], n2)
                ok &= ~np.array(leads.to_pylist(), bool)[:, None] & ~np.array(leads2.to_pylist(), bool)
                if same:
                    ok &= ids.to_numpy()[:, None] < ids2.to_numpy()
                i, j = np.nonzero(ok)
                x, y = _levels(regs), _levels(regs2)
                keep = []
                for s in range(0, len(i), 4096):
                    p, q = i[s : s + 4096], j[s : s + 4096]
                    shared = (x[p] == y[q]).reshape(len(p), BANDS, BAND).all(2)
                    first = shared.argmax(1) == band
                    p, q = p[first], q[first]
                    found = sketch.estimate((x[p] > y[q]).sum(1), (x[p] < y[q]).sum(1), n[p], n2[q])
                    likely = found >= least - MARGIN
                    keep.append((p[likely], q[likely]))
                if not keep:
                    continue
                p, q = (np.concatenate(c) for c in zip(*keep, strict=True))
                if not len(p):
                    continue
                ids, ids2 = ids.to_numpy(), ids2.to_numpy()
                partners = {int(ids[a]): ids2[q[p == a]].tolist() for a in np.unique(p)}
                docs = [*partners, *({int(ids2[b]) for b in np.unique(q)} - set(partners))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array([partners.get(d, []) for d in docs], pa.list_(pa.int64()))],
                    ["task", "doc_id", "partners"],
                )

    return both.mapInArrow(run, "task long, doc_id long, partners array<long>")


def near_duplicates(docs: DataFrame, least: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents that chains of links connect; a link is a similarity of ``least`` percent or more.

    Returns one row per input row: ``id_col``, ``n_shingles``, ``component_id`` (the smallest id that can be
    reached) and ``kept`` (the id is its component's).

    Null or empty texts and texts without words have no shingles and are linked with nothing. Rows with a
    null id are returned with a null component, kept, and linked with nothing. Rows that repeat an id are
    one node with one component; if their texts differ, the one with the smallest digest is compared. An empty table gives an empty result; other columns are dropped.
    """
    share = least / 100
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = written(sketches(rows, words), "sketches")
    sets = sketched.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    nodes = sets.groupBy("doc_id").agg(F.min("digest").alias("digest"))
    classes = written(nodes.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")  # so that the join below can split a hot digest
    member = nodes.join(classes, "digest").select("doc_id", "rep")
    firsts = classes.select(F.col("rep").alias("doc_id"), "digest")
    reps = written(sets.join(firsts, ["doc_id", "digest"]).dropDuplicates(["doc_id"]).select("doc_id", "n", "registers"), "reps")

    band = lambda i: F.struct(F.lit(i).alias("band"), F.xxhash64(F.substring("registers", i * BAND + 1, BAND)).alias("key"))
    dealt = reps.select("doc_id", F.inline(F.array(*map(band, range(BANDS)))))
    buckets = dealt.groupBy("band", "key").agg(F.min("doc_id").alias("leader"), F.count("*").alias("size")).filter("size > 1")
    members = written(dealt.join(buckets, ["band", "key"]), "members")
    # whole texts move once; those that share no bucket are never read again
    texts = written(rows.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "texts")

    stars = members.filter("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    likely = written(_likely(stars, reps, share), "likely")
    degree = likely.groupBy("a").agg(F.count("*").alias("degree"))
    tasks = likely.join(degree, "a").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("degree") / PARTNERS))).alias("task"))
    tasks = written(tasks, "tasks")  # the join left the links of one leader together; read again, they are dealt by task
    wanted = tasks.groupBy("task", "a").agg(F.collect_list("b").alias("partners")).select("task", F.col("a").alias("doc_id"), "partners")
    wanted = wanted.unionByName(tasks.select("task", F.col("b").alias("doc_id"), F.array().cast("array<long>").alias("partners")))
    first = written(_verified(wanted, texts, words, least), "links")
    joined = components(first)

    placed = members.filter("size > 2").join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "doc_id"))
    home = joined.select(F.col("node").alias("leader"), F.col("component").alias("home"))
    placed = placed.join(home, "leader", "left").withColumn("home", F.coalesce("home", "leader"))
    second = _verified(_rest_of_buckets(placed, reps, share), texts, words, least)
    groups = components(first.unionByName(second)).select(F.col("node").alias("rep"), "component")

    out = sketched.select("doc_id", "n").join(member, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = out.join(groups, "rep", "left")
    component = F.coalesce("component", "rep")
    return out.select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
