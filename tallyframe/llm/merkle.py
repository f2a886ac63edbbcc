"""Merkle manifests: a tree of digests for each group of rows, a tree over the groups, and a proof for each row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import in_turn
from .common import written

#: Digits of a hexadecimal digest.
DIGITS = 64
#: Levels of a block: its ``arity ** LEVELS`` leaves are one unit of work on the way down.
LEVELS = 3
#: Tasks whose fragments meet in one group of a round on the way up.
FAN = 16

PROOF = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def field(value: Column) -> Column:
    """The bytes of a value's text form, counted, or ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """The digest of a row; rows of different values never have the same input."""
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings, level by level, lead to."""
    return F.aggregate(proof, leaf, lambda digest, level: F.sha2(F.concat(level["left"], digest, level["right"]), 256))


def level_sizes(n: int, arity: int) -> list[int]:
    """The number of nodes on each level of a tree of ``n`` leaves."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // arity))
    return sizes


class Forest:
    """Unresolved nodes of one tree of ``n`` leaves, keyed by level and index: a commutative monoid under ``merge``.

    The number of nodes on each level is known, so the number of siblings of any run is too: a run of which all
    are here becomes their parent at once. Completed runs of level ``least`` or more are kept in ``done``.
    """

    def __init__(self, n: int, arity: int, least: int = 0):
        self.n, self.arity, self.least = n, arity, least
        self.sizes = level_sizes(n, arity)
        self.open: dict[tuple[int, int], dict[int, str]] = {}
        self.done: list[tuple[int, int, str]] = []
        self.root: str | None = None

    def add(self, level: int, index: int, digest: str) -> None:
        while level < len(self.sizes) - 1:
            run, place = divmod(index, self.arity)
            here = self.open.setdefault((level, run), {})
            here[place] = digest
            if len(here) < min(self.arity, self.sizes[level] - run * self.arity):
                return
            del self.open[level, run]
            joined = "".join(d for _, d in sorted(here.items()))
            if level >= self.least:
                self.done.append((level, run, joined))
            level, index, digest = level + 1, run, hashlib.sha256(joined.encode()).hexdigest()
        self.root = digest

    def nodes(self) -> Iterator[tuple[int, int, str]]:
        for (level, run), here in self.open.items():
            for place, digest in here.items():
                yield level, run * self.arity + place, digest
        if self.root is not None:
            yield len(self.sizes) - 1, 0, self.root

    def merge(self, other: Forest) -> Forest:
        for node in other.nodes():
            self.add(*node)
        self.done += other.done
        return self


_OPEN, _RUN, _ROOT = 0, 1, 2
_FRAGMENT = {"_key": pa.string(), "_part": pa.int64(), "_n": pa.int64(), "_state": pa.int32(), "_level": pa.int32(), "_at": pa.int64(), "_digests": pa.string()}
_FRAGMENT_TYPE = "_key string, _part long, _n long, _state int, _level int, _at long, _digests string"


def _fragment(key: str, part: int, forest: Forest) -> list[tuple]:
    """A forest as rows: its root or open nodes, and the runs completed in it."""
    whole = forest.root is not None
    out = [(key, part, forest.n, _ROOT if whole else _OPEN, *node) for node in forest.nodes()]
    return out + [(key, part, forest.n, _RUN, *run) for run in forest.done]


def _table(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_FRAGMENT)
    return pa.table([pa.array(c, k) for c, k in zip(columns, _FRAGMENT.values(), strict=True)], list(_FRAGMENT))


def _placed(items: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The items with their place ``_index`` among the ``_n`` of their key, and the task ``_part`` that sorted them.

    Items are dealt out by ranges of key and order, so a key of any size spreads over as many tasks as it fills.
    What is added up to places is counts by key and task, not items.
    """
    ranged = items.repartitionByRange("_key", *order).sortWithinPartitions("_key", *order)
    row = F.monotonically_increasing_id()
    ranged = written(ranged.withColumn("_row", row).withColumn("_part", F.shiftright("_row", 33)), "leaves")
    counts = ranged.groupBy("_key", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_here"))
    of_key = Window.partitionBy("_key")
    before = F.sum("_here").over(of_key.orderBy("_part")) - F.col("_here")
    counts = counts.select("_key", "_part", F.sum("_here").over(of_key).alias("_n"), (before - F.col("_first")).alias("_shift"))
    placed = ranged.join(written(counts, "counts"), ["_key", "_part"])
    return placed.withColumn("_index", F.col("_row") + F.col("_shift")).drop("_row", "_shift")


def _resolved(leaves: DataFrame, arity: int) -> tuple[DataFrame, DataFrame]:
    """The root of each key, and the completed runs of block roots and of what is above them.

    Each task folds its leaves into forests. Their open nodes, fewer than ``2 * arity`` on a level, are reduced as
    a tree: in each round the fragments of ``FAN`` neighbouring tasks merge.
    """

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = part = forest = None
        out: list[tuple] = []
        for batch in in_turn(batches):
            for k, p, n, index, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if forest:
                        out += _fragment(key, part, forest)
                    key, part, forest = k, p, Forest(n, arity, LEVELS)
                forest.add(0, index, digest)
            yield from _table(out).to_batches()
            out = []
        if forest:
            yield from _table(_fragment(key, part, forest)).to_batches()

    def merged(found: pa.Table) -> pa.Table:
        rows = list(zip(*(c.to_pylist() for c in found.columns), strict=True))
        forest = Forest(rows[0][2], arity, LEVELS)
        for _, _, _, _, level, index, digest in rows:
            forest.add(level, index, digest)
        return _table(_fragment(rows[0][0], rows[0][1], forest))

    ordered = leaves.select("_key", "_part", "_n", "_index", "_digest").sortWithinPartitions("_key", "_index")
    rounds = [written(ordered.mapInArrow(up, _FRAGMENT_TYPE), "fragments")]
    last = rounds[0].filter(F.col("_state") == _OPEN).agg(F.max("_part")).first()[0]
    while last is not None:
        last = last // FAN or None
        waiting = rounds[-1].filter(F.col("_state") == _OPEN).withColumn("_part", F.floor(F.col("_part") / FAN))
        rounds.append(written(waiting.groupBy("_key", "_part").applyInArrow(merged, _FRAGMENT_TYPE), "fragments"))
    found = reduce(DataFrame.unionByName, rounds)
    roots = found.filter(F.col("_state") == _ROOT).select("_key", "_n", F.col("_digests").alias("_root"))
    return roots, found.filter(F.col("_state") == _RUN).select("_key", "_level", F.col("_at").alias("_run"), "_digests")


def _contexts(tops: DataFrame, runs: DataFrame, arity: int, given: list[str]) -> DataFrame:
    """One row for each block of each key: the way from the block's root to the root, and the columns ``given``."""
    size = arity**LEVELS
    blocks = tops.withColumn("_block", F.explode(F.expr(f"sequence(0L, (_n - 1) div {size})")))
    # the block's root is child 0 of level LEVELS; its ancestor on a level is found by whole division
    levels = F.expr(f"filter(sequence({LEVELS}, 62), l -> power({arity}.0D, l) < _n)")
    steps = blocks.select("_key", "_block", F.explode(levels).alias("_level"))
    steps = steps.withColumn("_child", F.expr(f"_block div cast(power({arity}.0D, _level - {LEVELS}) as long)")).withColumn("_run", F.expr(f"_child div {arity}"))
    start = F.expr(f"cast(_child % {arity} as int) * {DIGITS}")
    left, right = F.substring("_digests", F.lit(1), start), F.substring("_digests", start + DIGITS + 1, F.lit(arity * DIGITS))
    above = steps.join(runs, ["_key", "_level", "_run"]).groupBy("_key", "_block")
    above = above.agg(F.array_sort(F.collect_list(F.struct("_level", left.alias("left"), right.alias("right")))).alias("_above"))
    above = above.withColumn("_above", F.transform("_above", lambda s: F.struct(s["left"].alias("left"), s["right"].alias("right"))))
    out = blocks.join(above, ["_key", "_block"], "left")
    way = F.concat(F.coalesce("_above", F.array().cast(PROOF)), F.col("_upper"))
    return out.select("_key", "_block", F.lit(-1).cast("long").alias("_index"), "_n", way.alias("_above"), *given)


def _proofs(leaves: DataFrame, tops: DataFrame, runs: DataFrame, arity: int, keep: list[str]) -> DataFrame:
    """The leaves' ``keep`` columns, the further columns of their key in ``tops``, and ``proof``.

    ``tops`` has a row for each key, with the way from its root on in ``_upper``. A block of leaves and the way
    from its root meet in one sorted stream, so that a task holds one block and one batch.
    """
    given = [c for c in tops.columns if c not in ("_key", "_n", "_upper")]
    rows = leaves.select("_key", F.expr(f"_index div {arity**LEVELS}").alias("_block"), "_index", *(c for c in keep if c != "_key"))
    both = rows.unionByName(_contexts(tops, runs, arity, given), allowMissingColumns=True)
    both = both.repartition("_key", "_block").sortWithinPartitions("_key", "_block", "_index")

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in in_turn(batches):
            new = pa.Table.from_batches([batch])
            rest = new if rest is None else pa.concat_tables([rest, new])
            starts = [i for i, x in enumerate(rest["_index"].to_pylist()) if x == -1]
            for a, b in zip(starts, starts[1:], strict=False):
                yield proved(rest.slice(a, b - a))
            rest = rest.slice(starts[-1])
        if rest is not None:
            yield proved(rest)

    def proved(block: pa.Table) -> pa.RecordBatch:
        """The leaves of a block, whose first row is its context."""
        digests = block["_digest"].to_pylist()[1:]
        way = block["_above"][0].as_py()
        beyond = [[x[side] for x in way] for side in ("left", "right")]
        level, joined = digests, []
        for _ in range(min(LEVELS, len(level_sizes(block["_n"][0].as_py(), arity)) - 1)):
            joined.append(["".join(level[i : i + arity]) for i in range(0, len(level), arity)])
            level = [hashlib.sha256(x.encode()).hexdigest() for x in joined[-1]]
        left: list[str] = []
        right: list[str] = []
        for i in range(len(digests)):
            for runs_here in joined:
                i, place = divmod(i, arity)
                left.append(runs_here[i][: place * DIGITS])
                right.append(runs_here[i][(place + 1) * DIGITS :])
            left += beyond[0]
            right += beyond[1]
        steps = len(joined) + len(way)
        ends = pa.array(range(0, steps * len(digests) + 1, steps) if steps else [0] * (len(digests) + 1), pa.int32())
        sides = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
        own = [block[c].slice(1).combine_chunks() for c in keep]
        theirs = [pa.repeat(block[c][0], len(digests)) for c in given]
        return pa.RecordBatch.from_arrays([*own, *theirs, pa.ListArray.from_arrays(ends, sides)], [*keep, *given, "proof"])

    schema = T.StructType([*(leaves.schema[c] for c in keep), *(tops.schema[c] for c in given), T.StructField("proof", PROOF)])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    return both.mapInArrow(down, schema)


def manifest(rows: DataFrame, leaf_col: str = "leaf", id_col: str = "doc_id", group_col: str = "source", keep: tuple[str, ...] = (), arity: int = 16) -> DataFrame:
    """A tree of digests for each group, a tree over the groups' roots, and the siblings that prove each row.

    In a group, leaves ascend by id; while there are several nodes, each run of ``arity`` consecutive ones becomes
    the digest of its members' digests, the last run of a level as short as it is. Groups ascend by their
    bytes, the null group first, and their roots form the last tree in the same way.

    Returns one row per input row: ``id_col``, ``group_col``, ``leaf_col``, ``keep``, ``subroot`` (of the group), ``root``
    and ``proof``, an array by level, from the leaf's run to the root, of the joined digests ``left`` and ``right``
    of the node. ``fold`` leads a leaf and a proof to a root.

    A null id is below every other. Rows with the same id, and repeated rows, are leaves of their own, ordered by
    their digests. A null group is a group. An empty table gives an empty result. Other columns are dropped, and
    names of the result must not be among ``keep``.
    """
    carried = {c: f"_k{i}" for i, c in enumerate(keep)}
    group = F.col(group_col).cast("string")
    items = rows.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("-")).alias("_key"),  # a null group is below the others
        F.col(id_col).alias("_id"),
        F.col(leaf_col).alias("_digest"),
        *(F.col(old).alias(new) for old, new in carried.items()),
    )
    placed = _placed(items, ("_id", "_digest"))
    roots, runs = _resolved(placed, arity)
    subroots = written(roots, "subroots")
    above = subroots.select(F.lit("").alias("_key"), F.col("_key").alias("_group"), F.col("_root").alias("_digest"))
    above = _placed(above, ("_group",))
    top, upper_runs = _resolved(above, arity)
    ends = top.select("_key", "_n", F.col("_root").alias("_top"), F.array().cast(PROOF).alias("_upper"))
    upper = _proofs(above, ends, upper_runs, arity, ["_group", "_digest"])
    upper = upper.select(F.col("_group").alias("_key"), F.col("_digest").alias("_subroot"), "_top", F.col("proof").alias("_upper"))
    tops = written(subroots.select("_key", "_n").join(upper, "_key"), "tops")
    found = _proofs(placed, tops, runs, arity, ["_key", "_id", "_digest", *carried.values()])
    return found.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_key") != "-", F.expr("substring(_key, 2)")).alias(group_col),
        F.col("_digest").alias(leaf_col),
        *(F.col(new).alias(old) for old, new in carried.items()),
        F.col("_subroot").alias("subroot"),
        F.col("_top").alias("root"),
        "proof",
    )
