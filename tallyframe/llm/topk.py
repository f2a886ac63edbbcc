"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a block: what one step of the kernel holds.
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4096


def integer_vector(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where the vector or a component is null or not finite."""
    values = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(values, lambda x: F.floor(x * scale)))


def scores_by_term(queries: np.ndarray, candidates: np.ndarray, tile: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """Inner products of integer rows, a tile of queries at a time.

    Column d of the candidates is the posting list of term d. Each query that has the term adds its
    weight times the postings to its dense array of scores; weights of 0 have no posting.
    """
    top = lambda m: max((abs(int(m.min())), abs(int(m.max()))), default=0) if m.size else 0
    kind = np.int32 if top(queries) * top(candidates) * max(1, queries.shape[1]) < 2**31 else np.int64
    queries, postings = queries.astype(kind), np.ascontiguousarray(candidates.T.astype(kind))
    filled = [np.flatnonzero(p) for p in postings]
    for s in range(0, len(queries), tile):
        part = queries[s : s + tile]
        scores = np.zeros((len(part), candidates.shape[0]), kind)
        for d, docs in enumerate(filled):
            having = np.flatnonzero(part[:, d])
            if not len(docs) or not len(having):
                continue
            if 2 * len(docs) >= len(postings[d]):
                for q in having:
                    scores[q] += part[q, d] * postings[d]
            else:
                scores[np.ix_(having, docs)] += part[having, d][:, None] * postings[d][docs]
        yield s, scores.astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller position, by partition selection."""
    if len(scores) <= k:
        return np.argsort(-scores, kind="stable")
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    over = np.flatnonzero(scores > least)
    ties = np.flatnonzero(scores == least)[: k - len(over)]
    found = np.concatenate([over, ties])
    return found[np.lexsort((found, -scores[found]))]


def _matrix(vectors: pa.ListScalar) -> np.ndarray:
    rows = vectors.values
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(rows.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])] = flat
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The ``k`` highest integer inner products of each query row with every row but its own.

    ``queries`` is a condition on the rows of ``vectors``. Both sides are packed into blocks; each block
    of queries goes once to each block of candidates, and only the best k of a block pair leave it.

    Returns ``query_id``, ``rank`` from 1, ``id_col`` and ``score``; ties go to the smaller id. Rows with a
    null id, a null vector, or a component that is null or not finite take no part, and neither do vectors without
    components. Scores are 64-bit integers: components must be so small that no sum of products passes 2^63.
    Missing components of shorter vectors count as 0. Repeated rows of an id are one candidate each, and none of them is a
    neighbour of its own id; a repeated query is asked once. Empty tables give an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), integer_vector(F.col(vector_col)).alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    rows = rows.filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    n = rows.count()
    blocks = max(1, -(-n // candidate_block))
    packed = F.array_sort(F.collect_list(F.struct("id", "v")))
    whole = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("c"))
    whole = whole.groupBy("c").agg(packed.alias("rows")).select("c", F.col("rows.id").alias("ids"), F.col("rows.v").alias("vs"))
    q_blocks = max(1, -(-rows.filter("q").count() // query_block))
    asked = rows.filter("q").select("id", "v").distinct().withColumn("b", F.pmod(F.xxhash64("id"), F.lit(q_blocks)))
    asked = asked.groupBy("b").agg(packed.alias("rows")).select("b", F.col("rows.id").alias("q_ids"), F.col("rows.v").alias("q_vs"))
    asked = asked.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("c", F.col("c").cast("long"))
    pairs = asked.join(whole.withColumn("c", F.col("c").cast("long")).hint("shuffle_merge"), "c").select("q_ids", "q_vs", "ids", "vs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, ids = (batch.column(c)[row].values.to_numpy() for c in (0, 2))
                q, v = (_matrix(batch.column(c)[row]) for c in (1, 3))
                width = max(q.shape[1], v.shape[1])
                q, v = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, v))
                out: list[tuple[np.ndarray, ...]] = []
                for s, scores in scores_by_term(q, v):
                    for i, row_scores in enumerate(scores):
                        own = q_ids[s + i]
                        a, b = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
                        if a < b:
                            row_scores[a:b] = np.iinfo(np.int64).min
                        at = best(row_scores, min(len(ids), k + b - a))
                        at = at[ids[at] != own][:k]
                        out.append((np.full(len(at), own), ids[at], row_scores[at]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["query_id", "id", "score"])

    found = pairs.mapInArrow(run, "query_id long, id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
