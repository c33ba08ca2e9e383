"""Approximate nearest neighbours, made exact: a block matrix join of int8 products.

Queries and candidates are dealt to blocks of bounded size, and every pair of
blocks is one group. In it, tiles of int8 codes are multiplied; each product
bounds the true inner product by the norms of the two quantisation errors
(Cauchy-Schwarz). A pair survives if its upper bound reaches the ``k``-th best
lower bound that its query has so far, and survivors are computed from the
original vectors in double precision. Each group keeps a heap of ``k`` a query,
and the groups' heaps are merged by rank.

The query set is given (a fixed share of all rows), so this compares queries
with all rows in blocks; no other pairs are formed, and nothing is missed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch

K = 20
#: Rows of a block of queries and of candidates, and of a tile of candidates.
QUERY_BLOCK = 8192
CANDIDATE_BLOCK = 32768
TILE = 4096
QUERY_TILE = 256
_RESULT = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """No null, no zero vector, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scale, the norm of what they stand for, and the norm of the error, by row."""
    scale = np.abs(vectors).max(axis=1) / 127
    scale[scale == 0] = 1  # denormal components
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    stands = codes * scale[:, None]
    return codes, scale, np.linalg.norm(stands, axis=1), np.linalg.norm(vectors - stands, axis=1)


def block_top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int = K) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """Of each query, the ``k`` best (score, -id) among the candidates, best first."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    q_codes, q_scale, q_norm, q_error = quantise(queries)
    norms = np.linalg.norm(queries, axis=1)
    for low in range(0, len(ids), TILE):
        tile, tile_ids = vectors[low : low + TILE], ids[low : low + TILE]
        codes, scale, stands, error = quantise(tile)
        as_float = codes.astype(np.float32).T  # sums of int8 products are whole numbers that float32 holds up to 1,000 dimensions
        kind = np.float32 if codes.shape[1] <= 1000 else np.float64
        for start in range(0, len(query_ids), QUERY_TILE):
            chosen = slice(start, start + QUERY_TILE)
            products = (q_codes[chosen].astype(kind) @ as_float.astype(kind, copy=False)).astype(np.float64) * q_scale[chosen, None] * scale
            slack = q_error[chosen, None] * stands + norms[chosen, None] * error + 1e-9 * norms[chosen, None] * (stands + error)
            own = query_ids[chosen, None] == tile_ids
            lower = np.where(own, -np.inf, products - slack)
            best = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps[chosen]])
            if lower.shape[1] >= k:
                best = np.maximum(best, np.partition(lower, -k, axis=1)[:, -k])
            row, column = np.nonzero((products + slack >= best[:, None]) & ~own)
            for part in range(0, len(row), 1 << 16):
                r, c = row[part : part + (1 << 16)], column[part : part + (1 << 16)]
                scores = (queries[start + r] * tile[c]).sum(axis=1)
                floor = best[r]
                for i, score, number in zip((start + r)[scores >= floor - 1e-12].tolist(), scores[scores >= floor - 1e-12].tolist(), (-tile_ids[c])[scores >= floor - 1e-12].tolist(), strict=True):
                    heap = heaps[i]
                    if len(heap) < k:
                        heapq.heappush(heap, (score, number))
                    elif (score, number) > heap[0]:
                        heapq.heapreplace(heap, (score, number))
    for query, heap in zip(query_ids.tolist(), heaps, strict=True):
        yield query, sorted(heap, reverse=True)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    table = table.select(["vec_id", "vector"]).combine_chunks()
    n = table.num_rows
    flat = table["vector"].combine_chunks().flatten() if n else pa.array([], pa.float64())
    return table["vec_id"].to_numpy(), flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _join_blocks(k: int):
    def join(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if queries.num_rows and candidates.num_rows:
            query_ids, query_vectors = _matrix(queries)
            ids, vectors = _matrix(candidates)
            for query, heap in block_top(query_ids, query_vectors, ids, vectors, k):
                found[0].extend([query] * len(heap))
                found[1].extend(-number for _, number in heap)
                found[2].extend(score for score, _ in heap)
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return join


def nearest(table: DataFrame, is_query: Column, k: int = K, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: of each query, the ``k`` other rows of largest inner product.

    Ties go to the smaller id. Null ids, and vectors that are null, zero or hold
    a null or non-finite component, take no part; of rows that share an id, the
    least vector counts. Vectors are compared with those of their own length
    only. Fewer candidates than ``k`` are all returned; no rows give no rows.
    """
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("is_query"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).groupBy("vec_id", "is_query").agg(F.min("vector").alias("vector"))
    rows = scratch(rows.withColumn("length", F.size("vector")), "vectors")
    n, n_queries = rows.count(), rows.where("is_query").count()
    chunks, blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    everywhere = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    part = lambda m, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(m)).cast("int")
    queries = rows.where("is_query").select("length", part(blocks, 1).alias("block"), everywhere(chunks).alias("chunk"), "vec_id", "vector")
    candidates = rows.select("length", everywhere(blocks).alias("block"), part(chunks, 2).alias("chunk"), "vec_id", "vector")
    key = ("length", "block", "chunk")
    partial = queries.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInArrow(_join_blocks(k), _RESULT)
    ranked = partial.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
