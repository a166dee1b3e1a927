"""Nearest neighbours by a block matrix join with int8 tiles."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_ROWS = 4096  # rows of a block of queries
TILE_ROWS = 4096  # rows of a block of candidates
_STRIP = 1024  # candidates compared in one matrix product
_SLACK = 1e-6  # relative room for rounding in the bounds


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vec`` of rows that take part: no null, non-finite or all-zero vector, and an id."""
    vec = F.col("embedding").cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))


def quantise(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, squared lengths after scaling, and the lengths of what rounding lost."""
    scale = np.abs(rows).max(axis=1) / 127.0
    small = np.rint(rows / scale[:, None]).astype(np.int8)
    back = small * scale[:, None]
    return small, scale, (back * back).sum(axis=1), np.sqrt(((rows - back) ** 2).sum(axis=1))


def bounds(left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances between quantised rows.

    Products of int8 entries are exact: in float32 up to 1,040 dimensions, in
    float64 above. By the triangle inequality a true distance differs from the
    quantised one by at most the two rounding losses.
    """
    (a, sa, na, ea), (b, sb, nb, eb) = left, right
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    product = (a.astype(kind) @ b.astype(kind).T).astype(np.float64)
    size = na[:, None] + nb[None, :]
    squared = size - 2.0 * product * sa[:, None] * sb[None, :]
    room = _SLACK * size
    off = ea[:, None] + eb[None, :]
    low = np.sqrt(np.maximum(squared - room, 0.0)) - off
    high = np.sqrt(np.maximum(squared + room, 0.0)) + off
    return low * (1 - _SLACK), high * (1 + _SLACK)


def exact(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances row by row, summed in the order of the components."""
    total = np.zeros(len(left))
    for j in range(left.shape[1]):
        gap = left[:, j] - right[:, j]
        total += gap * gap
    return np.sqrt(total)


def _tile(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> list[tuple[int, int, float]]:
    """The k nearest candidates of each query in one tile, kept in one heap per query."""
    q, c = np.stack(queries["vec"]).astype(float), np.stack(candidates["vec"]).astype(float)
    qid, cid = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
    heaps: list[list[tuple[float, int]]] = [[] for _ in qid]
    small, limit = quantise(q), np.full(len(qid), np.inf)
    for at in range(0, len(cid), _STRIP):
        ids, part = cid[at:at + _STRIP], c[at:at + _STRIP]
        low, high = bounds(small, quantise(part))
        own = qid[:, None] == ids[None, :]
        low[own] = high[own] = np.inf
        if len(ids) > k:  # the k-th upper bound of the strip caps what can still be among the nearest
            limit = np.minimum(limit, np.partition(high, k - 1, axis=1)[:, k - 1])
        row, col = np.nonzero((low <= limit[:, None]) & ~own)
        for i, vec_id, d in zip(row.tolist(), ids[col].tolist(), exact(q[row], part[col]).tolist()):
            heap, item = heaps[i], (-d, -vec_id)
            if len(heap) < k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
            if len(heap) == k:
                limit[i] = min(limit[i], -heap[0][0])
    return [(int(qid[i]), -v, -d) for i, heap in enumerate(heaps) for d, v in heap]


def _cell(k: int):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        if len(queries) and len(candidates):
            sizes = candidates["vec"].map(len)
            for size, some in queries.groupby(queries["vec"].map(len)):
                same = candidates[sizes == size]
                # rows that repeat a vec_id with another vector are compared round by round, so none hides the other
                rounds = same.groupby("vec_id").cumcount().to_numpy() if len(same) else np.empty(0, int)
                for turn in np.unique(rounds):
                    found += _tile(some, same[rounds == turn], k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, query_rows: int = QUERY_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of ``vectors`` for every row of ``queries``.

    Both tables have ``vec_id, embedding``. Rows are dealt by a hash of their id into
    blocks of a bounded size; each pair of a query block and a candidate block is one
    cell, so the work is queries x candidates and no more, the memory that of two
    blocks. In a cell int8 products bound all distances, pairs that can be among the k
    nearest are recomputed in double precision and kept in heaps; the k best of each
    cell are merged by rank.

    Exact: recall is 1. Nearest first, ties to the smaller vec_id. Null, zero,
    empty or non-finite vectors and null ids take no part; vectors of another length
    have no distance. Of rows that repeat a vec_id the nearest counts; a repeated
    query is searched once (with its smallest vector). Fewer candidates than k: all
    of them. Empty tables give no rows; other columns are ignored.
    """
    rows = usable(vectors)
    asked = usable(queries).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    n, m = rows.count(), asked.count()
    tiles, blocks = max(1, -(-n // tile_rows)), max(1, -(-m // query_rows))
    # explode copies each row once per block of the other side: n * blocks + m * tiles rows
    right = rows.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).alias("tile"), F.explode(_numbers(blocks)).alias("block"))
    left = asked.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.explode(_numbers(tiles)).alias("tile"))
    found = left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile")).applyInPandas(_cell(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
