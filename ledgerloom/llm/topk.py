"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are quantised to ``floor(256 * x)``; scores are integer inner products.
Candidates are dealt into blocks.  In a block each dimension has a list of the
vectors sorted by that component; a query walks the lists of its dimensions in
step, from the top where its own component is positive and from the bottom where
it is negative, looks every vector that turns up up in full, and stops once the
sum of what the lists can still offer is below the k-th result.  The blocks'
results of a query are then ranked together.

Queries meet candidates in blocks of both, never row by row.  Equal vectors of a
block are one entry with their smallest ids, as many as any result can use.

Edge cases
    * a null vector, or one with a null or non-finite component, takes no part,
      neither as query nor as candidate; null ids neither;
    * vectors of different lengths: missing components count as zero;
    * ties go to the smaller id, so the walk stops only when the bound is strictly
      below the k-th score;
    * components too large for exact doubles are multiplied as integers; scores beyond
      the range of a long saturate;
    * fewer than k other vectors: all of them are returned;
    * repeated rows are candidates of their own; a query is an id with its vector, so
      repeated rows of both are answered once and an id's different vectors each;
    * extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

K = 5
SCALE = 256
BLOCK_ROWS = 32_768
QUERY_ROWS = 16_384
LEAST_BLOCKS = 12


_MOST = 2**63 - 1024  # the largest double below the range of a long


class Lists:
    """The sorted lists of one block of distinct vectors."""

    def __init__(self, vectors: np.ndarray, exact: bool = False) -> None:
        # Doubles hold products exactly below 2**53; beyond it Python's integers do.
        self.kind = object if exact else np.float64
        self.vectors = vectors.astype(self.kind)
        self.order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)  # a list per dimension, ascending

    def search(self, query: np.ndarray, enough: int, step: int = 24) -> tuple[np.ndarray, np.ndarray]:
        """All vectors that can be among the best ``enough`` (ties included), and their scores."""
        count = len(self.vectors)
        dims = np.flatnonzero(query)
        if not len(dims):
            return np.arange(count), np.zeros(count, np.int64)
        weights = query[dims].astype(self.kind)
        rising = weights < 0
        seen = np.zeros(count, bool)
        ids, scores = [], []
        best = np.zeros(0, self.kind)
        depth = 0
        while depth < count:
            stop = min(count, depth + step)
            heads = np.concatenate([self.order[dims[rising], depth:stop].ravel(), self.order[dims[~rising], count - stop : count - depth].ravel()])
            met = np.zeros(count, bool)
            met[heads] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            values = self.vectors[new] @ query.astype(self.kind)
            ids.append(new)
            scores.append(values)
            best = np.concatenate([best, values])
            if len(best) > enough:
                best = np.partition(best, len(best) - enough)[len(best) - enough :]
            last = np.where(rising, self.order[dims, stop - 1], self.order[dims, count - stop])
            bound = (weights * self.vectors[last, dims]).sum()
            if len(best) >= enough and bound < best.min():
                break
            depth, step = stop, step * 2
        return np.concatenate(ids), np.clip(np.concatenate(scores), -(2**63), _MOST).astype(np.int64)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = [np.asarray(v.values) for v in column]
    out = np.zeros((len(rows), width), np.int64)
    for at, row in enumerate(rows):
        out[at, : len(row)] = row
    return out


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(place of the query, vector id, score)`` of each query's best ``k`` in the block, its own id left out."""
    large = np.abs(vectors.astype(float)).max(initial=0) * np.abs(queries.astype(float)).max(initial=0) * vectors.shape[1] >= 2**53
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
    _, first, kind = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
    by_kind = np.argsort(kind, kind="stable")
    starts = np.searchsorted(kind[by_kind], np.arange(len(first) + 1))
    lists = Lists(vectors[first], bool(large))
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
    for place, (query_id, query) in enumerate(zip(query_ids, queries, strict=True)):
        kinds, scores = lists.search(query, k + 1)
        if len(scores) > k + 1:
            least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            kinds, scores = kinds[scores >= least], scores[scores >= least]
        members = [ids[by_kind[starts[x] : starts[x + 1]]] for x in kinds]
        members = [m[m != query_id][:k] for m in members]
        everyone = np.concatenate(members)
        marks = np.repeat(scores, [len(m) for m in members])
        top = np.lexsort((everyone, -marks))[:k]
        found.append((np.full(len(top), place), everyone[top], marks[top]))
    a, b, c = zip(*found)
    return np.concatenate(a), np.concatenate(b), np.concatenate(c)


def _block_search(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        names = {"query_id": pa.int64(), "query": pa.string(), "vec_id": pa.int64(), "score": pa.int64()}
        if not vectors.num_rows or not queries.num_rows:
            return pa.table({n: pa.array([], t) for n, t in names.items()})
        width = max(max(len(v) for v in t.column("vector")) for t in (vectors, queries)) or 1
        place, *got = search_block(vectors.column("vec_id").to_numpy(), _matrix(vectors.column("vector"), width),
                                   queries.column("vec_id").to_numpy(), _matrix(queries.column("vector"), width), k)
        asked = queries.select(["vec_id", "query"]).take(pa.array(place))
        return pa.table([*asked.columns, *got], schema=pa.schema(names))

    return run


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, vector`` of the rows that take part."""
    given = F.col(vector_col).cast("array<double>")
    fine = given.isNotNull() & F.forall(given, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & fine)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(given, lambda x: F.floor(x * SCALE)).alias("vector"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's best ``k`` of ``vectors`` but its own id.

    Both have columns ``vec_id`` and ``vector`` (as :func:`quantised` makes them).
    """
    # A query is an id and its vector: copies of a row are one, an id's other vectors are others.
    queries = queries.select("vec_id", F.sha2(F.array_join("vector", ","), 256).alias("query"), "vector").dropDuplicates(["vec_id", "query"])
    blocks = max(LEAST_BLOCKS, math.ceil(vectors.count() / BLOCK_ROWS))
    parts = max(1, math.ceil(queries.count() / QUERY_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Candidates are dealt by row, so that many rows of one id or vector spread too.
    block = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int")
    left = vectors.select("vec_id", "vector", block.alias("block")).select("*", every(parts).alias("part"))
    right = queries.select("vec_id", "query", "vector", part.alias("part"), every(blocks).alias("block"))
    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_block_search(k), "query_id long, query string, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def self_search(vectors: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """The top ``k`` of the rows whose id is divisible by ``every``, against all rows."""
    rows = quantised(vectors)
    return top_k(rows, rows.where(F.col("vec_id") % every == 0), k)
