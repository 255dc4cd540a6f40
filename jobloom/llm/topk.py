"""Exact top-k by inner product, with MaxScore bounds.

A query's terms are its dimensions. In a shard of vectors each term's gain over
its least possible contribution is bounded by the extremes of its postings. Terms
whose bounds together can't lift a vector over the k-th score so far are
non-essential: a batch of vectors is scored on the essential terms first, and
the others are probed only for vectors that still compete, term group by term
group. Shards are the partitions of the vectors as they lie; no vector is
shuffled. What moves is the best k of each query from each shard.

Queries go to the tasks in blocks of bounded size, one pass over the vectors each.

Components become floor(1024 * x); scores are exact integers. A vector that is
null or holds a null or non-finite component takes no part; a missing component of
a shorter vector counts as 0. Ties go to the smaller id. A null id takes no part.
Rows that repeat an id are separate candidates, but never of a query of their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window as W, functions as F

SCALE, K = 1024, 10
#: Queries sent to the tasks at a time.
BLOCK_ROWS = 1024
#: Vectors scored first, to get scores to beat, and then at a time; terms probed at a time.
FIRST_ROWS, BATCH_ROWS, PROBE = 64, 1024, 8
#: Products up to this stay exact in float64.
EXACT = 2.0 ** 53


def integers(vectors: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, v): the vectors that take part."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(key).isNotNull() & F.col(vec).isNotNull() & ~bad).select(
        F.col(key).alias("vec_id"), F.transform(vec, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def _matrix(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Rows of equal width, filled up with 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(column.offsets.to_numpy())
    width = max(int(size.max(initial=0)), width or 0)
    made = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    made[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return made


class Best:
    """The best k of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, 0), 0, np.int64)
        self.id = np.zeros((queries, 0), np.int64)
        self.real = np.zeros((queries, 0), bool)

    def floor(self) -> np.ndarray:
        """The score to reach, or minus infinity."""
        if self.score.shape[1] < self.k:
            return np.full(len(self.score), -np.inf)
        return np.where(self.real[:, self.k - 1], self.score[:, self.k - 1].astype(np.float64), -np.inf)

    def add(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        rows, slot = np.nonzero(self.real)
        q = np.concatenate([rows, query])
        s = np.concatenate([self.score[rows, slot], score])
        v = np.concatenate([self.id[rows, slot], vec])
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        shape = (len(self.score), self.k)
        self.score, self.id, self.real = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool)
        at = (q[keep], rank[keep])
        self.score[at], self.id[at], self.real[at] = s[keep], v[keep], True


def _search(ids: np.ndarray, queries: np.ndarray, batches: Iterator[pa.RecordBatch], k: int) -> Best:
    best, width = Best(len(ids), k), queries.shape[1]
    for batch in batches:
        edges = [*range(FIRST_ROWS, batch.num_rows, BATCH_ROWS), batch.num_rows]
        for at, end in zip([0, *edges], edges):
            part = batch.slice(at, end - at)
            vec = part.column("vec_id").to_numpy(zero_copy_only=False)
            rows = _matrix(part.column("v"), width)[:, :width]
            peak = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(width, 1)
            kind = np.float64 if peak < EXACT else object  # Python's integers don't overflow
            x, q = rows.astype(kind), queries.astype(kind)
            high, low = rows.max(axis=0, initial=-2 ** 62), rows.min(axis=0, initial=2 ** 62)
            up = np.maximum(q * high.astype(kind), q * low.astype(kind))  # bound of each query's terms
            down = np.minimum(q * high.astype(kind), q * low.astype(kind))
            terms = np.argsort(-(up - down).astype(np.float64).max(axis=0, initial=0), kind="stable")
            rest = np.zeros((len(ids), width + 1), kind)
            rest[:, :-1] = np.cumsum(up[:, terms][:, ::-1], axis=1)[:, ::-1]
            reach = best.floor()
            # Essential: the terms without which no vector of the batch can reach the k-th score of some query.
            gain = np.cumsum((up - down)[:, terms][:, ::-1].astype(np.float64), axis=1)[:, ::-1]
            least = down.sum(axis=1).astype(np.float64)[:, None]
            essential = int((least + gain >= reach[:, None]).sum(axis=1).max(initial=0)) if width else 0
            essential = min(width, max(PROBE, -(-essential // PROBE) * PROBE)) if width else 0
            first = terms[:min(essential, max(PROBE, width // 2))]
            score = q[:, first] @ x[:, first].T if width else np.zeros((len(ids), len(vec)), kind)
            own = ids[:, None] == vec[None, :]
            row, col = np.nonzero((score + rest[:, [len(first)]] >= reach[:, None]) & ~own)
            have = score[row, col]
            for start in range(len(first), width, PROBE):
                some = terms[start:start + PROBE]
                have = have + (q[row[:, None], some] * x[col[:, None], some]).sum(axis=1)
                go = have + rest[row, min(start + PROBE, width)] >= reach[row]
                row, col, have = row[go], col[go], have[go]
            if kind is object:  # a score beyond a long stays at its end
                have = np.array([min(max(int(h), -2 ** 63), 2 ** 63 - 1) for h in have], np.int64)
            best.add(row, vec[col], have.astype(np.int64))
    return best


def _blocks(queries: DataFrame, rows: int) -> Iterator[list[Row]]:
    """The queries in blocks of `rows`; the driver holds one block at a time."""
    block: list[Row] = []
    for row in queries.toLocalIterator():
        block.append(row)
        if len(block) == rows:
            yield block
            block = []
    if block:
        yield block


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, v) of candidates and queries -> (query_id, rank, vec_id, score)."""
    spark = vectors.sparkSession
    queries = queries.dropDuplicates(["vec_id", "v"])
    found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for block in _blocks(queries, block_rows):
        ids = np.array([r["vec_id"] for r in block], np.int64)
        matrix = _matrix(pa.array([r["v"] for r in block], pa.list_(pa.int64())))
        shared = spark.sparkContext.broadcast((ids, matrix))

        def search(batches, shared=shared):
            own, values = shared.value
            best = _search(own, values, batches, k)
            row, slot = np.nonzero(best.real)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[row]), pa.array(best.id[row, slot]), pa.array(best.score[row, slot])],
                names=["query_id", "vec_id", "score"])

        found = found.union(vectors.mapInArrow(search, found.schema))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
