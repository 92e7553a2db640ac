"""Exact top-k search by inner product with MaxScore.

A dimension is a query term and its column in a shard is the term's posting list.  In
each shard a term can add to a score at least ``low`` and at most ``high``.  With the
current k-th best score of a query as threshold, the terms with the smallest bounds
that cannot reach it together are non-essential.  The essential postings are
traversed for all rows; the rows that can still compete are probed in the other
terms, widest bound first, and dropped as soon as they fall behind.  The best rows of
all shards are merged.  Thresholds are carried from shard to shard within a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketsense.session import stage

SHARD = 1024  # vectors of a shard
BLOCK = 256  # queries of a block
BLOCK_BYTES = 1 << 16  # of the vectors of a block
LANE = 16  # shards that a task searches one after the other
PROBE = 8  # non-essential terms probed at a time


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where the vector or a component is null or not finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & whole, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _packed(vectors: DataFrame, rows: int, block_bytes: int | None = None) -> DataFrame:
    """Groups of at most ``rows`` consecutive vectors of a task: (number, ids, width, kind, matrix), nothing is shuffled.

    Every row counts, whatever ids repeat; shorter vectors are filled up with zeros.
    Components take as few bytes as they need.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, vectors = batch["id"].to_numpy(np.int64), batch["vector"].tolist()
            width = max(map(len, vectors), default=0)
            matrix = np.zeros((len(ids), width), np.int64)
            for row, vector in zip(matrix, vectors):
                row[: len(vector)] = vector
            most = int(np.abs(matrix).max(initial=0))
            kind = "i2" if most < 1 << 15 else "i4" if most < 1 << 31 else "i8"
            step = min(rows, max(1, block_bytes // (int(kind[1]) * max(1, width)))) if block_bytes else rows
            starts = range(0, len(ids), step)
            cut = [matrix[start : start + step].astype(kind).tobytes() for start in starts]
            yield pd.DataFrame({"number": number + np.arange(len(starts)), "ids": [ids[start : start + step].tobytes() for start in starts], "width": width, "kind": kind, "matrix": cut})
            number += len(starts)

    return stage(vectors.select("id", "vector").mapInPandas(pack, "number long, ids binary, width int, kind string, matrix binary"), "maxscore")


class _Shard:
    """A shard's posting lists (its columns) with the bounds of each."""

    def __init__(self, ids: bytes, width: int, kind: str, matrix: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.columns = np.ascontiguousarray(np.frombuffer(matrix, kind).reshape(len(self.ids), width).T).astype(np.float64 if kind != "i8" else np.int64)
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)
        self.most = float(np.abs(self.columns).max(initial=0))


def best_of_shard(query: np.ndarray, own: int, columns: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the rows of a shard that reach ``threshold``, the query's own row aside.

    ``columns`` is the shard transposed; ``low`` and ``high`` are the least and greatest
    component of each column.
    """
    ends = query * low, query * high
    least, most = np.minimum(*ends), np.maximum(*ends)
    base, bound = least.sum(), most - least
    order = np.argsort(bound, kind="stable")
    reach = base + np.cumsum(bound[order])
    spare = int(np.searchsorted(reach, threshold, side="left"))  # non-essential: their bounds stay under the threshold
    essential, others = order[spare:], order[:spare][::-1]
    score = query[essential] @ columns[essential]
    rest = most[others].sum()
    rows = np.flatnonzero((score + rest >= threshold) & (ids != own))
    score = score[rows]
    for start in range(0, len(others), PROBE):
        if not len(rows):
            break
        terms = others[start : start + PROBE]
        score = score + query[terms] @ columns[np.ix_(terms, rows)]
        rest = rest - most[terms].sum()
        keep = score + rest >= threshold
        rows, score = rows[keep], score[keep]
    return ids[rows], score


def top_k(vectors: DataFrame, queries: DataFrame, k: int, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` with the highest inner product for each query.

    Both tables: id long, vector array<long>.  Rows with a null id or vector take no
    part.  Every other row is a candidate, and every row of ``queries`` asks; a query never
    finds rows of its own id.  Ties go to the smaller id, equal (score, id) rows all
    count; queries with fewer than ``k`` candidates return all.  Vectors of different
    lengths are compared as if filled up with zeros.

    Shards are dealt out to lanes of about ``LANE``; a lane gets each of its shards once and
    each query block once, so what moves grows with rows, and with queries times
    lanes, never with pairs of shards and blocks.  A task holds the shards of one lane.
    """
    known = F.col("id").isNotNull() & F.col("vector").isNotNull()
    shards, blocks = _packed(vectors.filter(known), shard), _packed(queries.filter(known), block, BLOCK_BYTES)
    lanes = max(1, -(-shards.count() // LANE))
    held = shards.select(F.pmod(F.xxhash64("number"), F.lit(lanes)).cast("int").alias("lane"), F.lit(0).alias("role"), *shards.columns)
    asked = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(1).alias("role"), *blocks.columns)
    work = held.unionByName(asked).repartition("lane").sortWithinPartitions("lane", "role", "number")

    def answers(row, lane: list[_Shard]) -> pd.DataFrame:
        """The best of a lane for each query of a block; thresholds are carried from shard to shard."""
        own = np.frombuffer(row.ids, np.int64)
        wanted = np.frombuffer(row.matrix, row.kind).reshape(len(own), row.width)
        most = float(np.abs(wanted).max(initial=0))
        found = []
        for place, (query, query_id) in enumerate(zip(wanted, own.tolist())):
            ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
            for part in lane:
                width = min(len(part.columns), len(query))
                # Doubles hold the sums exactly while they stay under 2 ** 53; else integers are used.
                kind = np.float64 if part.most * most * 4 * max(1, width) < 2**53 else np.int64
                columns = part.columns[:width].astype(kind, copy=False)
                threshold = scores[-1] if len(scores) == k else -np.inf
                low, high = part.low[:width].astype(kind, copy=False), part.high[:width].astype(kind, copy=False)
                more_ids, more = best_of_shard(query[:width].astype(kind), query_id, columns, low, high, part.ids, threshold)
                if len(more_ids):
                    ids, scores = np.concatenate([ids, more_ids]), np.concatenate([scores, more.astype(np.int64)])
                    first = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[first], scores[first]
            found.append((row.number, place, query_id, ids, scores))
        counts = [len(ids) for *_, ids, _ in found]
        return pd.DataFrame(
            {
                "block": row.number, "place": np.repeat([one[1] for one in found], counts), "query_id": np.repeat([one[2] for one in found], counts),
                "vec_id": np.concatenate([one[3] for one in found]), "score": np.concatenate([one[4] for one in found]),
            }
        )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, lane = None, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.lane != at:
                    at, lane = row.lane, []
                if row.role == 0:
                    lane.append(_Shard(row.ids, row.width, row.kind, row.matrix))
                else:
                    yield answers(row, lane)

    found = work.mapInPandas(search, "block long, place int, query_id long, vec_id long, score long")
    ranked = Window.partitionBy("block", "place").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
