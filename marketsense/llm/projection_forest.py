"""Approximate nearest neighbours with a forest of random-projection trees.

Every inner node of a tree holds the difference of two vectors as its direction and the
median of the projections as its threshold; the nodes are fitted on a bounded sample,
and every vector is routed to one leaf of each tree.  A query pops the nodes of all
trees from one shared priority queue, best margin first, until the leaves it has popped
hold as many rows as the budget says; all rows of these leaves are scored exactly.

The budget is measured, not guessed: some queries are answered by brute force over all
rows, and the budget is what finds the wanted share of their true neighbours.

Equal vectors are one row with its smallest ids, so however many copies a vector has, a
leaf holds it once.  Leaves lie side by side in parts of bounded size, and a leaf larger
than a part is cut into several, all of which a query visits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketsense.llm.common import numbered
from marketsense.session import stage

TREES = 8
LEAF = 512  # vectors a leaf holds as long as the sample allows
RECALL = 0.95  # share of the true neighbours that the budget is measured to find
SAMPLE_BYTES = 16_000_000  # of the vectors the forest is fitted on
LEAST_SAMPLE = 16  # sampled vectors of a leaf
PROBES = 128  # queries that the budget is measured with
PART_BYTES = 16_000_000  # of the vectors a task holds: a query leaves k rows in each part it visits, so few large parts
PAIRS = 400_000  # scored pairs a task keeps before it drops all but the best


@dataclass
class Forest:
    """Complete binary trees of one depth, nodes level by level."""

    directions: np.ndarray  # trees x nodes x width
    thresholds: np.ndarray  # trees x nodes
    depth: int

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """The cell (tree * leaves + leaf) of each vector in each tree."""
        cells = np.empty((len(vectors), len(self.thresholds)), np.int64)
        for tree, (directions, thresholds) in enumerate(zip(self.directions, self.thresholds)):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", vectors, directions[node]) > thresholds[node]
                node = 2 * node + 1 + right
            cells[:, tree] = tree * self.leaves + node - (self.leaves - 1)
        return cells

    def margins(self, vectors: np.ndarray) -> np.ndarray:
        """How far each vector lies on the right of each node's threshold (vectors x trees x nodes)."""
        return np.einsum("ij,tnj->itn", vectors, self.directions, optimize=True) - self.thresholds


def fit_forest(sample: np.ndarray, trees: int, depth: int, seed: int = 11) -> Forest:
    """A forest over the sample; a node that has no two different vectors sends all to its left."""
    width, nodes = sample.shape[1], (1 << depth) - 1
    directions, thresholds = np.zeros((trees, nodes, width)), np.zeros((trees, nodes))
    for tree in range(trees):
        random = np.random.default_rng([seed, tree])
        members = {0: np.arange(len(sample))}
        for node in range(nodes):
            held = members.pop(node)
            if len(held) > 1:
                one, other = random.choice(held, 2, replace=False)
                direction = sample[one] - sample[other]
                size = np.linalg.norm(direction)
                if size > 0:
                    directions[tree, node] = direction / size
                    thresholds[tree, node] = np.median(sample[held] @ directions[tree, node])
            right = sample[held] @ directions[tree, node] > thresholds[tree, node]
            members[2 * node + 1], members[2 * node + 2] = held[~right], held[right]
    return Forest(directions, thresholds, depth)


def popped_cells(margins: np.ndarray, counts: np.ndarray, leaves: int, budget: float) -> list[int]:
    """The cells one query visits: nodes of all trees in one priority queue, widest margin first, until ``budget`` rows are reached."""
    queue = [(-np.inf, tree, 0) for tree in range(len(margins))]
    cells, reached, inner = [], 0, leaves - 1
    while queue and reached < budget:
        reach, tree, node = heapq.heappop(queue)
        if node >= inner:
            cell = tree * leaves + node - inner
            if counts[cell]:
                cells.append(cell)
                reached += counts[cell]
            continue
        margin = margins[tree, node]
        heapq.heappush(queue, (max(reach, margin), tree, 2 * node + 1))
        heapq.heappush(queue, (max(reach, -margin), tree, 2 * node + 2))
    return cells


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not all zeros."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _stacked(vectors, width: int) -> np.ndarray:
    """Vectors as a matrix of doubles, filled up with zeros."""
    if all(len(vector) == width for vector in vectors):
        return np.array(list(vectors), np.float64).reshape(-1, width)
    matrix = np.zeros((len(vectors), width))
    for row, vector in zip(matrix, vectors):
        row[: len(vector)] = vector[:width]
    return matrix


def _exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in one order wherever they are computed."""
    return (queries * rows).sum(axis=1)


def _best(query: np.ndarray, row: np.ndarray, score: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best different rows of each query: by score, then least id."""
    order = np.lexsort((row, least, -score, query))
    q, r = query[order], row[order]
    order = order[np.concatenate([[True], (q[1:] != q[:-1]) | (r[1:] != r[:-1])])] if len(order) else order
    q = query[order]
    first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else q
    return order[place < k]


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, part_bytes: int = PART_BYTES
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows found nearest (largest inner product) to each query.

    Both tables: id long, vector array<float or double>.  Rows with a null id or an
    unusable vector (``usable``) take no part.  A query never finds rows of its own id;
    rows that repeat an id are queries and candidates of their own, and equal rows of a
    query all count.  Ties go to the smaller id; queries with fewer than ``k``
    candidates return all.  Vectors of different lengths are compared as if filled up
    with zeros.  Scores are exact.

    What reaches the driver and what is broadcast is bounded: a sample of
    ``SAMPLE_BYTES``, the nodes fitted on it (at most a sixteenth of its vectors a
    tree), a count a leaf, and the true neighbours of ``PROBES`` queries.  Beyond
    ``leaf`` times that many rows leaves grow with the table.
    """
    spark = vectors.sparkSession
    keys = ["key_a", "key_b"]
    # Vectors travel in their own precision; sums are doubles.
    kinds = {df.schema["vector"].dataType.elementType.typeName() for df in (vectors, queries)}
    kind = np.dtype(np.float32 if kinds == {"float"} else np.float64)

    def keyed(df: DataFrame) -> DataFrame:
        sound = df.filter(F.col("id").isNotNull() & usable(F.col("vector")))
        hashes = [F.xxhash64(F.lit(seed), F.col("vector")).alias(name) for seed, name in enumerate(keys)]
        return sound.select(F.col("id").cast("long").alias("id"), "vector", *hashes)

    # A row per different vector, with its smallest ids: a query needs no more than k of them beside its own.
    copies = Window.partitionBy(*keys).orderBy("id")
    few = keyed(vectors).withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1)
    distinct = few.groupBy(*keys).agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("id")).alias("ids"))
    kept = numbered(distinct.withColumn("least", F.col("ids")[0]), "forest-rows")
    asked = stage(keyed(queries), "forest-queries")
    asking = asked.groupBy(*keys).agg(F.first("vector").alias("vector"))

    facts = kept.agg(F.count("*").alias("rows"), F.max(F.size("vector")).alias("width")).first()
    if not facts.rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = max(facts.width, asked.agg(F.max(F.size("vector")).alias("width")).first().width or 0)
    most = max(LEAST_SAMPLE, SAMPLE_BYTES // (8 * width))
    share = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(min(1.0, most / facts.rows) * (1 << 30))
    sample = _stacked([row.vector for row in kept.filter(share).select("vector").limit(2 * most).collect()], width)
    wanted = max(1, min(-(-facts.rows // leaf), len(sample) // LEAST_SAMPLE))
    forest = fit_forest(sample, trees, int(np.ceil(np.log2(wanted))))
    shared = spark.sparkContext.broadcast(forest)

    def count_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(trees * shared.value.leaves, np.int64)
        for batch in batches:
            total += np.bincount(shared.value.route(_stacked(batch["vector"], width)).ravel(), minlength=len(total))
        yield pd.DataFrame({"cell": np.flatnonzero(total), "n": total[total > 0]})

    counts = np.zeros(trees * forest.leaves, np.int64)
    for row in kept.select("vector").mapInPandas(count_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[row.cell] = row.n

    budget = _measured_budget(kept, asking, forest, counts, k, recall, width)
    # Leaves one after the other, in parts of about as many rows; a leaf that is larger is cut into blocks.
    size = max(1, part_bytes // (kind.itemsize * width))
    blocks = np.maximum(1, -(-counts // size))
    per_block = np.repeat(-(-counts // blocks), blocks)
    part_of_block = (np.cumsum(per_block) - per_block) // size
    first_block = np.cumsum(blocks) - blocks
    layout = spark.sparkContext.broadcast((counts, blocks, first_block, part_of_block))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, blocks, first, part = layout.value
        for batch in batches:
            matrix = _stacked(batch["vector"], width)
            cells, rows = shared.value.route(matrix), batch["row"].to_numpy(np.int64)
            packed = [row.tobytes() for row in matrix.astype(kind)]
            for tree in range(trees):
                block = first[cells[:, tree]] + rows % blocks[cells[:, tree]]
                yield pd.DataFrame({"part": part[block], "cell": cells[:, tree], "row": rows, "least": batch["least"].to_numpy(np.int64), "vector": packed})

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, blocks, first, part = layout.value
        for batch in batches:
            matrix, found = _stacked(batch["vector"], width), []
            for low in range(0, len(matrix), 256):
                margins = shared.value.margins(matrix[low : low + 256])
                for at, (vector, margin) in enumerate(zip(matrix[low : low + 256], margins), low):
                    cells = np.array(popped_cells(margin, counts, shared.value.leaves, budget), np.int64)
                    block = np.repeat(first[cells], blocks[cells]) + np.concatenate([np.arange(n) for n in blocks[cells]])
                    cells, parts = np.repeat(cells, blocks[cells]), part[block]
                    for some in np.unique(parts):
                        chosen = np.unique(cells[parts == some])
                        found.append((int(some), batch["key_a"].iloc[at], batch["key_b"].iloc[at], vector.astype(kind).tobytes(), chosen.astype(np.int32).tobytes()))
            yield pd.DataFrame(found, columns=["part", *keys, "vector", "cells"])

    dealt = kept.select("row", "least", "vector").mapInPandas(deal, "part long, cell long, row long, least long, vector binary")
    visits = asking.mapInPandas(visit, "part long, key_a long, key_b long, vector binary, cells binary")

    def search(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        """All rows of the visited leaves of a part, scored exactly; the best of each query."""
        if not len(rows) or not len(asks):
            return pd.DataFrame({name: [] for name in [*keys, "row", "least", "score"]})
        rows = rows.sort_values("cell", kind="stable")
        matrix = np.frombuffer(b"".join(rows["vector"]), kind).reshape(-1, width)
        cell, number, least = rows["cell"].to_numpy(np.int64), rows["row"].to_numpy(np.int64), rows["least"].to_numpy(np.int64)
        wanted = np.frombuffer(b"".join(asks["vector"]), kind).reshape(-1, width).astype(np.float64)
        lists = [np.frombuffer(cells, np.int32) for cells in asks["cells"]]
        visited, visitor = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(cells) for cells in lists])
        order = np.argsort(visited, kind="stable")
        visited, visitor = visited[order], visitor[order]
        floor = np.full(len(asks), -np.inf)
        # A matrix product may round otherwise than the exact sum.
        slack = 1e-15 * width * np.linalg.norm(wanted, axis=1) * np.linalg.norm(matrix, axis=1).max()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pending = 0

        def pruned() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            query, place, score = (np.concatenate(some) for some in zip(*held))
            best = _best(query, number[place], score, least[place], k + 1)
            query, place, score = query[best], place[best], score[best]
            last = np.flatnonzero(np.bincount(query, minlength=len(asks)) == k + 1)
            floor[last] = score[np.searchsorted(query, last, side="right") - 1]
            return [(query, place, score)]

        for some in np.unique(visited):
            rows_of = slice(*np.searchsorted(cell, [some, some + 1]))
            asking_of = visitor[slice(*np.searchsorted(visited, [some, some + 1]))]
            for low in range(0, len(asking_of), 512):
                query = asking_of[low : low + 512]
                for start in range(rows_of.start, rows_of.stop, 4096):
                    stop = min(start + 4096, rows_of.stop)
                    block = matrix[start:stop].astype(np.float64)
                    score = wanted[query] @ block.T
                    q, r = np.nonzero(score >= (floor - slack)[query][:, None])
                    held.append((query[q], r + start, _exact(wanted[query[q]], block[r])))
                    pending += len(q)
                    if pending > PAIRS:
                        held = pruned()
                        pending = len(held[0][0])
        if not held:
            return pd.DataFrame({name: [] for name in [*keys, "row", "least", "score"]})
        ((query, place, score),) = pruned()
        return pd.DataFrame(
            {"key_a": asks["key_a"].to_numpy()[query], "key_b": asks["key_b"].to_numpy()[query], "row": number[place], "least": least[place], "score": score}
        )

    found = dealt.groupBy("part").cogroup(visits.groupBy("part")).applyInPandas(search, "key_a long, key_b long, row long, least long, score double")
    # A row may be found in several trees.
    once = found.groupBy(*keys, "row").agg(F.first("least").alias("least"), F.first("score").alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "least", "row")
    top = once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    many = kept.filter(F.size("ids") > 1).select("row", "ids")
    listed = top.join(many, "row", "left").select(*keys, "score", F.coalesce("ids", F.array("least")).alias("ids"))
    pairs = F.transform("ids", lambda one: F.struct((-F.col("score")).alias("far"), one.alias("id")))
    answers = listed.groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list(pairs))).alias("answer"))
    own = asked.select(*keys, F.col("id").alias("query_id")).join(answers, keys)
    chosen = F.slice(F.filter("answer", lambda one: one["id"] != F.col("query_id")), 1, k)
    ranked = own.select("query_id", F.posexplode(chosen).alias("place", "one"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("one.id").alias("vec_id"), (-F.col("one.far")).alias("score"))


def _measured_budget(kept: DataFrame, asking: DataFrame, forest: Forest, counts: np.ndarray, k: int, recall: float, width: int) -> float:
    """Rows that the popped leaves must hold together for ``recall`` of the true neighbours of some queries to be among them.

    ``PROBES`` queries meet all rows, block by block; a task keeps their ``k`` best.  A
    neighbour is found as soon as one of its leaves is popped.
    """
    spark = kept.sparkSession
    probes = asking.orderBy(F.xxhash64("key_a", "key_b")).limit(PROBES).collect()
    if not probes:
        return 0.0
    wanted = _stacked([row.vector for row in probes], width)
    shared = spark.sparkContext.broadcast((wanted, [(row.key_a, row.key_b) for row in probes], forest))

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, own, forest = shared.value
        own = {key: probe for probe, key in enumerate(own)}
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, len(forest.thresholds)), np.int64)]
        for batch in batches:
            matrix = _stacked(batch["vector"], width)
            score = wanted @ matrix.T
            for place, key in enumerate(zip(batch["key_a"], batch["key_b"])):
                if key in own:
                    score[own[key], place] = -np.inf
            few = min(k, len(matrix))
            near = np.argpartition(-score, few - 1, axis=1)[:, :few]
            probe = np.repeat(np.arange(len(wanted)), few)
            some = [probe, batch["row"].to_numpy(np.int64)[near.ravel()], score[probe, near.ravel()], forest.route(matrix[near.ravel()])]
            held = [np.concatenate(both) for both in zip(held, some)]
            best = _best(held[0], held[1], held[2], held[1], k)
            held = [part[best] for part in held]
        yield pd.DataFrame({"probe": held[0], "row": held[1], "score": held[2], "cells": list(held[3])})

    found = kept.select("row", "vector", "key_a", "key_b").mapInPandas(answer, "probe long, row long, score double, cells array<long>")
    ranked = Window.partitionBy("probe").orderBy(F.col("score").desc(), "row")
    true = found.filter("score > double('-Infinity')").withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= k).select("probe", "cells").collect()
    margins, needed = forest.margins(wanted), []
    reached = {}
    for probe in range(len(wanted)):
        cells = popped_cells(margins[probe], counts, forest.leaves, np.inf)
        reached[probe] = dict(zip(cells, np.cumsum(counts[cells]).tolist()))
    for row in true:
        needed.append(min(reached[row.probe][cell] for cell in row.cells))
    # No neighbours at all: the budget has no say.  A leaf a tree holds more rows than k in any case.
    return max(float(np.quantile(needed, recall, method="higher")) if needed else 0.0, float(len(forest.thresholds) * (k + 1)))
