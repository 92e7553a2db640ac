"""Oversampling of the smaller class by interpolation between near neighbours.

Exact nearest neighbours come from a pivot index.  Every vector belongs to the cell of
its nearest pivot; a cell is sorted by the distance to the pivot and cut into rings of
bounded size.  A ring first looks for neighbours in itself, which bounds how far any of
its rows has to look; by the triangle inequality a second ring whose distances to the
pivots put it beyond that bound holds no neighbour and is never met.  Equal vectors are
one row with their smallest numbers, so copies, however many, cost no more than one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from marketsense.session import stage

NEIGHBOURS = 5
RING = 1024  # rows of a ring, and rows a pivot stands for
MOST_PIVOTS = 2048  # a matrix of so many distances is held by each task; cells are larger beyond
STRIP = 128  # rows compared at a time
BUCKETS = 16**3


def class_counts(df: DataFrame, label: str = "label") -> dict[int, int]:
    """Rows per class (two numbers reach the driver)."""
    rows = df.groupBy(label).count().collect()
    return {int(row[label]): row["count"] for row in rows}


def hash_number(*parts: Column | str, digits: tuple[int, int] = (1, 8)) -> Column:
    """Some hexadecimal digits of the MD5 of the parts as a number; any SQL engine can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])), *digits), 16, 10).cast("bigint")


def dense_index(df: DataFrame, key: str = "id") -> DataFrame:
    """Add ``point``, a dense 0-based number in the order of the MD5 of ``key``, then ``key``."""
    rows = df.withColumn("_md5", F.md5(F.col(key).cast("string"))).withColumn("_bucket", F.substring("_md5", 1, 3))
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    starts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_bucket").orderBy("_md5", key)
    rows = rows.join(F.broadcast(starts), "_bucket")  # at most ``BUCKETS`` rows, and one for null keys
    return rows.withColumn("point", F.col("_start") + F.row_number().over(inside) - 1).drop("_bucket", "_start", "_md5")


def _near(x: np.ndarray, ids: np.ndarray, y: np.ndarray, others: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best (squared distance, number) per row of ``x`` of those known and the rows of ``y``, a row itself aside.

    A matrix product sorts out most pairs; the others' distances are summed up exactly,
    so ties are ties and go to the smaller number.
    """
    known, names = best
    square_x, square_y = (x * x).sum(axis=1), (y * y).sum(axis=1)
    slack = 1e-12 * (square_x.max(initial=0) + square_y.max(initial=0)) + 1e-300
    known, names = known.copy(), names.copy()
    for start in range(0, len(x), STRIP):
        part = slice(start, start + STRIP)
        about = square_x[part, None] + square_y[None, :] - 2 * (x[part] @ y.T)
        about[ids[part, None] == others[None, :]] = np.inf
        reach = known[part, -1]
        if len(y) > k:
            reach = np.minimum(reach, np.partition(about, k - 1, axis=1)[:, k - 1])
        row, column = np.nonzero(about <= reach[:, None] + slack)
        some = np.isfinite(about[row, column])
        row, column = row[some], column[some]
        exact = ((x[part][row] - y[column]) ** 2).sum(axis=1)
        size = len(known[part])
        rows = np.concatenate([np.repeat(np.arange(size), k), row])
        distances, numbers = np.concatenate([known[part].ravel(), exact]), np.concatenate([names[part].ravel(), others[column]])
        order = np.lexsort((numbers, distances, rows))
        # Every row has k entries at least, so its first k are its best.
        first = np.searchsorted(rows[order], np.arange(size))
        chosen = order[first[:, None] + np.arange(k)[None, :]]
        known[part], names[part] = distances[chosen], numbers[chosen]
    return known, names


def _nothing(rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((rows, k), np.inf), np.full((rows, k), np.iinfo(np.int64).max)


def _matrix(values) -> np.ndarray:
    matrix = np.array(list(values), np.float64)
    if not np.isfinite(matrix).all():
        raise ValueError("features must be finite; impute or drop such rows first")
    return matrix


def _rings(distinct: DataFrame, k: int, ring: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(rows with ring, cell and distance to the pivot; one row per ring with its bounds; pivots).

    Range partitioning by (cell, distance) deals out cells of any size; a ring never
    crosses a partition.  ``bound`` of a ring: no row of it has to look farther for
    ``k`` neighbours.
    """
    spark, count = distinct.sparkSession, distinct.count()
    wanted = max(1, min(MOST_PIVOTS, -(-count // ring)))
    pivots = _matrix([row.features for row in distinct.orderBy(F.xxhash64("own"), "own").limit(wanted).select("features").collect()])
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = shared.value
        squares = (centres * centres).sum(axis=1)
        for batch in batches:
            x = _matrix(batch["features"])
            cell = np.argmin(squares[None, :] - 2 * (x @ centres.T), axis=1)
            yield batch.assign(cell=cell, reach=np.sqrt(((x - centres[cell]) ** 2).sum(axis=1)))

    fields = "own bigint, copies int, features array<double>, cell bigint, reach double"
    ordered = distinct.mapInPandas(assign, fields).repartitionByRange("cell", "reach", "own").sortWithinPartitions("cell", "reach", "own")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Consecutive rows of a cell, at most ``ring`` of them, and how far each has to look."""
        number, held = TaskContext.get().partitionId() << 32, []

        def closed(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal number
            x, ids = _matrix(rows["features"]), rows["own"].to_numpy(np.int64)
            far = _near(x, ids, x, ids, _nothing(len(x), k), k)[0][:, -1]
            # With more copies than neighbours wanted, all of these are at no distance.
            far = np.where(rows["copies"].to_numpy() > k, 0.0, np.sqrt(far))
            number += 1
            return rows.assign(ring=number, bound=far)

        for batch in batches:
            held.append(batch)
            rows = pd.concat(held, ignore_index=True) if len(held) > 1 else batch
            cell = rows["cell"].to_numpy()
            edges = np.append(np.flatnonzero(np.diff(cell, prepend=cell[:1] - 1)), len(rows)).tolist()
            pieces = [(low, min(low + ring, high)) for start, high in pairwise(edges) for low in range(start, high, ring)]
            for low, high in pieces[:-1]:
                yield closed(rows.iloc[low:high])
            held = [rows.iloc[slice(*pieces[-1])]] if pieces else []
        if held:
            yield closed(held[0].reset_index(drop=True))

    rows = stage(ordered.mapInPandas(cut, f"{fields}, ring bigint, bound double"), "rings")
    bounds = rows.groupBy("ring", "cell").agg(F.min("reach").alias("low"), F.max("reach").alias("high"), F.max("bound").alias("bound"), F.count(F.lit(1)).alias("n"))
    return rows, bounds, pivots


def _ring_pairs(bounds: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """(ring, other): all pairs of rings of which the second may hold neighbours of the first's rows.

    Two rows are at least as far apart as the difference of their distances to one
    pivot.  First whole cells are compared (a bounded table), then the rings of the cell
    pairs that are left, by an equi-join on the cells.
    """
    spark = bounds.sparkSession
    cells = bounds.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.max("bound").alias("bound")).collect()
    names = np.array([cell.cell for cell in cells], np.int64)
    low, high, n, bound = (np.array([cell[name] for cell in cells], float) for name in ("low", "high", "n", "bound"))
    centres = pivots[names]
    apart = np.sqrt(np.maximum(((centres**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * centres @ centres.T), 0))
    # A cell with more than k rows has k neighbours for anyone within the way to its farthest row.
    enough = np.where(n > k, apart + high[None, :], np.inf).min(axis=1, initial=np.inf)
    shared = spark.sparkContext.broadcast((names, low, high, bound, apart, enough))
    slack = 1e-9

    def partners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, low, high, bound, apart, enough = shared.value
        for batch in batches:
            for at in batch["id"]:
                gap = np.maximum(np.maximum(apart[at] - high[at] - high, low[at] - apart[at] - high), low - apart[at] - high[at])
                gap[at] = 0
                reach = min(bound[at], high[at] + enough[at])
                near = np.flatnonzero(gap <= reach + slack * (apart[at] + high + high[at]))
                yield pd.DataFrame({"cell": names[at], "other_cell": names[near], "apart": apart[at][near], "enough": enough[at]})

    near = spark.range(len(names)).mapInPandas(partners, "cell bigint, other_cell bigint, apart double, enough double")
    mine = bounds.select("ring", "cell", "low", "high", "bound")
    other = bounds.select(F.col("ring").alias("other"), F.col("cell").alias("other_cell"), F.col("low").alias("from"), F.col("high").alias("to"))
    gap = F.when(F.col("cell") == F.col("other_cell"), F.greatest(F.col("low") - F.col("to"), F.col("from") - F.col("high"))).otherwise(
        F.greatest(F.col("apart") - F.col("high") - F.col("to"), F.col("low") - F.col("apart") - F.col("to"), F.col("from") - F.col("apart") - F.col("high"))
    )
    reach = F.least("bound", F.col("high") + F.col("enough")) + slack * (F.col("apart") + F.col("high") + F.col("to"))
    return mine.join(near, "cell").join(other, "other_cell").where((F.col("ring") != F.col("other")) & (gap <= reach)).select("ring", "other")


def _best_rows(rows: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(own, others, distances): the ``k`` nearest other rows of each row, by distance, then number.

    The rows of a ring are followed by those of its partners, which stream past; a task
    holds one ring, one batch of its partners and ``k`` rows per row of the ring.
    """
    mine = rows.select(F.col("ring"), F.lit(0).alias("kind"), "own", "features")
    theirs = rows.select(F.col("ring").alias("other"), "own", "features").join(pairs, "other").select("ring", F.lit(1).alias("kind"), "own", "features")
    stream = mine.unionByName(theirs).repartition("ring").sortWithinPartitions("ring", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring, x, ids, best = None, None, None, None

        def found() -> pa.RecordBatch:
            distances, names = best
            there = np.isfinite(distances)
            offsets = pa.array(np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(part[there])) for part in (names, np.sqrt(distances))]
            return pa.RecordBatch.from_arrays([pa.array(ids), *lists], ["own", "others", "distances"])

        for batch in batches:
            if not len(batch):
                continue
            rings, kinds, own = (batch.column(place).to_numpy() for place in range(3))
            features = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            cuts = np.append(np.flatnonzero(np.diff(rings, prepend=rings[:1] - 1) | np.diff(kinds, prepend=-1)), len(batch)).tolist()
            for low, high in pairwise(cuts):
                some, numbers = features[low:high], own[low:high]
                if kinds[low] == 0:
                    if rings[low] != ring:
                        if ring is not None:
                            yield found()
                        ring, x, ids, best = rings[low], some[:0], numbers[:0], _nothing(0, k)
                    # A ring may come in several batches: old rows meet the new ones, new rows meet all.
                    older = _near(x, ids, some, numbers, best, k)
                    x, ids = np.concatenate([x, some]), np.concatenate([ids, numbers])
                    newer = _near(some, numbers, x, ids, _nothing(len(some), k), k)
                    best = tuple(np.concatenate(both) for both in zip(older, newer))
                else:
                    best = _near(x, ids, some, numbers, best, k)
        if ring is not None:
            yield found()

    return stream.mapInArrow(search, "own bigint, others array<bigint>, distances array<double>")


def nearest_neighbours(points: DataFrame, k: int = NEIGHBOURS, ring: int = RING) -> DataFrame:
    """Exact k nearest other points: (point, neighbour, place), Euclidean, ties to the smaller number.

    ``points``: point bigint (unique), features array<double> of one length, all finite.
    A point with fewer than ``k`` others gets all of them.
    """
    spots = [F.xxhash64(F.lit(seed), F.col("features")).alias(name) for seed, name in enumerate(("_a", "_b"))]
    keyed = points.select("point", "features", *spots)
    copy = Window.partitionBy("_a", "_b").orderBy("point")
    few = keyed.withColumn("_copy", F.row_number().over(copy)).where(F.col("_copy") <= k + 1)
    distinct = few.groupBy("_a", "_b").agg(F.first("features").alias("features"), F.sort_array(F.collect_list("point")).alias("ids"))
    distinct = stage(distinct.withColumns({"own": F.col("ids")[0], "copies": F.size("ids")}), "distinct-points")
    if distinct.isEmpty():
        return points.select("point", F.col("point").alias("neighbour"), F.lit(0).alias("place")).limit(0)
    rows, bounds, pivots = _rings(distinct.select("own", "copies", "features"), k, ring)
    bounds = stage(bounds, "ring-bounds")
    best = _best_rows(rows, _ring_pairs(bounds, pivots, k), k)
    # Numbers of the neighbours' copies and of the row's own, nearest first.
    listed = best.select("own", F.explode(F.arrays_zip("others", "distances")).alias("one")).select("own", F.col("one.others").alias("other"), F.col("one.distances").alias("far"))
    met = listed.join(distinct.select(F.col("own").alias("other"), "ids"), "other").select("own", "far", "ids")
    met = met.unionByName(distinct.select("own", F.lit(0.0).alias("far"), "ids"))
    pairs = F.transform("ids", lambda one: F.struct(F.col("far").alias("far"), one.alias("neighbour")))
    answers = met.groupBy("own").agg(F.sort_array(F.flatten(F.collect_list(pairs))).alias("_answer"))
    answers = distinct.select("own", "_a", "_b").join(answers, "own").select("_a", "_b", "_answer")
    chosen = F.slice(F.filter("_answer", lambda one: one["neighbour"] != F.col("point")), 1, k)
    ranked = keyed.select("point", "_a", "_b").join(answers, ["_a", "_b"]).select("point", F.posexplode(chosen).alias("place", "_one"))
    return ranked.select("point", F.col("_one.neighbour").alias("neighbour"), "place")


def smote(df: DataFrame, k: int = NEIGHBOURS, seed: int = 42, label: str = "label") -> DataFrame:
    """Rows of ``df`` (id, label, features array) and synthetic ones until the classes balance.

    Synthetic rows (id null) lie between a row of the smaller class and one of
    its k nearest neighbours of that class; which one and where follows from an
    MD5 of the row's number and the copy's, so results repeat.  The synthetic rows are
    a range that is dealt out by its numbers: few rows of the smaller class do not mean
    few tasks.
    """
    counts = class_counts(df, label)
    if len(counts) != 2:
        raise ValueError("exactly two classes are needed")
    small = min(counts, key=lambda c: (counts[c], c))
    n_small, missing = counts[small], max(counts.values()) - counts[small]
    base = df.select("id", label, "features")
    if missing == 0:
        return base
    if n_small < 2:
        raise ValueError("the smaller class needs at least two rows")
    points = stage(dense_index(base.where(F.col(label) == small)).select("point", "features"), "points")
    reach = min(k, n_small - 1)
    target = points.select(F.col("point").alias("neighbour"), F.col("features").alias("target"))
    near = nearest_neighbours(points, reach).join(target, "neighbour").join(points, "point").select("point", "place", "features", "target")
    # Each point makes missing/n copies, the first missing%n points one more.
    made = df.sparkSession.range(missing).select((F.col("id") % n_small).alias("point"), F.floor(F.col("id") / n_small).alias("copy"))
    place = hash_number("point", "copy", F.lit(seed)) % reach
    share = hash_number("point", "copy", F.lit(seed), digits=(9, 8)) / float(1 << 32)
    made = made.select("point", place.cast("int").alias("place"), share.alias("share")).join(near, ["point", "place"])
    mixed = F.zip_with("features", "target", lambda a, b: a + F.col("share") * (b - a))
    kinds = dict(base.dtypes)
    synthetic = made.select(F.lit(None).cast(kinds["id"]).alias("id"), F.lit(small).cast(kinds[label]).alias(label), mixed.alias("features"))
    return base.unionByName(synthetic)
