"""Document fingerprints by locally consistent parsing.

A text is a string of code points.  Each level parses its string into phrases by
deterministic coin tossing: runs of one symbol become one symbol, neighbours compare
the lowest bit in which their names differ, a few rounds leave labels below 6, and
local maxima of the labels start phrases.  A phrase's name is a hash of what it
holds, and the names are the next level's string.  Where a phrase starts depends on
a bounded number of neighbours only, so equal substrings get equal phrases in their
interior, wherever they lie.  A fingerprint is a bottom-k sketch of the names of the
upper levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketsense.llm.common import mix64, text_chunks

LEVELS = 3  # phrases of the last level are about 25 to 40 code points long
SKETCH = 64
CHUNK = 400_000  # code points parsed at a time
MOST_CUTS = 4000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _heads(size: int, starts: np.ndarray) -> np.ndarray:
    heads = np.zeros(size, bool)
    heads[starts] = True
    return heads


def _names(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each phrase: its symbols with their places in it, and its length."""
    lengths = np.diff(np.append(starts, len(symbols)))
    inside = np.arange(len(symbols), dtype=np.uint64) - np.repeat(starts.astype(np.uint64), lengths)
    return mix64(np.add.reduceat(mix64(symbols + (inside + np.uint64(1)) * _STEP), starts) + lengths.astype(np.uint64))


def parse_level(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parse strings laid end to end (``starts``: where each begins, none empty) into phrases: (names, starts among them)."""
    first = _heads(len(symbols), starts)
    # Runs of one symbol become one symbol, named by symbol and run length.
    change = first.copy()
    change[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(change)
    runs = np.diff(np.append(at, len(symbols)))
    symbols = np.where(runs > 1, mix64(symbols[at] ^ mix64(runs.astype(np.uint64))), symbols[at])
    first = first[at]
    begins = np.flatnonzero(first)
    # Coin tossing: neighbours differ, so do their labels after each round.
    labels = symbols
    for _ in range(4):
        before = np.empty_like(labels)
        before[1:] = labels[:-1]
        before[begins] = ~labels[begins]
        apart = labels ^ before
        lowest = np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
        labels = lowest << np.uint64(1) | (labels >> lowest & np.uint64(1))
    # A label above both neighbours starts a phrase; so does the start of a string.
    peak = np.zeros(len(labels), bool)
    peak[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] >= labels[2:])
    peak[1:] &= ~first[:-1]
    peak[begins[1:] - 1] = False  # the last symbol of a string has no right neighbour
    peak |= first
    cuts = np.flatnonzero(peak)
    return _names(symbols, cuts), np.searchsorted(cuts, begins)


def fingerprint_texts(texts: list[str]) -> list[str]:
    """Fingerprint of each text: up to ``SKETCH`` smallest names of its highest levels, 16 hex digits each, ascending.

    Level ``LEVELS`` gives the names; a text that a lower level already turns into one
    phrase is named by that phrase.  The empty text's fingerprint is empty.
    """
    found = [""] * len(texts)
    for low, high in text_chunks(texts, CHUNK):
        filled = [row for row in range(low, high) if texts[row]]
        if not filled:
            continue
        sizes = np.array([len(texts[row]) for row in filled])
        symbols = np.frombuffer("".join(texts[row] for row in filled).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        starts = np.cumsum(sizes) - sizes
        for _ in range(LEVELS):
            symbols, starts = parse_level(symbols, starts)
        stops = np.append(starts[1:], len(symbols))
        for row, start, stop in zip(filled, starts, stops):
            found[row] = "".join(f"{name:016x}" for name in np.unique(symbols[start:stop])[:SKETCH].tolist())
    return found


def likeness(one: str, other: str) -> float:
    """Jaccard likeness of the name sets behind two fingerprints, from the ``SKETCH`` smallest names of their union.

    Two empty fingerprints are alike (1.0), an empty and another are not (0.0).
    """
    a = {one[i : i + 16] for i in range(0, len(one), 16)}
    b = {other[i : i + 16] for i in range(0, len(other), 16)}
    least = sorted(a | b)[:SKETCH]
    return sum(name in a and name in b for name in least) / len(least) if least else 1.0


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(ids: list, texts: list[str]) -> pd.DataFrame:
    """One row per text but the last, against its follower in the list."""
    changed = [edited(text, following) for text, following in zip(texts, texts[1:])]
    prints, other = fingerprint_texts(texts), fingerprint_texts(changed)
    ids, texts, own, nexts = ids[:-1], texts[:-1], prints[:-1], prints[1:]
    return pd.DataFrame(
        {
            "doc_id": ids, "n_chars": [len(text) for text in texts],
            "edited_sha256": [hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() for text in changed],
            "fingerprint": own, "edited_fingerprint": other,
            "near_edited": [likeness(a, b) for a, b in zip(own, other)], "near_next": [likeness(a, b) for a, b in zip(own, nexts)],
        }
    )


FIELDS = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ROWS = 150  # documents of a bucket


def fingerprint_chain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS) -> DataFrame:
    """Fingerprints of all texts and of their edits, and how near each is to its edit and to the next text.

    Documents follow each other by id (null ids last, rows of equal id by a hash of
    their text); the first follows the last.  Quantiles of the ids cut the order into
    buckets of about ``rows`` documents (null ids: by ranges of the hash), which are
    sorted on their own.  Each bucket also gets a copy of the first text of the next
    one, so texts move once and every document finds its follower in its bucket.
    Null texts are empty; an empty table gives none; a single document follows itself.
    """
    kind = docs.schema[id_col].dataType
    known = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total, missing = known.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    # The quantiles are approximate; any cuts are right ones, for a bucket is a range of the order.
    buckets = min(max(1, (total - missing) // rows), MOST_CUTS)
    cuts = sorted(set(known.approxQuantile("doc_id", [place / buckets for place in range(1, buckets)], 0.25 / buckets))) if buckets > 1 else []
    spread = max(1, min(MOST_CUTS, missing // rows))
    by_hash = F.floor((F.xxhash64("text") / F.lit(2.0**64) + 0.5) * spread)
    place = F.when(F.col("doc_id").isNull(), len(cuts) + 1 + by_hash).otherwise(_above(F.col("doc_id"), cuts))
    keyed = known.select(place.cast("int").alias("bucket"), F.lit(False).alias("guest"), "doc_id", F.xxhash64("text").alias("hash"), "text")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")
    heads = keyed.groupBy("bucket").agg(F.min(order).alias("head"))
    # One row per bucket: whose guest its first document is.
    along = Window.orderBy("bucket")
    last = F.last("bucket").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("bucket", "head", F.coalesce(F.lag("bucket").over(along), last).alias("host"))
    first = keyed.join(F.broadcast(heads.select(F.col("bucket").alias("b"), "head", "host")), (F.col("bucket") == F.col("b")) & (order == F.col("head")))
    guests = first.groupBy("host").agg(F.first("text").alias("text")).select(
        F.col("host").alias("bucket"), F.lit(True).alias("guest"), F.lit(None).cast(kind).alias("doc_id"), F.lit(0).cast("long").alias("hash"), "text"
    )
    ordered = keyed.union(guests).repartitionByRange("bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_last(), "hash")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            ids, texts, guest = batch["doc_id"].tolist(), batch["text"].tolist(), batch["guest"].tolist()
            if held is not None:
                ids, texts, guest = [held[0], *ids], [held[1], *texts], [False, *guest]
            held = None if not guest or guest[-1] else (ids[-1], texts[-1])
            for start, stop in text_chunks(texts, CHUNK):
                stop = min(stop + 1, len(texts))  # the last of a chunk needs its follower
                found = _compared(ids[start:stop], texts[start:stop])
                found = found[[not g for g in guest[start : stop - 1]]]
                if len(found):
                    yield found

    # Ids travel through pandas as text: a column of integers with nulls would turn to floats there.
    found = ordered.select(F.col("doc_id").cast("string"), "text", "guest").mapInPandas(walk, FIELDS)
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def _above(value: Column, cuts: list[float]) -> Column:
    """How many cuts lie at or below the value."""
    if not cuts:
        return F.lit(0)
    # A binary search as a nest of conditions stays small per row, however many cuts there are.
    listed = F.array(*[F.lit(float(cut)) for cut in cuts])
    steps = max(1, len(cuts)).bit_length()
    low, high = F.lit(0), F.lit(len(cuts))
    search = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(low.alias("low"), high.alias("high")),
        lambda at, _: F.when(at["low"] >= at["high"], at).when(
            F.get(listed, F.floor((at["low"] + at["high"]) / 2).cast("int")) <= value,
            F.struct((F.floor((at["low"] + at["high"]) / 2).cast("int") + 1).alias("low"), at["high"].alias("high")),
        ).otherwise(F.struct(at["low"].alias("low"), F.floor((at["low"] + at["high"]) / 2).cast("int").alias("high"))),
    )
    return search["low"]
