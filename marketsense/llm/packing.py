"""Packing documents into token sequences along a space-filling curve.

A document's vector of hashed three-byte grams is projected to ``DIMENSIONS`` coordinates; the
Hilbert key of that point orders the documents, so neighbours on the curve, which
are alike, share sequences.  Documents are dealt out by stretch of the curve, sorted by key,
tokenised in that order, and laid end to end; prefix sums over the stretches give
each document its place in the whole, and every ``length`` tokens make a sequence.
Only the last sequence is not full.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketsense.llm.common import mix64, text_chunks
from marketsense.session import stage

DIMENSIONS = 3
CURVE_BITS = 16  # bits of each coordinate
TIE_BITS = 15
SAMPLE = 20_000  # documents whose keys cut the curve
SLOTS = 4  # stretches of the curve for each partition
BUCKETS = 1 << 12
CHUNK = 500_000  # characters tokenised at a time
KNOWN_PARTS = 150_000  # coded parts a task keeps
SPACED = re.compile(r" (?<=\s )")  # begins with a letter that is fast to search for
LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+")
MARKED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\[-`{-~]+)")


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer points (n x d, each below 2**bits) on the Hilbert curve, as int64 (d * bits <= 62).

    Skilling's transform: undo the excess rotations bit plane by bit plane, Gray-decode,
    and interleave the bits of the coordinates.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    plane = 1 << (bits - 1)
    while plane > 1:
        low = plane - 1
        for axis in range(dims):
            set_ = (x[axis] & plane) != 0
            swap = np.where(set_, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(set_, low, swap)
            if axis:
                x[axis] ^= swap
        plane >>= 1
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    flip = np.zeros_like(x[0])
    plane = 1 << (bits - 1)
    while plane > 1:
        flip ^= np.where((x[-1] & plane) != 0, plane - 1, 0)
        plane >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = key << 1 | (x[axis] >> bit & 1)
    return key


def curve_keys(texts: list[str | None]) -> np.ndarray:
    """Hilbert key of each text's vector of hashed three-byte grams; texts without a gram lie in the middle of the cube."""
    planes = np.random.default_rng(20240501).standard_normal((BUCKETS, DIMENSIONS))
    spots = np.zeros((len(texts), DIMENSIONS))
    for row, text in enumerate(texts):
        held = (text or "").lower().encode("utf-8", "surrogatepass")
        if len(held) > 2:
            # Every place read as a 32-bit number; the shift drops its fourth byte.
            grams = (np.ndarray(len(held) - 2, "<u4", held + b"\0\0", strides=(1,)) << np.uint32(8)) * np.uint32(2654435761)
            # Square roots keep frequent grams from drowning the rest; the sum of the squares is the number of grams.
            spots[row] = np.sqrt(np.bincount(grams >> np.uint32(20), minlength=BUCKETS) / len(grams)) @ planes
    # Coordinates are about normal; their distribution function spreads them over the cube.
    share = 0.5 * (1 + np.tanh(np.sqrt(2 / np.pi) * (spots + 0.044715 * spots**3)))
    return hilbert_keys(np.clip(share * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1), CURVE_BITS)


def curve_order(texts: list[str | None], rows: np.ndarray) -> np.ndarray:
    """Hilbert key and, below it, some bits of a hash of the row: equal keys can be cut apart."""
    return curve_keys(texts) << TIE_BITS | (mix64(rows) >> np.uint64(64 - TIE_BITS)).astype(np.int64)


def curve_cuts(rows: DataFrame, slots: int) -> np.ndarray:
    """Borders that cut the curve into about ``slots`` stretches of equally many documents, by a bounded sample.

    ``rows`` has text and row.  The sample decides how evenly the work is dealt out, and nothing else.
    """
    total = rows.count()
    share = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, total)) * (1 << 30))

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"curve": curve_order(batch["text"].tolist(), batch["row"].to_numpy(np.int64))})

    found = rows.filter(share).select("text", "row").mapInPandas(order, "curve long").limit(2 * SAMPLE).collect()
    keys = np.sort(np.array([row.curve for row in found], np.int64))
    return np.unique(keys[(np.arange(1, slots) * len(keys)) // slots]) if len(keys) else keys


class PartCoder:
    """Token ids of texts; parts of texts that came up before are not coded again.

    A byte-level coder starts a new piece at every space that follows a character
    which is no white space, whatever came before it, and between a letter and
    marks that end a part.  So the parts between such places can be coded alone.  Known
    parts are numbered, and their ids lie in one array; all is emptied when it is
    full, which changes nothing but speed.

    A part of letters only is one piece for any pattern, and its ids follow from the
    order of the merges alone; ``ranks``, the same vocabulary in that order, codes
    such parts several times faster.  All other parts take the coder itself.
    """

    def __init__(self, coder, ranks=None):
        self.coder, self.ranks = coder, ranks
        self.line = coder.token_to_id("Ċ")  # the token of a line feed alone
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.marks: dict[str, int] = {}  # numbers of marks behind a word
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.sizes = array("q"), array("q")

    def _code(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts end to end, and how many each has."""
        found = [one.ids for one in self.coder.encode_batch_fast(parts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64)

    def _code_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for parts of letters, each after a space: coded in one go, a line each, and parted at the line feeds."""
        if not words:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        lined = " " + "\n ".join(words)
        ids = self.ranks.encode_to_numpy(lined, disallowed_special=()) if self.ranks else self._code([lined])[0]
        ends = np.append(np.flatnonzero(ids == self.line), len(ids))
        return ids[ids != self.line], np.diff(ends, prepend=-1) - 1

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Store ids of parts; returns their numbers."""
        first = len(self.starts)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts.frombytes((self.used + np.cumsum(sizes) - sizes).astype(np.int64).tobytes())
        self.sizes.frombytes(sizes.astype(np.int64).tobytes())
        self.used += len(ids)
        return range(first, len(self.starts))

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of numbered parts end to end, and how many each has."""
        starts, sizes = np.frombuffer(self.starts, np.int64)[numbers], np.frombuffer(self.sizes, np.int64)[numbers]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.number) + len(self.marks) > KNOWN_PARTS:
            self.clear()
        parted, loose = [], []
        for text in texts:
            parts = text.split(" ")
            if SPACED.search(text):  # a space after white space does not part
                whole = parts[:1]
                for part in parts[1:]:
                    if whole[-1] and not whole[-1][-1].isspace():
                        whole.append(part)
                    else:
                        whole[-1] = f"{whole[-1]} {part}"
                parts = whole
            loose.append(parts[0])  # the first part has no space before it
            parted.append(parts[1:])
        odd, split = [], {}
        # `difference` asks the known parts for each new one; `- keys()` would walk all known parts.
        new = set().union(*parted).difference(self.number)
        words = list(filter(str.isalpha, new))
        if not LATIN.fullmatch(together := "".join(words)) and together:
            words = list(filter(LATIN.fullmatch, words))
        for part in new.difference(words):
            if found := MARKED.fullmatch(part):
                split[part] = found.groups()
            else:
                odd.append(part)
        words += {word for word, _ in split.values()}.difference(self.number).difference(words)
        self.number.update(zip(words, self._add(*self._code_words(words))))
        self.number.update(zip(odd, self._add(*self._code([f" {part}" for part in odd]))))
        marks = list({mark for _, mark in split.values()}.difference(self.marks))
        self.marks.update(zip(marks, self._add(*self._code(marks))))
        pairs = np.empty((len(split), 2), np.int64)
        for side, known in enumerate((self.number, self.marks)):
            pairs[:, side] = np.fromiter(map(known.__getitem__, [pair[side] for pair in split.values()]), np.int64, len(split))
        ids, sizes = self._gather(pairs.ravel())
        self.number.update(zip(split, self._add(ids, sizes.reshape(-1, 2).sum(axis=1))))
        firsts = self._add(*self._code(loose))
        counts = np.fromiter(map(len, parted), np.int64, len(parted))
        begins = np.cumsum(counts + 1) - counts - 1
        numbers = np.empty(int(counts.sum()) + len(parted), np.int64)
        inner = np.ones(len(numbers), bool)
        inner[begins] = False
        numbers[begins] = np.arange(firsts.start, firsts.stop)
        numbers[inner] = np.fromiter(map(self.number.__getitem__, chain.from_iterable(parted)), np.int64, int(counts.sum()))
        ids, sizes = self._gather(numbers)
        ends = np.cumsum(sizes)[begins + counts].tolist()
        return [ids[start:stop] for start, stop in zip([0, *ends[:-1]], ends)]


@lru_cache(maxsize=2)
def load_coders(tokenizer: str, ranks: str | None):
    """The tokenizer, and the same vocabulary as ranks if there is a file of it; kept by the process for its next tasks."""
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer)
    coder.encode_special_tokens = True  # names of special tokens in a text are text
    if ranks is None:
        return coder, None
    import tiktoken

    with open(ranks, "rb") as lines:
        order = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return coder, tiktoken.Encoding("ranks", pat_str=r" ?\p{L}+|\s", mergeable_ranks=order, special_tokens={})


def pack_documents(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens.

    ``tokenizer`` is a byte-level tokenizer's file, ``ranks`` the same vocabulary in the
    order of its merges, which makes coding faster.

    Returns (doc_id, start, length, ids, doc_tokens, sequence_id, offset) per piece;
    ``ids`` are little-endian 32-bit.  Each document's ids end with ``end_id``; a null
    or empty text is that id alone.  Documents with equal keys are ordered by a hash of
    their row, so copies, however many, are spread over partitions and lie side by side.  Rows
    that repeat an id are packed as documents of their own.  An empty table gives none.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    # Ids travel through pandas as text: a column of integers with nulls would turn to floats there.
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = spark.sparkContext.broadcast(curve_cuts(rows, SLOTS * wanted))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            order = curve_order(batch["text"].tolist(), batch["row"].to_numpy(np.int64))
            yield batch.assign(slot=np.searchsorted(cuts.value, order, side="right"), curve=order)

    # Slots are stretches of the curve, several to a partition: no second run over the keys to find out ranges.
    keyed = rows.mapInPandas(place, "doc_id string, text string, row long, slot int, curve long")
    ordered = keyed.repartition(wanted, "slot").sortWithinPartitions("slot", "curve", "doc_id", "row")

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        parts, before = PartCoder(*load_coders(tokenizer, ranks)), {}
        for batch in batches:
            texts = [text or "" for text in batch["text"]]
            for start, stop in text_chunks(texts, CHUNK):
                coded = [np.append(ids, np.uint32(end_id)).astype("<u4") for ids in parts.encode(texts[start:stop])]
                sizes, slots = np.array([len(ids) for ids in coded], np.int64), batch["slot"].to_numpy()[start:stop]
                firsts = np.cumsum(sizes) - sizes
                for slot in np.unique(slots):  # a slot goes on where it stood
                    low, high = np.searchsorted(slots, [slot, slot + 1])
                    done = before.pop(slot, 0)
                    before = {slot: done + int(sizes[low:high].sum())}
                    firsts[low:high] += done - firsts[low]
                yield pd.DataFrame(
                    {"part": slots, "first": firsts, "doc_id": batch["doc_id"].to_numpy()[start:stop], "doc_tokens": sizes, "ids": [ids.tobytes() for ids in coded]}
                )

    coded = stage(ordered.mapInPandas(tokenise, "part int, first long, doc_id string, doc_tokens long, ids binary"), "pack-tokens")
    # One row per slot; a count of slots, not of documents, bounds this table.
    parts = coded.groupBy("part").agg(F.sum("doc_tokens").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = coded.join(F.broadcast(parts.select("part", before.alias("before"))), "part").withColumn("base", F.col("before") + F.col("first"))
    last = F.floor((F.col("base") + F.col("doc_tokens") - 1) / length)
    cut = laid.withColumn("sequence_id", F.explode(F.sequence(F.floor(F.col("base") / length), last)))
    start = F.greatest(F.col("sequence_id") * length - F.col("base"), F.lit(0))
    stop = F.least((F.col("sequence_id") + 1) * length - F.col("base"), F.col("doc_tokens"))
    cut = cut.select("*", start.alias("start"), (stop - start).alias("length"))
    ids = F.substring(F.col("ids"), (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int"))
    return cut.select(F.col("doc_id").cast(kind), "start", "length", ids.alias("ids"), "doc_tokens", "sequence_id", (F.col("base") + F.col("start") - F.col("sequence_id") * length).alias("offset"))
