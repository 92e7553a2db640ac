"""Alignment of two tokenizers' tokens of the same texts, and how often token ids are linked.

Token A is byte-level BPE of a space and the text, token B a SentencePiece model's, which
adds that space itself.  Both give the same bytes, so the token ends of both are two
sorted lists of byte offsets.  Merge-path partitioning cuts their merging into pieces of
equal work: a binary search on each diagonal tells how many ends of either list lie before
it, whatever the lists look like.  A piece emits the overlaps of its part (the A and B
token that share the bytes up to an end) and whether both end there; running sums over the
pieces stitch what a cut has parted into groups.

How often an id pair is linked in the whole corpus is added up from the distinct pairs of
units of text, joined back to the units, and summed per document there: no pair travels
once per occurrence.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketsense.llm.common import text_chunks
from marketsense.llm.packing import PartCoder, load_coders
from marketsense.session import stage

CHUNK = 500_000  # characters handled at a time
UNIT = 8_000_000  # characters whose distinct pairs travel together
PIECE = 1 << 16  # merge steps of a piece
DOC = "unit long, place int, doc_id string, n_a long, n_b long, n_groups long, groups string"
OF_UNIT = "pairs array<long>, n array<long>, owners binary, indexes binary, times binary"


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [byte for byte in range(256) if byte not in plain]
    return {chr(byte): byte for byte in plain} | {chr(256 + place): byte for place, byte in enumerate(rest)}


class Vocabulary:
    """The bytes of each id of both tokenizers, and the pieces of the groups' notation."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.bytes = a, b
        self.sizes = tuple(np.array([len(token) for token in tokens], np.int64) for tokens in (a, b))
        # A token of A is followed by a comma or closes its side; a token of B by a comma or the group's end.
        self.marked = [f"{i}{mark}" for tokens, marks in ((a, ",|"), (b, ",;")) for mark in marks for i in range(len(tokens))]


@lru_cache(maxsize=2)
def load_vocabularies(byte_level: str, ranks: str | None, pieces: str):
    """(coder of A, SentencePiece processor, vocabulary); kept by the process for its next tasks."""
    import sentencepiece

    coder, order = load_coders(byte_level, ranks)
    signs = byte_level_alphabet()
    a = [b""] * coder.get_vocab_size()
    for token, i in coder.get_vocab().items():
        a[i] = bytes(signs[sign] for sign in token)
    processor = sentencepiece.SentencePieceProcessor(model_file=pieces)
    b = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        b.append(bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace("▁", " ").encode())
    return PartCoder(coder, order), processor, Vocabulary(a, b)


def merge_path(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many elements of ``a`` are among the first d of the merged order (equal ones of ``a`` first), for each diagonal d."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        first = open_.copy()
        first[open_] = a[middle[open_]] <= b[diagonals[open_] - 1 - middle[open_]]
        low, high = np.where(first, middle + 1, low), np.where(open_ & ~first, middle, high)
    return low


def piece_overlaps(a: np.ndarray, b: np.ndarray, a_range: tuple[int, int], b_range: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token of A, token of B, whether both end there) of the overlaps that end in a piece, in text order.

    An end of both tokens is emitted by the piece that has A's; equal ends of B are
    looked up one place beyond the cut at most.
    """
    (a_low, a_high), (b_low, b_high) = a_range, b_range
    mine, other = a[a_low:a_high], b[b_low:b_high]
    at = b_low + np.searchsorted(other, mine)
    together = b[np.minimum(at, len(b) - 1)] == mine
    under = a_low + np.searchsorted(mine, other)
    # Ends of B alone: not those of a token of A, of this piece or the last before it.
    known = (a[np.minimum(under, len(a) - 1)] == other) | ((under > 0) & (a[under - 1] == other))
    alone = np.flatnonzero(~known)
    order = np.argsort(np.concatenate([mine, other[alone]]), kind="stable")
    tokens_a = np.concatenate([np.arange(a_low, a_high), under[alone]])[order]
    tokens_b = np.concatenate([at, b_low + alone])[order]
    return tokens_a, tokens_b, np.concatenate([together, np.zeros(len(alone), bool)])[order]


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The overlaps of all pieces, in text order; ``a`` and ``b`` are token ends with the same last one."""
    total = len(a) + len(b)
    diagonals = np.append(np.arange(0, total, piece), total)
    cuts = merge_path(a, b, diagonals)
    for (cut, diagonal), (next_cut, next_diagonal) in pairwise(zip(cuts.tolist(), diagonals.tolist())):
        yield piece_overlaps(a, b, (cut, next_cut), (diagonal - cut, next_diagonal - next_cut))


def stitched_groups(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The last token of A and of B of every group: a group goes on over the pieces until both end together."""
    lasts = [(tokens_a[together], tokens_b[together]) for tokens_a, tokens_b, together in overlaps(a, b, piece)]
    return tuple(np.concatenate([one[side] for one in lasts]) if lasts else np.zeros(0, np.int64) for side in (0, 1))


def group_codes(ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Places in ``vocabulary.marked`` that spell the groups: A's ids of a group, then B's."""
    size_a, size_b = (len(tokens) for tokens in vocabulary.bytes)
    before = np.concatenate([[0], last_b + 1])[:-1]
    place_a = np.arange(len(ids_a)) + np.repeat(before, np.diff(last_a, prepend=-1))
    place_b = np.arange(len(ids_b)) + np.repeat(last_a + 1, np.diff(last_b, prepend=-1))
    codes = np.empty(len(ids_a) + len(ids_b), np.int32)
    codes[place_a], codes[place_b] = ids_a, 2 * size_a + ids_b
    codes[place_a[last_a]] += size_a
    codes[place_b[last_b]] += size_b
    return codes


def _ends(sizes: np.ndarray, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids end to end, byte offset of each end, tokens before each text and after the last)."""
    ids = np.concatenate([np.zeros(0, np.int64), *texts])
    return ids, np.cumsum(sizes[ids]), np.concatenate([[0], np.cumsum([len(some) for some in texts], dtype=np.int64)])


def align_texts(texts: list[str], coder, processor, vocabulary: Vocabulary, piece: int = PIECE) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """(n_a, n_b, n_groups, groups per text; the linked id pairs, A's above 32 bits; the text of each)."""
    lists_a = [np.asarray(ids, np.int64) for ids in coder.encode([f" {text}" for text in texts])]
    lists_b = [np.array(ids, np.int64) for ids in processor.encode(texts, num_threads=1)]
    of_a, of_b = (tokens.__getitem__ for tokens in vocabulary.bytes)
    for place, text in enumerate(texts):
        whole = b" " + text.encode("utf-8", "surrogatepass")
        if not text or b"".join(map(of_a, lists_a[place].tolist())) != whole or b"".join(map(of_b, lists_b[place].tolist())) != whole:
            lists_a[place] = lists_b[place] = np.zeros(0, np.int64)
    ids_a, ends_a, first_a = _ends(vocabulary.sizes[0], lists_a)
    ids_b, ends_b, first_b = _ends(vocabulary.sizes[1], lists_b)
    last_a, last_b = stitched_groups(ends_a, ends_b, piece)
    codes = group_codes(ids_a, ids_b, last_a, last_b, vocabulary)
    spelled, cuts = vocabulary.marked.__getitem__, (first_a + first_b).tolist()
    owner = np.searchsorted(first_a, last_a, side="right") - 1
    rows = pd.DataFrame(
        {
            "n_a": np.diff(first_a), "n_b": np.diff(first_b), "n_groups": np.bincount(owner, minlength=len(texts)),
            "groups": ["".join(map(spelled, codes[start:stop].tolist()))[:-1] for start, stop in pairwise(cuts)],
        }
    )
    return rows, ids_a[last_a] << 32 | ids_b[last_b], owner


def align_documents(
    docs: DataFrame, byte_level: str, pieces: str, ranks: str | None = None, kept: Callable[[Column], Column] = lambda groups: groups,
    id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) per row of ``docs``.

    ``byte_level`` is a byte-level tokenizer's file (``ranks``: the same vocabulary in the
    order of its merges, which makes coding faster), ``pieces`` a SentencePiece model.
    ``groups`` lists the ids between common token ends, ``a1,a2|b1;a3|b2,b3``; it is several
    times as long as the text, so ``kept`` may shorten it (to a digest, say) before it is
    written.  A link is a token of A and one of B that end at the same byte.  ``n_best``
    counts the links whose id pair is linked as often, corpus-wide, as any pair of its B
    id; ``count_sum`` adds up these corpus-wide counts over the links.

    Null and empty texts, and texts that a tokenizer does not give back byte for byte,
    have no tokens: zeros and an empty ``groups``.  Rows that repeat an id count on their
    own; null ids stay null; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    # Ids travel through pandas as text: a column of integers with nulls would turn to floats there.
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    names = [field.split()[0] for field in f"{DOC}, {OF_UNIT}".split(", ")]

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        tools = load_vocabularies(byte_level, ranks, pieces)
        number, held, places, characters = TaskContext.get().partitionId() << 32, [], 0, 0

        def summary() -> pd.DataFrame:
            """The distinct pairs of the unit with their counts, and how often each document has which."""
            pairs, index, n = np.unique(np.concatenate([pairs for pairs, _ in held]), return_inverse=True, return_counts=True)
            entries, times = np.unique(np.concatenate([owner for _, owner in held]) << 32 | index, return_counts=True)
            owners, places_with = np.unique(entries >> 32, return_counts=True)
            packed = [np.stack([owners, places_with]).astype(np.int32), (entries & 0xFFFFFFFF).astype(np.int32), times.astype(np.int32)]
            return pd.DataFrame([(number, None, None, None, None, None, None, pairs, n, *[part.tobytes() for part in packed])], columns=names)

        for batch in batches:
            texts = [text or "" for text in batch["text"]]
            for low, high in text_chunks(texts, CHUNK):
                found, pairs, owner = align_texts(texts[low:high], *tools)
                spare = dict.fromkeys(names[-5:])
                yield found.assign(unit=number, place=places + np.arange(high - low, dtype=np.int32), doc_id=batch["doc_id"].to_numpy()[low:high], **spare)[names]
                held.append((pairs, owner + places))
                places += high - low
                characters += sum(map(len, texts[low:high]))
                if characters >= unit:
                    yield summary()
                    number, held, places, characters = number + 1, [], 0, 0
        if held:
            yield summary()

    coded = rows.mapInPandas(align, f"{DOC}, {OF_UNIT}")
    done = stage(coded.withColumn("groups", kept(F.col("groups"))), "aligned-tokens")
    units = done.filter(F.col("pairs").isNotNull())
    linked = units.select("unit", F.explode(F.arrays_zip("pairs", "n")).alias("one")).select("unit", F.col("one.pairs").alias("pair"), F.col("one.n").alias("n"))
    # A B id meets at most as many A ids as the vocabulary has.
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF))
    counts = linked.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("best", F.col("count") == F.max("count").over(of_b))
    replies = linked.select(F.col("unit").alias("asker"), "pair").join(counts, "pair")

    def add_up(entries: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        """The sums of a unit's documents; its pairs and their replies are in the same order."""
        replies = replies.sort_values("pair")
        count, best = replies["count"].to_numpy(np.int64), replies["best"].to_numpy(np.int64)
        row = entries.iloc[0]
        owners, sizes = np.frombuffer(row["owners"], np.int32).reshape(2, -1)
        index, times = np.frombuffer(row["indexes"], np.int32), np.frombuffer(row["times"], np.int32).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        sums = [np.add.reduceat(times * value[index], starts) if len(starts) else np.zeros(0, np.int64) for value in (best, count)]
        return pd.DataFrame({"unit": row["unit"], "place": owners, "n_best": sums[0], "count_sum": sums[1]})

    entries = units.select("unit", "owners", "indexes", "times")
    summed = entries.groupBy("unit").cogroup(replies.groupBy("asker")).applyInPandas(add_up, "unit long, place int, n_best long, count_sum long")
    documents = done.filter(F.col("pairs").isNull()).join(summed, ["unit", "place"], "left")
    none = F.lit(0).cast("long")
    return documents.select(
        F.col("doc_id").cast(kind), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups",
    )
