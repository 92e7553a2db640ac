"""Periodic runs of words: stretches that repeat a block of words several times over.

Method: the maximal pairs of a text (two equal stretches that differ in the word before
and in the word after) are read off its tree of LCP intervals, bottom up.  A pair whose
distance is at most the ``exponent - 1``-th part of its length is a run, already as long
as it can be, so nothing has to be extended.

Suffixes are sorted by prefix doubling; the ranks of all levels give the LCP values.  Every
interval holds its suffixes in text order, each with the class of the word on its left.
Two suffixes of a run's pair are neighbours in that order (a third one between them would
give the run a shorter period), so when two children meet, each suffix of the smaller one
looks at its two neighbours in the larger one, and those of another class make a pair.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketsense.llm.common import mix64, text_chunks

SHORTEST = 6  # words of the shortest run
EXPONENT = 4  # times its period that a run is long at least
CHUNK = 500_000  # characters handled at a time
RUN_SCHEMA = "doc_id string, starts array<long>, lengths array<long>, periods array<long>, collapsed string"


def least_match(shortest: int, exponent: int) -> int:
    """The least length of a maximal pair that is a run of some period."""
    return min(max((exponent - 1) * period, shortest - period) for period in range(1, shortest + 1))


def numbered_words(texts: Sequence[Sequence[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(words of all texts as numbers, a separator after each text; first place of each text).

    Words of different texts and separators never have equal numbers, so no match crosses texts.
    """
    numbers: list[int] = []
    starts, used = [], 0
    for words in texts:
        starts.append(len(numbers))
        known: dict[bytes, int] = {}
        numbers.extend([known.setdefault(word, used + len(known)) for word in words])
        numbers.append(used + len(known))
        used += len(known) + 1
    return np.array(numbers, np.int64), np.array(starts, np.int64)


def may_repeat(numbers: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """For each text whether ``least`` consecutive words come up twice, by a hash: a text without has no run."""
    count = len(numbers) - least + 1
    if count < 2:
        return np.zeros(len(starts), bool)
    mixed = mix64(numbers.astype(np.uint64) + np.uint64(1))
    window = np.zeros(count, np.uint64)
    for place in range(least):
        window = window * np.uint64(0x9E3779B97F4A7C15) + mixed[place : place + count]
    order = np.argsort(window)
    twice = order[1:][window[order[1:]] == window[order[:-1]]]
    found = np.zeros(len(starts), bool)
    found[np.searchsorted(starts, twice, side="right") - 1] = True
    return found


def sorted_suffixes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the suffixes in a sorted order, LCP of each with the one before; 0 for the first).

    Prefix doubling: a suffix's rank is the first place of its group, and only groups
    of more than one are sorted again.  The last number must be unique.
    """
    size = len(numbers)
    order = np.argsort(numbers, kind="stable")
    keys = numbers[order]
    ranks, length = [], 1
    rank, open_ = np.empty(size, np.int64), np.arange(size)
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    while True:
        # ``open_`` are the places of the order whose groups were split last; ``first`` tells where a group begins.
        rank[order[open_]] = open_[np.maximum.accumulate(np.where(first, np.arange(len(open_)), 0))]
        ranks.append((length, rank.astype(np.int32) if size < 2**31 else rank.copy()))
        alone = first & np.concatenate([first[1:], [True]])
        open_ = open_[~alone]
        if not len(open_):
            break
        places = order[open_]
        group, after = rank[places], rank[places + length]
        again = np.lexsort((after, group))
        order[open_] = places[again]
        group, after = group[again], after[again]
        first = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        length *= 2
    left, right, match = order[:-1].copy(), order[1:].copy(), np.zeros(size - 1, np.int64)
    for length, rank in reversed(ranks):
        equal = rank[left + match] == rank[right + match]
        match[equal] += length
    return order, np.concatenate([[0], match])


def runs_of(numbers: np.ndarray, shortest: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run, from the maximal pairs of the LCP-interval tree."""
    order, match = sorted_suffixes(numbers)
    least = least_match(shortest, exponent)
    before = [-1, *numbers[:-1].tolist()]
    found: dict[tuple[int, int], int] = {}

    def met(one: int, other: int, length: int) -> None:
        period = other - one
        if before[one] != before[other] and length + period >= shortest:
            run = (one, length + period)
            found[run] = min(period, found.get(run, period))

    def joined(one: list[int], other: list[int], length: int) -> list[int]:
        """Both children's suffixes in text order; pairs of them that are near enough are runs."""
        small, large = (one, other) if len(one) < len(other) else (other, one)
        reach = length // (exponent - 1)
        for place in small:
            at = bisect_left(large, place)
            if at < len(large) and large[at] - place <= reach:
                met(place, large[at], length)
            if at and place - large[at - 1] <= reach:
                met(large[at - 1], place, length)
        if 8 * len(small) < len(large):
            for place in small:
                insort(large, place)
        else:
            large += small
            large.sort()  # two sorted stretches: merged in linear time
        return large

    # Only intervals of ``least`` words or more can hold pairs; the rest of the order parts them.
    deep = np.flatnonzero(match >= least)
    if not len(deep):
        return []
    breaks = np.flatnonzero(np.diff(deep) > 1) + 1
    for stretch in np.split(deep, breaks):
        places = order[stretch[0] - 1 : stretch[-1] + 1].tolist()
        open_: list[tuple[int, list[int]]] = []
        current = [places[0]]
        for place, length in zip(places[1:], match[stretch].tolist()):
            while open_ and open_[-1][0] >= length:
                depth, held = open_.pop()
                current = joined(held, current, depth)
            open_.append((length, current))
            current = [place]
        while open_:
            depth, held = open_.pop()
            current = joined(held, current, depth)
    return [(start, length, period) for (start, length), period in found.items()]


def find_runs(texts: Sequence[Sequence[bytes]], shortest: int = SHORTEST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, smallest period) of each text, a sequence of words, by start, then period."""
    if exponent < 3 or shortest < 2:
        raise ValueError("pairs of neighbours find all runs only for exponents of 3 and more, and runs have two words at least")
    result: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    numbers, starts = numbered_words(texts)
    chosen = np.flatnonzero(may_repeat(numbers, starts, least_match(shortest, exponent)))
    if len(chosen):
        numbers, starts = numbered_words([texts[text] for text in chosen])
        for start, length, period in runs_of(numbers, shortest, exponent):
            text = int(np.searchsorted(starts, start, side="right")) - 1
            result[chosen[text]].append((start - int(starts[text]), length, period))
    for runs in result:
        runs.sort(key=lambda run: (run[0], run[2]))
    return result


def collapsed_words(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> Sequence[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    kept = np.cumsum(steps[:-1]) == 0
    return [words[place] for place in np.flatnonzero(kept)]


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, exponent: int = EXPONENT) -> DataFrame:
    """(doc_id, runs, collapsed) per row: all runs of a whole text, and its words without their repetitions.

    ``runs`` is array<struct<start, length, period>> by start, then period, in words
    (``[^\\x20\\x09-\\x0D]+``) from 0; ``collapsed`` has the kept words joined by one space.  A
    run is at least ``shortest`` words and ``exponent`` times its smallest period long, and
    no neighbouring word extends it.  Null and empty texts have no run and an empty
    ``collapsed``; rows that repeat an id are rows of their own; null ids stay null; other
    columns are not read.  Nothing is shuffled; a task holds a batch of texts, and the
    longest text takes about 200 bytes a word while its suffixes are sorted.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    # Ids travel through pandas as text: a column of integers with nulls would turn to floats there.
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))

    def collapse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = batch["text"].tolist(), batch["doc_id"].to_numpy()
            for low, high in text_chunks(texts, CHUNK):
                split = [(text or "").encode("utf-8", "surrogatepass").split() for text in texts[low:high]]
                runs = find_runs(split, shortest, exponent)
                yield pd.DataFrame(
                    {
                        "doc_id": ids[low:high],
                        "starts": [[run[0] for run in some] for some in runs],
                        "lengths": [[run[1] for run in some] for some in runs],
                        "periods": [[run[2] for run in some] for some in runs],
                        "collapsed": [b" ".join(collapsed_words(words, some)).decode("utf-8", "surrogatepass") for words, some in zip(split, runs)],
                    }
                )

    found = rows.mapInPandas(collapse, RUN_SCHEMA)
    runs = F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length"), F.col("periods").alias("period"))
    return found.select(F.col("doc_id").cast(kind), runs.alias("runs"), "collapsed")
