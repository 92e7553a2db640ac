"""Language-model scoring by a probabilistic suffix tree over the bytes of texts.

Symbols are the bytes of lower-cased words, a blank that ends a word, and a line feed
that ends a text.  A state is a suffix of what stands before a symbol in its text,
across word borders (with a line feed for the text's start).  Contexts seen often
enough are tested from short to long: one is retained if its next-symbol distribution
diverges from its parent's by more than chance, together with its own suffixes.
Distributions are smoothed towards the parent's, and a symbol is scored in the state
of the longest retained suffix.

Contexts of up to ``SHORT`` bytes are bounded by the alphabet and known everywhere.  All
longer ones are dealt out by their nearest ``SHORT + 1`` bytes, so a part of the tree
holds whole branches: it adds up the grams of all units of text, grows its branches,
and sends the log probability of each distinct gram back to the unit it came from.
Words (for the base score) travel as 96-bit hashes in packed arrays, a part for each
range of the hash, and what comes back are sums per document.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketsense.llm.common import fold_of, mix64, text_chunks
from marketsense.session import stage

DEPTH = 6  # symbols of the longest context
LEAST_COUNT = 2  # contexts seen less often are no states
SHORT = 2  # contexts of up to so many bytes are states everywhere
DIVERGENCE = 3.0  # nats by which a context must gain on its parent, over all its symbols
PRIOR = 4.0  # weight of the parent's distribution
CHUNK = 1_500_000  # characters handled at a time
UNIT = 8  # chunks whose distinct grams are sent together
PENDING = 1_500_000  # grams a task holds before it adds them up
PART_WORDS = 2_000_000  # words of a hash range
BLANK, END = 32, 10
_TABLES = np.random.default_rng(77).integers(1, 2**63, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


@dataclass
class Words:
    """The words of a chunk of texts."""

    bytes: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    text: np.ndarray  # the text each word belongs to
    first: np.ndarray  # hash of 64 bits
    second: np.ndarray  # and of 32 more
    grams: np.ndarray  # each byte with the DEPTH bytes of its text before it: the byte lowest, the farthest highest
    ends: np.ndarray  # the gram of each text's end


def find_words(texts: list[str | None], hashed: bool = True) -> Words:
    """Lower-case A-Z and split at ASCII blanks; hashes are sums of powers, taken from running sums, or left out."""
    split = [b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()) for text in texts]
    parts = [b"\n" + part + b" " if part else b"\n" for part in split]
    ends = np.cumsum([len(part) for part in parts])
    held = np.frombuffer(b"".join(parts), np.uint8)
    inside = (held != 32) & ((held < 9) | (held > 13))
    step = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    found = []
    for table, base in zip(_TABLES, _BASES) if hashed else ():
        powers = _powers(base, len(held) + 1)
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[held] * powers[1:])])
        # Dividing by the power of the place makes equal words equal: the base is odd, so it has an inverse.
        inverse = _powers(pow(base, -1, 2**64), len(held) + 1)
        found.append(mix64((running[stop] - running[start]) * inverse[start] + (stop - start).astype(np.uint64)))
    first, second = found or [np.empty(0, np.uint64)] * 2
    grams = held.astype(np.uint64)
    for back in range(1, DEPTH + 1):
        grams[back:] |= held[:-back].astype(np.uint64) << np.uint64(8 * back)
    begin = ends - [len(part) for part in parts]
    for place in range(DEPTH):  # nothing stands before a text's start mark
        near = begin[begin + place < ends] + place
        grams[near] &= np.uint64((1 << 8 * (place + 1)) - 1)
    last = (grams[ends - 1] << np.uint64(8) | np.uint64(END)) & np.uint64((1 << 8 * (DEPTH + 1)) - 1)
    return Words(held, start, stop, np.searchsorted(ends, start, side="right"), first, second >> np.uint64(32), grams, last)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, size: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64, kept for the chunk size and grown for longer texts."""
    held = _POWERS.get(base)
    if held is None or len(held) < size:
        held = np.ones(size, np.uint64)
        done = 1
        while done < size:
            more = min(done, size - done)
            held[done : done + more] = held[:more] * np.uint64(pow(base, done, 2**64))
            done += more
        if size <= 8 * CHUNK:
            _POWERS[base] = held
    return held[:size]


def distinct_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first occurrence of each distinct word, number of the distinct word of each word)."""
    order = np.lexsort((words.second, words.first))
    a, b = words.first[order], words.second[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def word_grams(words: Words, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grams, word of each): DEPTH context bytes and the symbol after them, for every symbol of the chosen words and their closing blanks.

    A gram is a 64-bit number with the symbol in its low byte and the nearest context
    byte above; 0 stands before a text's start mark.
    """
    sizes = words.stop[places] - words.start[places] + 1  # letters, closing blank
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
    return words.grams[np.repeat(words.start[places], sizes) + inside], np.repeat(np.arange(len(places)), sizes)


def every_gram(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(the gram of each byte, that of a text's end in the place of its start mark; where each text begins)."""
    begin = np.flatnonzero(words.bytes == END)
    grams = words.grams.copy()
    grams[begin] = words.ends
    return grams, begin


def text_grams(words: Words, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct grams in order, their counts) of a chunk, counted in the texts that are ``learned``.

    Whether a gram counts is its lowest bit while all are sorted: plain sorting takes a fraction of the time of sorting places.
    """
    grams, begin = every_gram(words)
    grams = grams << np.uint64(1) | np.repeat(learned.astype(np.uint64), np.diff(begin, append=len(grams)))
    grams.sort()
    counted, grams = (grams & np.uint64(1)).astype(np.int64), grams >> np.uint64(1)
    new = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[new], np.add.reduceat(counted, new)


def gram_counts(docs: DataFrame, trained, depth: int = DEPTH) -> DataFrame:
    """(gram, n) with contexts of up to ``depth`` bytes over the texts where ``trained`` holds; ``words`` rides along as gram -1."""
    mask = np.uint64((1 << 8 * (depth + 1)) - 1)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, counts, total, pending = [], [], 0, 0
        for batch in batches:
            texts = batch["text"].tolist()
            for low, high in text_chunks(texts, CHUNK):
                words = find_words(texts[low:high], hashed=False)
                total += len(words.start)
                words.grams, words.ends = words.grams & mask, words.ends & mask
                some, n = text_grams(words, np.ones(high - low, bool))
                grams.append(some)
                counts.append(n)
                pending += len(some)
                if pending > 2_000_000:
                    grams, counts = _merged(grams, counts)
                    pending = len(grams[0])
                    if pending > 1_000_000:
                        yield pd.DataFrame({"gram": grams[0].view(np.int64), "n": counts[0]})
                        grams, counts, pending = [], [], 0
        if grams:
            grams, counts = _merged(grams, counts)
            yield pd.DataFrame({"gram": grams[0].view(np.int64), "n": counts[0]})
        yield pd.DataFrame({"gram": [-1], "n": [total]})

    return docs.filter(trained).select("text").mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order and the sum of the counts of each."""
    if not len(grams):
        return grams, counts.astype(np.int64)
    order = np.argsort(grams, kind="stable")  # most come as a few sorted runs, which are merged
    grams, counts = grams[order], counts[order].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[new], np.add.reduceat(counts, new)


def _merged(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    some, n = _summed(np.concatenate(grams), np.concatenate(counts))
    return [some], [n]


def packed(values: np.ndarray) -> bytes:
    """Small numbers in few bytes: the lowest bytes of all values, then the next ones, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], size * width, "zstd", asbytes=True), np.uint8).reshape(width, size)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def tree_levels(grams: np.ndarray, counts: np.ndarray, sizes: range) -> pd.DataFrame:
    """(size, context, symbol, n) of the suffixes of grams; a context of k symbols must have its farthest one."""
    parts = []
    for size in sizes:
        whole = (grams >> np.uint64(8 * size)) & np.uint64(255) != 0 if size else np.ones(len(grams), bool)
        pair, n = _summed(grams[whole] & np.uint64((1 << 8 * (size + 1)) - 1), counts[whole])
        parts.append(pd.DataFrame({"size": size, "context": pair >> np.uint64(8), "symbol": (pair & np.uint64(255)).astype(np.int64), "n": n}))
    return pd.concat(parts, ignore_index=True)


class SuffixTree:
    """States by length: sorted contexts with their back-off weights, and sorted (context, symbol) with log10 probabilities."""

    def __init__(self, table: pd.DataFrame):
        """``table``: size, context (its bytes as a number, nearest lowest), symbol, n - all of whole branches, and the short levels."""
        root = np.bincount(table.symbol[table["size"] == 0], table.n[table["size"] == 0], 256) if len(table) else np.zeros(256)
        self.root = (root + 0.01) / (root.sum() + 2.56)
        self.contexts, self.backoff, self.pairs, self.logs = [], [], [], []
        levels, kept = [], []
        for size in range(1, DEPTH + 1):
            part = table[table["size"] == size]
            pair = part.context.to_numpy(np.uint64) << np.uint64(8) | part.symbol.to_numpy(np.uint64)
            order = np.argsort(pair)
            pair, n = pair[order], part.n.to_numpy(float)[order]
            context, first = np.unique(pair >> np.uint64(8), return_index=True)
            sums = np.add.reduceat(n, first) if len(first) else np.zeros(0)
            owner = np.repeat(np.arange(len(context)), np.diff(np.append(first, len(pair))))
            # A suffix is seen as often as the context at least, so branches stay whole.
            often = sums >= LEAST_COUNT
            if size > SHORT and not often.all():
                pair, n, owner = pair[often[owner]], n[often[owner]], (np.cumsum(often) - 1)[owner[often[owner]]]
                context, sums = context[often], sums[often]
            levels.append((context, pair, n, sums, owner))
        # Top down: probabilities smoothed towards the parent's, and the divergence of each context from its parent.
        logs: list[np.ndarray] = []
        for size, (context, pair, n, sums, owner) in enumerate(levels, 1):
            before = self._chain(pair, size - 1, levels, logs)
            p = (n + PRIOR * before) / (sums[owner] + PRIOR)
            gain = np.bincount(owner, n * np.log(p / before), len(context)) if len(context) else np.zeros(0)
            logs.append(p)
            kept.append((gain > DIVERGENCE) | (size <= SHORT))
        # Bottom up: a retained context keeps its suffixes.
        for size in range(DEPTH, 1, -1):
            mask = np.uint64((1 << 8 * (size - 1)) - 1)
            needed = np.unique(levels[size - 1][0][kept[size - 1]] & mask)
            kept[size - 2] |= np.isin(levels[size - 2][0], needed)
        for (context, pair, n, sums, owner), p, keep in zip(levels, logs, kept):
            self.contexts.append(context[keep])
            self.backoff.append(np.log10(PRIOR / (sums[keep] + PRIOR)))
            self.pairs.append(pair[keep[owner]] if len(pair) else pair)
            self.logs.append(np.log10(p[keep[owner]]) if len(pair) else p)

    def _chain(self, pair: np.ndarray, size: int, levels: list, logs: list) -> np.ndarray:
        """Probability of each symbol in the suffix of ``size`` of its context, before anything is pruned."""
        p = np.ones(len(pair))
        open_ = np.arange(len(pair))
        for length in range(size, 0, -1):
            context, known, _, sums, _ = levels[length - 1]
            cut = pair[open_] & np.uint64((1 << 8 * (length + 1)) - 1)
            at, hit = _found(known, cut)
            p[open_[hit]] *= logs[length - 1][at[hit]]
            place, there = _found(context, cut >> np.uint64(8))
            miss = ~hit & there
            p[open_[miss]] *= PRIOR / (sums[place[miss]] + PRIOR)
            open_ = open_[~hit]
        p[open_] *= self.root[(pair[open_] & np.uint64(255)).astype(np.int64)]
        return p

    def score(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the symbol of each gram in the longest retained suffix of its context."""
        result = np.zeros(len(grams))
        open_ = np.arange(len(grams))
        for length in range(DEPTH, 0, -1):
            cut = grams[open_] & np.uint64((1 << 8 * (length + 1)) - 1)
            whole = cut >> np.uint64(8 * length) != 0  # else the word is not that long
            at, hit = _found(self.pairs[length - 1], cut)
            hit &= whole
            result[open_[hit]] += self.logs[length - 1][at[hit]]
            place, there = _found(self.contexts[length - 1], cut >> np.uint64(8))
            miss = ~hit & there & whole
            result[open_[miss]] += self.backoff[length - 1][place[miss]]
            open_ = open_[~hit]
        result[open_] += np.log10(self.root[(grams[open_] & np.uint64(255)).astype(np.int64)])
        return result


def _found(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each wanted value in a sorted array."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def grow(counts: DataFrame) -> SuffixTree:
    """The whole tree in one place, for gram counts that fit there; ``score_texts`` grows it in parts."""
    table = counts.filter(F.col("gram") >= 0).toPandas()
    return SuffixTree(tree_levels(table.gram.to_numpy(np.int64).view(np.uint64), table.n.to_numpy(np.int64), range(DEPTH + 1)))


def branch_of(grams: np.ndarray, parts: int) -> np.ndarray:
    """The part of the tree that holds the longer states of each gram, by its nearest SHORT + 1 context bytes."""
    near = (grams >> np.uint64(8)) & np.uint64((1 << 8 * (SHORT + 1)) - 1)
    return (mix64(near) % np.uint64(parts)).astype(np.int64)


def score_texts(docs: DataFrame, folds: int = 10, held: int = 0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    Null texts are empty: they hold the end token only.  Learning takes the rows outside
    the held-out fold; without any, all counts are 0, the base score is 0 and the tree
    is its uniform root.  Rows that repeat an id are scored on their own.
    """
    kind = docs.schema["doc_id"].dataType
    kept = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (fold_of(F.col("doc_id"), folds) == held).alias("held_out"))
    # Contexts of up to SHORT bytes: their number is bounded by the alphabet, not by the corpus.
    counts = stage(gram_counts(kept, ~F.col("held_out"), SHORT), "suffix-grams")
    known = counts.toPandas()
    is_gram = known.gram >= 0
    grams, n = known.gram[is_gram].to_numpy(np.int64).view(np.uint64), known.n[is_gram].to_numpy(np.int64)
    ends = int(n[grams & np.uint64(255) == END].sum())
    total = int(known.n[~is_gram].sum()) + ends
    short = docs.sparkSession.sparkContext.broadcast(tree_levels(grams, n, range(SHORT + 1)))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_WORDS))

    def texts_of(head) -> list[str]:
        return json.loads(pa.decompress(head.d, int(head.e), "zstd", asbytes=True))

    def unit_rows(task: int, unit: int, chunk: int, grams: list, counts: list) -> Iterator[pd.DataFrame]:
        """Distinct grams of a unit, from ``chunk`` on, with their training counts, by branch."""
        ((some,), (n,)) = _merged(grams, counts)
        part = branch_of(some, parts)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        rows = []
        for p in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[p] : cuts[p + 1]]
            rows.append((parts + int(p), task, unit, chunk, 0, packed(np.diff(some[at], prepend=np.uint64(0))), packed(n[at]), b"", b"", b""))
        yield pd.DataFrame(rows, columns=names)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The documents in chunks; ids travel as text, which tells nulls from numbers."""
        task, chunk = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch["text"].tolist()
            for low, high in text_chunks(texts, CHUNK):
                ids = json.dumps(batch["doc_id"].iloc[low:high].tolist()).encode()
                held_out, text = batch["held_out"].iloc[low:high].to_numpy(bool), json.dumps(texts[low:high]).encode()
                head = (-1, task, chunk // UNIT, chunk, high - low, ids, held_out.tobytes(), b"", pa.compress(text, "zstd", asbytes=True), str(len(text)).encode())
                yield pd.DataFrame([head], columns=names)
                chunk += 1

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The words of each chunk, and the grams of each unit as far as its chunks come one after the other."""
        grams, counts, now = [], [], None
        for batch in batches:
            for head in batch.itertuples(index=False):
                if now and now[:2] != (head.task, head.unit):
                    yield from unit_rows(*now, grams, counts)
                    grams, counts, now = [], [], None
                now = now or (head.task, head.unit, head.chunk)
                words, size = find_words(texts_of(head)), head.size
                held_out = np.frombuffer(head.b, bool)
                some, n = text_grams(words, ~held_out)
                grams.append(some)
                counts.append(n)
                if sum(map(len, grams[1:])) > PENDING:  # one running sum, and little that waits for it
                    grams, counts = _merged(grams, counts)
                # One entry per distinct word of a document; words grouped by hash range.
                places, number = distinct_words(words)
                entry, n = np.unique(number * size + words.text, return_counts=True)
                owner, text = entry // size, entry % size
                learned = np.bincount(owner, n * ~held_out[text], len(places)).astype(np.int32)
                many = np.bincount(owner, minlength=len(places)).astype(np.int32)
                first, second = words.first[places], words.second[places].astype(np.uint32)
                part = (first >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
                # Distinct words come sorted by hash, so each range is a slice.
                cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
                entries, rows = np.searchsorted(owner, cuts), []
                for p in np.flatnonzero(np.diff(cuts)):
                    w, x = slice(cuts[p], cuts[p + 1]), slice(entries[p], entries[p + 1])
                    hashes, found = packed(np.diff(first[w], prepend=np.uint64(0))), packed(np.concatenate([text[x], n[x]]).astype(np.int32))
                    rows.append((int(p), head.task, head.unit, head.chunk, size, hashes, second[w].tobytes(), packed(np.concatenate([learned[w], many[w]])), b"", found))
                yield pd.DataFrame(rows, columns=names)
        if now:
            yield from unit_rows(*now, grams, counts)

    schema = "part int, task int, unit int, chunk int, size int, a binary, b binary, c binary, d binary, e binary"
    names = [field.split()[0] for field in schema.split(", ")]
    # The texts are written once; only what is made of them is dealt out by word and by branch.
    chunks = stage(kept.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(gather, schema), "suffix-texts")
    sent = chunks.mapInPandas(spread, schema)

    def score_branch(group: pd.DataFrame) -> pd.DataFrame:
        """The branches of a part, grown from the grams of all units, and the log probabilities of the grams of each unit."""
        held = [np.cumsum(unpacked(a, np.uint64), dtype=np.uint64) for a in group["a"]]
        some, n = _summed(np.concatenate(held), np.concatenate([unpacked(b, np.int64) for b in group["b"]]))
        learned = n > 0
        tree = SuffixTree(pd.concat([short.value, tree_levels(some[learned], n[learned], range(SHORT + 1, DEPTH + 1))], ignore_index=True))
        logs = tree.score(some).astype(np.float32)
        return group.assign(a=[packed(logs[np.searchsorted(some, grams)]) for grams in held], b=b"", distinct=0)

    def add_up(group: pd.DataFrame) -> pd.DataFrame:
        """Counts of all words of a hash range, then each chunk's sums per document."""
        if group["part"].iloc[0] >= parts:
            return score_branch(group)
        first = np.concatenate([np.cumsum(unpacked(a, np.uint64), dtype=np.uint64) for a in group["a"]])
        second = np.concatenate([np.frombuffer(b, np.uint32) for b in group["b"]])
        learned, many_texts = np.concatenate([unpacked(c, np.int32).reshape(2, -1) for c in group["c"]], axis=1)
        order = np.lexsort((second, first))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        count = np.bincount(number, learned)
        log, seen, at, found = np.log10(count + 0.1), count > 0, 0, []
        for row in group.itertuples(index=False):
            text, n = unpacked(row.e, np.int32).reshape(2, -1)
            here = slice(at, at := at + len(row.b) // 4)
            word = np.repeat(number[here], many_texts[here])
            texts, where = np.unique(text, return_inverse=True)
            found.append((row.task, row.unit, row.chunk, packed(np.diff(texts, prepend=np.int32(0))), np.bincount(where, n * log[word]).tobytes(), packed(np.bincount(where, n * seen[word]).astype(np.int32))))
        frame = pd.DataFrame(found, columns=["task", "unit", "chunk", "a", "b", "c"]).assign(part=group["part"].iloc[0], size=0, d=b"", e=b"", distinct=0)
        frame.loc[0, "distinct"] = int(seen.sum())
        return frame[[*group.columns, "distinct"]]

    summed = stage(sent.groupBy("part").applyInPandas(add_up, f"{schema}, distinct long"), "suffix-sums")
    distinct = (summed.agg(F.sum("distinct")).first()[0] or 0) + (1 if ends else 0)
    unit, end_log = np.log10(total + 0.1 * (distinct + 1)), np.log10(ends + 0.1)

    def score_chunks(heads: pd.DataFrame, sums: dict, replies: list[np.ndarray]) -> list[pd.DataFrame]:
        """The documents of a series of chunks, by the sums of their words and the branches' replies to their grams."""
        every, chunks = [], []
        for head in heads.itertuples(index=False):
            words = find_words(texts_of(head), hashed=False)
            grams, begin = every_gram(words)
            order = np.argsort(grams)
            grams = grams[order]
            new = np.concatenate([[True], grams[1:] != grams[:-1]])
            number = np.empty(len(grams), np.int32)
            number[order] = np.cumsum(new) - 1
            every.append(grams[new])
            chunks.append((number, begin, np.bincount(words.text, minlength=len(begin))))
        some = np.concatenate(every)
        some.sort()
        some = some[np.concatenate([[True], some[1:] != some[:-1]])]
        price = np.empty(len(some))
        price[np.argsort(branch_of(some, parts), kind="stable")] = np.concatenate(replies)
        found = []
        for head, grams, (number, begin, many) in zip(heads.itertuples(index=False), every, chunks):
            size = int(head.size)
            score = np.add.reduceat(price[np.searchsorted(some, grams)][number], begin)
            logs, known = np.full(size, end_log), np.full(size, int(ends > 0), np.int64)
            rows = sums.get(head.chunk)
            for row in rows.sort_values("part").itertuples(index=False) if rows is not None else ():
                texts = np.cumsum(unpacked(row.a, np.int32))
                logs[texts] += np.frombuffer(row.b, np.float64)
                known[texts] += unpacked(row.c, np.int32)
            tokens = many + 1
            found.append(
                pd.DataFrame(
                    {
                        "doc_id": json.loads(bytes(head.a)), "held_out": np.frombuffer(head.b, bool), "n_tokens": tokens, "n_known": known,
                        "train_tokens": total, "base_score": logs - tokens * unit, "score": score,
                    }
                )
            )
        return found

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        """One unit: its documents, the sums of their words from all hash ranges, and their symbols by the replies of all branches."""
        heads = group[group["part"] < 0].sort_values("chunk")
        sums, branches = group[(group["part"] >= 0) & (group["part"] < parts)], group[group["part"] >= parts].sort_values("part")
        sums, found = dict(list(sums.groupby("chunk"))), []
        first = sorted(set(branches["chunk"]))  # where each series of chunks begins whose grams were sent together
        for start, stop in zip(first, [*first[1:], np.inf]):
            replies = [unpacked(a, np.float32) for a in branches["a"][branches["chunk"] == start]]
            found += score_chunks(heads[(heads["chunk"] >= start) & (heads["chunk"] < stop)], sums, replies)
        return pd.concat(found, ignore_index=True)

    done = summed.unionByName(chunks.withColumn("distinct", F.lit(0).cast("long"))).groupBy("task", "unit").applyInPandas(finish, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))
