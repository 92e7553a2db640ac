"""SimHash near-duplicates: signatures of word shingles, linked by a self-join of binary tries.

The signatures are the leaves of a binary trie on their bits.  The join walks pairs of
nodes together, adds up the bits in which their prefixes differ, and gives a pair up
as soon as they exceed the budget.  The upper part of the trie, down to nodes of at
most ``LEAF`` signatures, is a small table that Spark joins with itself level by
level; each surviving pair of such nodes is one bounded piece of work, in which numpy
walks the two subtries.  A piece returns a spanning forest of its links, never all
pairs of a group; components join the forests.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketsense.llm.common import mix64, row_bits, rows_in, spare_name
from marketsense.llm.components import components
from marketsense.session import release, stage, staged_since

SEED = 42
LEAF = 8192
STEP = 2
WALK = 1 << 18  # node pairs walked at a time
HASHES = 1 << 16  # shingles counted at a time
MAP = 8  # words of a shingle set's bit map
NODE = ["table", "depth", "prefix", "block"]
PIECE = 2048  # keys in a row of a leaf: Spark's rows and buffers stay far smaller than leaves
LOAD = ["piece", "keys", "ids", "words"]
PAIR = ["table", "v_depth", "v_prefix", "v_block", "other", "u_depth", "u_prefix", "u_block", "differing"]


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the ``width``-word shingles of a text, repeats included.

    A-Z are lower-cased; words are split at ASCII blanks.  Fewer words than ``width``
    make one shingle of all; no words make none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*[words[i:] for i in range(width)])) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(gram, SEED) for gram in grams), np.uint64)


def majority_bits(hashes: np.ndarray, planes: int = 1) -> list[int]:
    """Signature words of 64 bits: a bit is 1 where over half of the hashes have it.  Without hashes: 0.

    Word 0 is on the hashes themselves, the others on hashes mixed anew.
    """
    words = []
    for plane in range(planes):
        counts = np.zeros(64, np.int64)
        for start in range(0, len(hashes), HASHES):
            part = hashes[start : start + HASHES]
            if plane:
                part = mix64(part + np.uint64(plane * 0x9E3779B97F4A7C15 % 2**64))
            counts += np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        words.append(int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little"))
    return words


def signatures(docs: DataFrame, width: int = 3, planes: int = 1, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, row, signature): ``planes`` big-endian words of 64 bits as one binary value per row of ``docs``.

    Null texts are empty; row is null unless ``row_col`` names a column of row numbers.
    """

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            signed = [b"".join(word.to_bytes(8, "big") for word in majority_bits(shingle_hashes(text, width), planes)) for text in batch["text"]]
            yield batch[["doc_id", "row"]].assign(signature=signed)

    row = F.col(row_col) if row_col else F.lit(None)
    # Ids travel through pandas as text: a column of integers with nulls would turn to floats there.
    chosen = docs.select(F.col(id_col).cast("string").alias("doc_id"), row.cast("string").alias("row"), F.col(text_col).alias("text"))
    signed = chosen.mapInPandas(sign, "doc_id string, row string, signature binary")
    return signed.select(F.col("doc_id").cast(docs.schema[id_col].dataType), F.col("row").cast("long"), "signature")


class _Forest:
    """Union-find over places, with array updates."""

    def __init__(self, size: int):
        self.up = np.arange(size)

    def roots(self) -> np.ndarray:
        while True:
            higher = self.up[self.up]
            if np.array_equal(higher, self.up):
                return self.up
            self.up = higher

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Merge the components of each pair (a[i], b[i])."""
        while len(a):
            up = self.roots()
            a, b = up[a], up[b]
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def walk_pairs(left: np.ndarray, right: np.ndarray, same: bool, depth: int, bits: int, differing: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in two sorted key arrays (uint64, the low ``bits`` bits count) that differ in at most ``budget`` bits.

    Both arrays are subtries whose top ``depth`` bits are walked already, with
    ``differing`` bits between them.  Depth first over batches of node pairs, so
    memory does not grow with the number of pairs.  With ``same`` both are one
    subtrie, and each pair of different places comes once.
    """
    one = np.array([0]), np.array([len(left)]), np.array([0]), np.array([len(right)]), np.array([differing], np.int8), np.array([same])
    stack = [(depth, one)]
    while stack:
        depth, (al, ah, bl, bh, diff, own) = stack.pop()
        small = (ah - al) * (bh - bl) <= 16
        if depth >= bits:
            small[:] = True
        if small.any():
            yield from _compare(left, right, al[small], ah[small], bl[small], bh[small], own[small], budget, bits)
            rest = ~small
            al, ah, bl, bh, diff, own = al[rest], ah[rest], bl[rest], bh[rest], diff[rest], own[rest]
        if not len(al):
            continue
        am, bm = _middle(left, al, ah, bits, depth), _middle(right, bl, bh, bits, depth)
        kids = [(al, am, bl, bm, diff, own), (am, ah, bm, bh, diff, own), (al, am, bm, bh, diff + 1, np.zeros_like(own))]
        kids.append(tuple(x[~own] for x in (am, ah, bl, bm, diff + 1, np.zeros_like(own))))
        # All children of a batch stay together: many small batches would cost far more than their node pairs.
        kid = tuple(np.concatenate(parts) for parts in zip(*kids))
        keep = (kid[0] < kid[1]) & (kid[2] < kid[3]) & (kid[4] <= budget)
        kid = tuple(x[keep] for x in kid)
        for start in range(0, len(kid[0]), WALK):
            stack.append((depth + 1, tuple(x[start : start + WALK] for x in kid)))


def _middle(keys: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """Where, in each range of keys that share the top ``depth`` bits, the next bit turns 1."""
    shift = np.uint64(bits - depth - 1)
    bit = (((keys[low] >> shift) | np.uint64(1)) << shift) & np.uint64((1 << bits) - 1)
    return np.clip(np.searchsorted(keys, bit), low, high)


def _compare(left, right, al, ah, bl, bh, own, budget: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All place pairs of node pairs, in batches, kept if their keys are near enough."""
    sizes = (ah - al) * (bh - bl)
    wide = bh - bl
    ends = np.cumsum(sizes)
    start = 0
    while start < len(al):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + WALK, side="right")))
        size = int(sizes[start]) if stop == start + 1 else 0
        # A single node pair with very many places (equal keys) is taken in slices of its left side.
        rows = range(int(al[start]), int(ah[start]), max(1, WALK // max(1, int(wide[start])))) if size > WALK else [None]
        for row in rows:
            if row is None:
                count, first = sizes[start:stop], np.repeat(np.arange(start, stop), sizes[start:stop])
                inside = np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
                a, b = al[first] + inside // wide[first], bl[first] + inside % wide[first]
                twice = own[first]
            else:
                last = min(int(ah[start]), row + max(1, WALK // int(wide[start])))
                a = np.repeat(np.arange(row, last), int(wide[start]))
                b = np.tile(np.arange(int(bl[start]), int(bh[start])), last - row)
                twice = np.full(len(a), own[start])
            near = np.bitwise_count(left[a] ^ right[b]) <= budget
            near &= ~twice | (a < b)
            if near.any():
                yield a[near], b[near]
        start = stop


def _spanning(left: tuple, right: tuple | None, depth: int, bits: int, differing: int, budget: int, total: int | None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (ids, ids of their roots) of the links between two subtries or within one."""
    keys, ids, words = left
    if right is not None:
        forest_ids, forest_words = np.concatenate([ids, right[1]]), np.concatenate([words, right[2]])
        shift, other = len(keys), right[0]
    else:
        forest_ids, forest_words, shift, other = ids, words, 0, keys
    forest = _Forest(len(forest_ids))
    for a, b in walk_pairs(keys, other, right is None, depth, bits, differing, budget):
        b = b + shift
        if total is not None:
            near = np.bitwise_count(forest_words[a] ^ forest_words[b]).sum(axis=1) <= total
            a, b = a[near], b[near]
        forest.join(a, b)
    up = forest.roots()
    tied = np.flatnonzero(up != np.arange(len(up)))
    return forest_ids[tied], forest_ids[up[tied]]


def _between(left: tuple, right: tuple | None, depth: int, bits: int, differing: int, budget: int, total: int, ratio: float, earlier: Sequence[tuple[int, int]] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All links (smaller id, larger id) between two subtries or within one whose ends are of different groups (the last word).

    The word before the last is a size (big-endian, as all words are); the ``MAP`` words before it are the bit map of a set
    (see ``bit_map``).  A link is left out only if these tell that the sets' similarity is below ``ratio``, or if one of
    the keys of ``earlier`` tables (first byte and end in the words) is within the budget: that table has the link.
    """
    keys, ids, words = left
    other, other_ids, other_words = right if right is not None else left
    sizes, other_sizes = (some[:, -2].byteswap().astype(np.int64) for some in (words, other_words))
    sign, bits_of = slice(None, -2 - MAP), slice(-2 - MAP, -2)
    for a, b in walk_pairs(keys, other, right is None, depth, bits, differing, budget):
        one, two = sizes[a], other_sizes[b]
        open_ = (words[a, -1] != other_words[b, -1]) & (np.minimum(one, two) >= ratio * np.maximum(one, two) - 1e-9)
        a, b = a[open_], b[open_]
        near = np.bitwise_count(words[a, sign] ^ other_words[b, sign]).sum(axis=1) <= total
        a, b = a[near], b[near]
        # A bit that only one set has stands for a member, at least, that the other one lacks: what both have is at most the rest.
        one, two, here, there = sizes[a], other_sizes[b], words[a, bits_of], other_words[b, bits_of]
        both = np.minimum(one - np.bitwise_count(here & ~there).sum(axis=1), two - np.bitwise_count(there & ~here).sum(axis=1))
        near = both >= ratio * (one + two - both) - 1e-9
        a, b = a[near], b[near]
        unlike = np.bitwise_count((words[a] ^ other_words[b]).view(np.uint8))
        for first, end in earlier:
            new = unlike[:, first:end].sum(axis=1) > budget
            a, b, unlike = a[new], b[new], unlike[new]
        one, two = ids[a], other_ids[b]
        if len(one):
            yield np.minimum(one, two), np.maximum(one, two)


def trie_links(keyed: DataFrame, bits: int, budget: int, total: int | None = None, leaf: int = LEAF, apart: float | None = None, places: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """Links (a, b) between ids whose keys of one table differ in at most ``budget`` bits; together they span every component.

    ``keyed``: table int, key long (its low ``bits`` bits), id long, words binary.  With
    ``total``, a link also needs at most ``total`` differing bits in ``words``.  With
    ``apart``, ``words`` end with the bit map and the size of a set and the number of a group, and all links between different
    groups whose sets may have at least that similarity are returned instead of spanning ones;
    with ``places``, where the words hold the key of each table, by the first table that has them.
    """
    mark = len(staged_since())
    pending = stage(keyed, "trie-keys")
    size = pending.groupBy("table").count().agg(F.max("count")).first()[0] or 0
    depth = min(bits, int(size // leaf).bit_length())
    prefix = lambda d: F.shiftrightunsigned("key", bits - d) if d else F.lit(0).cast("long")
    # Nodes: leaves hold at most `leaf` keys; where more share a prefix, the trie goes deeper.
    leaves: list[DataFrame] = []
    while True:
        node = pending.withColumn("depth", F.lit(depth)).withColumn("prefix", prefix(depth))
        if depth >= bits:
            leaves.append(node)
            break
        crowded = stage(node.groupBy("table", "prefix").count().filter(F.col("count") > leaf).select("table", "prefix"), "trie-crowded")
        count = crowded.count()
        if not count:
            leaves.append(node)
            break
        side = F.broadcast(crowded) if count <= 100_000 else crowded  # beyond that size a shuffled join
        leaves.append(node.join(side, ["table", "prefix"], "left_anti"))
        pending = stage(node.join(side, ["table", "prefix"], "left_semi").select(*keyed.columns), "trie-pending")
        depth = min(bits, depth + STEP)
    placed = leaves[0].select("table", "key", "id", "words", "depth", "prefix")
    for more in leaves[1:]:
        placed = placed.unionByName(more.select(*placed.columns))

    # A whole key that more than a leaf's worth of ids share has no bits left to go down; it is cut into blocks.
    crowds = stage(placed.filter(F.col("depth") == bits).groupBy("table", "prefix").count().filter(F.col("count") > leaf), "trie-crowds")
    spread = F.coalesce(F.pmod(F.xxhash64("id"), F.ceil(F.col("count") / leaf)), F.lit(0)).cast("int")
    if not crowds.isEmpty():
        placed = placed.join(crowds, ["table", "prefix"], "left").withColumn("block", F.when(F.col("depth") == bits, spread).otherwise(0))
    else:
        placed = placed.withColumn("block", F.lit(0))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        keys, ids = group["key"].to_numpy(np.int64).view(np.uint64), group["id"].to_numpy(np.int64)
        order, words = np.lexsort((ids, keys)), group["words"].to_numpy()
        pieces = [order[start : start + PIECE] for start in range(0, len(order), PIECE)]
        packed = [[place, keys[some].tobytes(), ids[some].tobytes(), b"".join(words[some])] for place, some in enumerate(pieces)]
        node = group[NODE].iloc[0].tolist()
        return pd.DataFrame([[*node, *piece] for piece in packed], columns=[*NODE, *LOAD])

    packed = stage(
        placed.groupBy(*NODE).applyInPandas(pack, "table int, depth int, prefix long, block int, piece int, keys binary, ids binary, words binary"), "trie-leaves"
    )
    release(keyed.sparkSession, [path for path in staged_since(mark)[:-1] if path])  # the leaves hold all of it now
    nodes = packed.filter("piece = 0").select(*NODE)
    pairs = _node_pairs(nodes.select("table", "depth", "prefix").distinct(), bits, budget)
    for side in "uv":
        pairs = pairs.join(nodes.select("table", *[F.col(n).alias(f"{side}_{n}") for n in NODE[1:]]), ["table", f"{side}_depth", f"{side}_prefix"])
    one_node = (F.col("u_depth") == F.col("v_depth")) & (F.col("u_prefix") == F.col("v_prefix"))
    other = ~one_node | (F.col("u_block") != F.col("v_block"))
    pairs = stage(pairs.filter(~one_node | (F.col("u_block") <= F.col("v_block"))).withColumn("other", other).select(*PAIR), "trie-pairs")
    loaded = packed.select("table", *[F.col(n).alias(f"u_{n}") for n in NODE[1:]], *LOAD)
    # Leaves meet piece by piece.  A right node comes first, as every node is paired with itself, and its left nodes one after the other.
    work = loaded.join(pairs, ["table", "u_depth", "u_prefix", "u_block"]).select(*PAIR, *LOAD)
    work = work.repartition(*PAIR[:4]).sortWithinPartitions(*PAIR, "piece")

    def unpack(pieces: Iterable[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, ids, words = (b"".join(parts) for parts in zip(*[piece[-3:] for piece in pieces]))
        return np.frombuffer(keys, np.uint64), np.frombuffer(ids, np.int64), np.frombuffer(words, np.uint64).reshape(len(keys) // 8, -1)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in batch.itertuples(index=False, name=None))
        for pair, pieces in groupby(rows, lambda row: row[: len(PAIR)]):
            table, v_depth, *_, other, u_depth, _, _, differing = pair
            left = unpack(pieces)
            if not other:
                own = left
            right, depth = own if other else None, min(u_depth, v_depth)
            found = _between(left, right, depth, bits, differing, budget, total, apart, places[:table]) if apart is not None else [_spanning(left, right, depth, bits, differing, budget, total)]
            for a, b in found:
                yield pd.DataFrame({"a": a, "b": b})

    return work.mapInPandas(link, "a long, b long").distinct()


def _cut(prefix: str, low: Column) -> Column:
    """A prefix without its ``low`` last bits."""
    return F.when(low >= 64, F.lit(0)).otherwise(F.call_function("shiftrightunsigned", F.col(prefix), low.cast("int"))).cast("long")


def _node_pairs(leaves: DataFrame, bits: int, budget: int) -> DataFrame:
    """Pairs of leaves whose common prefix differs in at most ``budget`` bits, each once.

    Starts with the pair of roots and goes down ``STEP`` bits a round; a leaf above the
    round's depth stays as it is, and bits count only where both sides have them.
    """
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    root = [F.lit(0).cast(kind).alias(name) for name, kind in (("u_prefix", "long"), ("u_depth", "int"), ("v_prefix", "long"), ("v_depth", "int"), ("differing", "int"))]
    pairs = leaves.select("table").distinct().select("table", *root)
    for depth in range(0, deepest, STEP):
        down = min(deepest, depth + STEP)
        level = F.least(F.col("depth"), F.lit(down))
        nodes = leaves.select("table", _cut("prefix", F.col("depth") - level).alias("prefix"), level.alias("depth")).distinct()
        # The parent of a node at this round: itself if it is a leaf further up.
        up = F.least(F.lit(depth), F.col("depth"))
        step = nodes.select("table", up.alias("up"), _cut("prefix", F.col("depth") - up).alias("parent"), "prefix", "depth")
        u = step.select("table", F.col("up").alias("u_depth"), F.col("parent").alias("u_prefix"), F.col("prefix").alias("u_next"), F.col("depth").alias("u_down"))
        v = step.select("table", F.col("up").alias("v_depth"), F.col("parent").alias("v_prefix"), F.col("prefix").alias("v_next"), F.col("depth").alias("v_down"))
        common = F.least("u_down", "v_down")
        apart = F.bit_count(_cut("u_next", F.col("u_down") - common).bitwiseXOR(_cut("v_next", F.col("v_down") - common)))
        ordered = (F.col("u_next") < F.col("v_next")) | ((F.col("u_next") == F.col("v_next")) & (F.col("u_down") <= F.col("v_down")))
        mirrored = (F.col("u_prefix") == F.col("v_prefix")) & (F.col("u_depth") == F.col("v_depth"))
        joined = pairs.join(u, ["table", "u_depth", "u_prefix"]).join(v, ["table", "v_depth", "v_prefix"])
        pairs = joined.withColumn("differing", apart.cast("int")).filter((F.col("differing") <= budget) & (~mirrored | ordered)).select(
            "table", F.col("u_next").alias("u_prefix"), F.col("u_down").alias("u_depth"), F.col("v_next").alias("v_prefix"), F.col("v_down").alias("v_depth"), "differing"
        )
        if depth // STEP % 4 == 3:
            pairs = stage(pairs, "trie-level")
    return pairs


def simhash_components(docs: DataFrame, width: int = 3, budget: int = 3, leaf: int = LEAF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``.

    The fingerprint is 16 hex digits; documents link at ``budget`` or fewer differing
    bits; component_id is the smallest doc_id reachable through links.  Null and empty
    texts have fingerprint 0, which links like any other.  Copies meet in one
    fingerprint before the join.  Rows that repeat an id are rows of their own; a null
    id gets a component, but never names one unless all its ids are null.
    """
    signed = stage(signatures(docs, width, 1, id_col, text_col).withColumn("fingerprint", F.lower(F.hex("signature"))), "simhash")
    key = F.conv("fingerprint", 16, -10).cast("long")
    classes = stage(signed.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).withColumn("id", key), "simhash-classes")
    keyed = classes.select(F.lit(0).alias("table"), F.col("id").alias("key"), "id", F.lit(b"").alias("words"))
    tree = components(trie_links(keyed, 64, budget, leaf=leaf))
    rooted = classes.join(tree, classes.id == tree.node, "left").select("fingerprint", "least", F.coalesce("root", "id").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fingerprint", "component_id")
    return signed.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def bit_map(hashes: np.ndarray) -> bytes:
    """A map of ``MAP`` words: the bits that the members of a set of hashes fall on."""
    held = np.zeros(64 * MAP, np.uint8)
    held[(mix64(hashes) % np.uint64(64 * MAP)).astype(np.int64)] = 1
    return np.packbits(held).tobytes()


def set_signatures(docs: DataFrame, width: int, planes: int, id_col: str, text_col: str, row_col: str) -> DataFrame:
    """(doc_id, row, signature, digest, map, n): signature, 128-bit digest, bit map and size of the set of shingles of each row."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            signed, digests, maps, sizes = [], [], [], []
            for text in batch["text"]:
                hashes = np.unique(shingle_hashes(text, width))
                signed.append(b"".join(word.to_bytes(8, "big") for word in majority_bits(hashes, planes)))
                digests.append(xxhash.xxh128_digest(hashes.tobytes(), SEED))
                maps.append(bit_map(hashes))
                sizes.append(len(hashes))
            yield batch[["doc_id", "row"]].assign(signature=signed, digest=digests, map=maps, n=sizes)

    chosen = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(row_col).cast("string").alias("row"), F.col(text_col).alias("text"))
    signed = chosen.mapInPandas(sign, "doc_id string, row string, signature binary, digest binary, map binary, n long")
    return signed.select(F.col("doc_id").cast(docs.schema[id_col].dataType), F.col("row").cast("long"), "signature", "digest", "map", "n")


def verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least ``similarity``; ``texts``: id, text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["id"]].assign(shingles=[np.unique(shingle_hashes(text, width)).tobytes() for text in batch["text"]])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for left, right in zip(batch["left"], batch["right"]):
                one, two = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(both >= similarity * (len(one) + len(two) - both) - 1e-9)
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    ids = row_bits(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id")
    sets = stage(rows_in(texts, "id", ids).mapInPandas(cut, "id long, shingles binary"), "near-shingles")
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
    return joined.mapInPandas(compare, "a long, b long")


def near_copies(
    docs: DataFrame, row_col: str, width: int = 5, planes: int = 5, band_bits: int = 24, bands: int = 11, budget: int = 3, similarity: float = 0.8, leaf: int = 16 * LEAF,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, row, keep): of each group of near-copies the row with the smallest id stays; ``row_col`` numbers the rows of ``docs``.

    Near means that the sets of shingles are at least ``similarity`` alike (Jaccard).
    Texts never move: those of candidates are found by bit maps of their row numbers, which should lie close together.
    Candidates come from wide signatures (``planes`` words) of the sets, whose differing
    bits follow from the angle of the sets: trie joins of ``bands`` bands of ``band_bits``
    bits find pairs within ``budget`` bits of a band, the whole signature may differ by
    three sigma more than expected at ``similarity``, and the sizes and bit maps of the sets must allow
    that similarity.  The exact sets decide.  Spanning links of clearly near pairs are decided first; after that, only
    pairs of still different groups are listed, all of them, so a large group of copies
    costs no list of its pairs.  Rows without words are copies of each other.  Null ids
    come last; rows of one id are ordered by row number.
    """
    rows = stage(set_signatures(docs, width, planes, id_col, text_col, row_col), "near-signatures")
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    size = 64 * planes
    mean, sigma = size * share, np.sqrt(size * share * (1 - share))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    # Rows of one class have the same set of shingles.
    classes = stage(rows.groupBy("digest", "signature", "map", "n").agg(F.min(order).alias("least"), F.min("row").alias("id")), "near-classes")
    texts = docs.select(F.col(row_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    digits, every = band_bits // 4, size // 4
    begins = [min(start, every - digits) for start in range(0, every, digits)][:bands]
    places = [] if digits % 2 or any(begin % 2 for begin in begins) else [(begin // 2, (begin + digits) // 2) for begin in begins]
    cut = F.array(*[F.struct(F.lit(t).alias("table"), F.conv(F.substring(F.hex("signature"), 1 + begin, digits), 16, 10).cast("long").alias("key")) for t, begin in enumerate(begins)])

    def keyed(words: Column, of: DataFrame) -> DataFrame:
        return of.select(F.explode(cut).alias("band"), "id", words.alias("words")).select("band.table", "band.key", "id", "words")

    def linked(words: Column, of: DataFrame, name: str, *limits) -> DataFrame:
        """The links of one trie join, written; what the join itself staged is given back."""
        mark = len(staged_since())
        links = trie_links(keyed(words, of), band_bits, *limits)
        own = [path for path in staged_since(mark) if path]
        links = stage(links, name)
        release(docs.sparkSession, own)
        return links

    clear = linked(F.col("signature"), classes, "near-clear", 1, int(mean - sigma), leaf)
    sure = stage(verified(clear, texts, width, similarity), "near-sure")
    tree = components(sure)
    grouped = stage(classes.join(tree, classes.id == tree.node, "left").select("id", "signature", "map", "n", F.coalesce("root", "id").alias("root")), "near-groups")
    word = lambda name: F.unhex(F.lpad(F.hex(name), 16, "0"))
    numbered = F.concat("signature", "map", word("n"), word("root"))
    open_ = linked(numbered, grouped, "near-open", budget, int(mean + 3 * sigma), leaf, similarity, places)
    links = sure.union(verified(open_, texts, width, similarity))
    tree = components(links)
    rooted = classes.join(tree, classes.id == tree.node, "left").select("digest", "signature", "least", F.coalesce("root", "id").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("first"))
    return rooted.join(least, "root").join(rows, ["digest", "signature"]).select("doc_id", "row", (F.col("first.row") == F.col("row")).alias("keep"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-copies; columns as they were.

    A row leaves only if another row of its group stays.  Rows that repeat an id and a
    text are copies of each other, so one of them stays.
    """
    row = spare_name(docs, "near_row")
    held = stage(docs.withColumn(row, F.monotonically_increasing_id()), "near-documents")
    kept = near_copies(held, row, id_col=id_col, text_col=text_col).filter("keep")
    return rows_in(held, row, row_bits(kept, "row")).select(*docs.columns)
