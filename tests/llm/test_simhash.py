import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from marketsense.llm import common, simhash
from marketsense.llm.components import components

DOCS = "doc_id long, text string, text_ string, Fingerprint string"


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(prints, budget):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def some_texts(n, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            old = texts[rng.integers(len(texts))].split()
            if old:
                old[rng.integers(len(old))] = words[rng.integers(60)]
            texts.append(" ".join(old))
        else:
            texts.append(" ".join(words[k] for k in rng.integers(60, size=rng.integers(0, 40))))
    return texts


@pytest.mark.parametrize("leaf", [24, simhash.LEAF])
def test_components_equal_brute_force(spark, leaf):
    texts = some_texts(160)
    got = simhash.simhash_components(spark.createDataFrame([(i + 5, t, "x", "y") for i, t in enumerate(texts)], DOCS), leaf=leaf).collect()
    prints = {i + 5: brute_fingerprint(t) for i, t in enumerate(texts)}
    roots = brute_components(prints, 3)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{prints[i]:016x}", roots[i]) for i in prints)
    assert len(set(roots.values())) < len(roots)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "oNE"), (5, "oNE"), (None, "one"), (7, "Ä one " * 30000), (8, "ä one " * 30000)]
    got = simhash.simhash_components(spark.createDataFrame([(i, t, None, None) for i, t in rows], DOCS)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert {by_id[i].component_id for i in (1, 2, 3)} == {1} and by_id[1].fingerprint == "0" * 16
    assert {by_id[i].component_id for i in (4, 5, None)} == {4}
    assert by_id[7].fingerprint != by_id[8].fingerprint  # only A-Z are lower-cased
    empty = spark.createDataFrame([], DOCS)
    assert simhash.simhash_components(empty).collect() == []
    assert simhash.drop_near_copies(empty).collect() == []


def test_walk_finds_each_pair_once():
    rng = np.random.default_rng(3)
    for bits in (64, 12):
        base = rng.integers(0, 1 << min(bits, 63), 40, dtype=np.uint64)
        flips = np.uint64(1) << rng.integers(0, bits, 200).astype(np.uint64)
        keys = np.sort(np.concatenate([base, rng.choice(base, 200) ^ flips]))
        want = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if int(keys[i] ^ keys[j]).bit_count() <= 3}
        got = [p for a, b in simhash.walk_pairs(keys, keys, True, 0, bits, 0, 3) for p in zip(a.tolist(), b.tolist())]
        assert len(got) == len(want) and {tuple(sorted(p)) for p in got} == want
        low, high = keys[keys < 1 << (bits - 1)], keys[keys >= 1 << (bits - 1)]
        cross = [p for a, b in simhash.walk_pairs(low, high, False, 1, bits, 1, 3) for p in zip(a.tolist(), b.tolist())]
        assert len(cross) == sum(1 for i, j in want if i < len(low) <= j)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(1, 60)]
    star = [(100, 100 + i) for i in range(1, 50)]
    got = dict(map(tuple, components(spark.createDataFrame(chain + star, "a long, b long")).collect()))
    assert all(got[i] == 1 for i in range(2, 61)) and all(got[100 + i] == 100 for i in range(1, 50))


@pytest.mark.parametrize("leaf", [16, 16 * simhash.LEAF])
def test_near_copies_keep_one_of_each_group(spark, leaf):
    rng = np.random.default_rng(5)
    rows, groups = [], {}
    for group in range(12):
        words = [f"g{k}" for k in rng.integers(0, 5000, 400)]
        for copy in range(5):
            changed = list(words)
            for place in rng.integers(0, 400, 4 if copy else 0):
                changed[place] = "other"
            rows.append((len(rows), " ".join(changed)))
            groups[len(rows) - 1] = group
    rows += [(i, "same short text") for i in (900, 901, 901)] + [(950, None), (951, "")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, near_row long")
    kept = sorted(r.doc_id for r in simhash.near_copies(docs, "near_row", leaf=leaf).filter("keep").collect())
    assert leaf == 16 or sorted(simhash.drop_near_copies(docs).collect()) == sorted(r for r in docs.collect() if r.doc_id in kept and r.near_row != 62)
    assert kept == [5 * g for g in range(12)] + [900, 950]


def altered(words, share, rng):
    """A copy whose five-word shingle set has about ``share`` of its Jaccard similarity with the words'."""
    changed = list(words)
    for n in range(10**6):
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, changed)]
        alike = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        if alike <= share + 0.01:
            return changed, alike
        changed[rng.integers(len(words))] = f"n{n}"


def test_near_copies_are_decided_by_shingle_sets(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for place in range(160):
        words = [f"g{k}" for k in rng.integers(0, 10**6, 500)]
        copy, alike = altered(words, [0.7, 0.75, 0.8, 0.83][place % 4], rng)
        rows += [(2 * place, " ".join(words)), (2 * place + 1, " ".join(copy))]
        want[2 * place + 1] = alike
    repeated = "one two three four five six seven " * 60  # few shingles make most of the text, the sets are not alike
    rows += [(900, repeated + " ".join(f"p{k}" for k in range(20))), (901, repeated + " ".join(f"q{k}" for k in range(20)))]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, near_row long")
    kept = {r.doc_id for r in simhash.near_copies(docs, "near_row").filter("keep").collect()}
    assert {900, 901} <= kept and all(2 * place in kept for place in range(160))
    assert all(i in kept for i, alike in want.items() if alike < 0.8)
    near = [i for i, alike in want.items() if alike >= 0.8]
    found = sum(i not in kept for i in near) / len(near)
    print("recall", found, len(near))
    assert len(near) > 60 and found >= 0.97


def test_pairs_that_bit_maps_rule_out_are_not_listed(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base, rows = [f"g{k}" for k in range(150)], []
    triples = rng.permutation(list(itertools.combinations(range(14), 3)))
    for copy in range(40):  # any two have a similarity of 0.66 to 0.76: many are candidates by their signatures, none is near
        words = list(base)
        for place in triples[copy]:
            words[5 + 10 * place] = f"c{copy}p{place}"
        rows.append((copy, " ".join(words), copy))
    alike = rows[0][1].split()
    alike[-1] = "other"
    rows.append((40, " ".join(alike), 40))
    listed, verified = [], simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda pairs, *more: listed.append(pairs.count()) or verified(pairs, *more))
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_row long")
    kept = {r.doc_id for r in simhash.near_copies(docs, "near_row").filter("keep").collect()}
    sets = [set(zip(*[text.split()[i:] for i in range(5)])) for _, text, _ in rows]
    near = {(a, b) for a in range(41) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    print(listed, near)
    assert near == {(40, 0)} and kept == set(range(40))
    assert listed[1] < 41 * 40 / 2 * 0.25


def test_bit_maps_rule_out_no_near_pair():
    rng = np.random.default_rng(8)
    for size in (1, 3, 40, 300, 5000):
        one = rng.integers(0, 2**63, size, dtype=np.uint64)
        for changed in {0, size // 10, size // 9}:
            two = np.concatenate([one[changed:], rng.integers(0, 2**63, changed, dtype=np.uint64)])
            ratio = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
            words = [np.frombuffer(bytes(8) + simhash.bit_map(some) + size.to_bytes(8, "big") + root.to_bytes(8, "big"), np.uint64).reshape(1, -1) for some, root in ((one, 1), (two, 2))]
            left, right = [(np.zeros(1, np.uint64), np.array([root]), held) for root, held in enumerate(words)]
            assert [(a.tolist(), b.tolist()) for a, b in simhash._between(left, right, 0, 24, 0, 3, 64, ratio)] == [([0], [1])]


def test_rows_are_found_by_bit_maps_without_moving_texts(spark):
    docs = spark.range(0, 3000, 1, 5).select("id", F.monotonically_increasing_id().alias("row"), F.lit("text").alias("text"))
    chosen = docs.filter("id % 7 = 3 or id in (0, 2999)").select("row")
    found = common.rows_in(docs, "row", common.row_bits(chosen, "row"))
    assert found.columns == docs.columns and sorted(r.id for r in found.collect()) == [i for i in range(3000) if i % 7 == 3 or i in (0, 2999)]
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString() and common.rows_in(docs, "row", common.row_bits(chosen.limit(0), "row")).count() == 0


def test_each_open_pair_comes_from_its_first_table():
    rng = np.random.default_rng(6)
    signs = np.repeat(rng.integers(0, 256, (1, 40), np.uint8), 60, axis=0)
    signs ^= np.packbits(rng.random((60, 320)) < 0.04, axis=1)
    tail = [bytes(8 * simhash.MAP) + (9).to_bytes(8, "big") + (n + 1).to_bytes(8, "big") for n in range(60)]
    words = np.array([np.frombuffer(sign.tobytes() + end, np.uint64) for sign, end in zip(signs, tail)])
    places = [(3 * t, 3 * t + 3) for t in range(11)]
    found = {False: [], True: []}
    for once in found:
        for t, (first, end) in enumerate(places):
            keys = np.array([int.from_bytes(sign[first:end].tobytes(), "big") for sign in signs], np.uint64)
            order = np.argsort(keys, kind="stable")
            side = keys[order], np.arange(60)[order], words[order]
            for a, b in simhash._between(side, None, 0, 24, 0, 3, 64, 0.8, places[:t] if once else ()):
                found[once] += zip(a.tolist(), b.tolist())
    assert set(found[True]) == set(found[False]) and len(found[True]) == len(set(found[True])) < len(found[False]) / 2


def test_leaves_meet_in_small_pieces(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 24, 60)
    keys = np.concatenate([base, rng.choice(base, 240) ^ (1 << rng.integers(0, 24, 240))]).tolist()
    keyed = spark.createDataFrame([(0, key, i, b"") for i, key in enumerate(keys)], "table int, key long, id long, words binary")
    staged = {}
    write = simhash.stage

    def noted(df, name):
        staged[name] = write(df, name)
        return staged[name]

    monkeypatch.setattr(simhash, "stage", noted)
    monkeypatch.setattr(simhash, "PIECE", 7)
    tree = dict(map(tuple, components(simhash.trie_links(keyed, 24, 3, leaf=100)).collect()))
    roots = brute_components(dict(enumerate(keys)), 3)
    assert {i: tree.get(i, i) for i in roots} == roots and len(set(roots.values())) < 100
    leaves = staged["trie-leaves"].select(F.length("keys").alias("n"), "depth", "prefix").collect()
    assert sum(row.n for row in leaves) == 8 * 300 and max(row.n for row in leaves) <= 8 * 7
    assert len({(row.depth, row.prefix) for row in leaves}) > 1


def test_a_batch_of_long_values_is_bounded(spark):
    def sizes(batches):
        for batch in batches:
            yield batch.assign(n=sum(map(len, batch["held"])))[["n"]]

    long_ = spark.range(0, 40, 1, 1).select(F.expr("cast(repeat('x', 500000) as binary)").alias("held"))
    assert max(row.n for row in long_.mapInPandas(sizes, "n long").collect()) < 10_000_000
