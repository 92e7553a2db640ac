import hashlib
import random
import zlib

import pytest

from marketsense.llm import periodic, queries

BLANKS = " \t\n\r\x0b\x0c"


def split(text):
    """Words by a plain scan over the characters."""
    words, held = [], ""
    for sign in (text or "") + " ":
        if sign in BLANKS:
            if held:
                words.append(held)
            held = ""
        else:
            held += sign
    return words


def brute_runs(words, shortest=6, exponent=4):
    """All runs, by trying every period and every start."""
    found = {}
    for period in range(1, len(words) // exponent + 1):
        place = 0
        while place + period < len(words):
            stop = place
            while stop + period < len(words) and words[stop] == words[stop + period]:
                stop += 1
            length = stop - place + period
            if length >= max(shortest, exponent * period):
                found.setdefault((place, length), period)  # periods come in order: the smallest stays
            place = stop + 1
    return sorted((start, length, period) for (start, length), period in found.items())


def brute_rows(docs):
    """The digests of the registered query, in plain Python."""
    for doc_id, text in docs:
        words = split(text)
        h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = sorted(brute_runs(words), key=lambda run: (run[0], run[2]))
        drop = {i for start, length, period in runs for i in range(start + period, start + length)}
        best = min(runs, key=lambda run: (-run[1], run[0], run[2]), default=None)
        listed = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
        kept = " ".join(word for i, word in enumerate(words) if i not in drop)
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        yield (doc_id, len(runs), *shown, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def random_texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        words = []
        while len(words) < rng.randrange(1, 120):
            block = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
            words += block * rng.choice([1, 1, 2, 4, 5, 9]) + block[: rng.randrange(len(block) + 1)]
        yield words


@pytest.mark.parametrize("shortest, exponent", [(6, 4), (2, 3), (9, 3), (20, 5)])
def test_runs_equal_brute_force(shortest, exponent):
    texts = list(random_texts(shortest, 400)) + [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 500, ["a", "b"] * 300 + ["a"] * 7]
    found = periodic.find_runs([[word.encode() for word in words] for words in texts], shortest, exponent)
    for words, runs in zip(texts, found):
        assert sorted(runs) == brute_runs(words, shortest, exponent), words


def test_suffix_order_and_matches():
    rng = random.Random(5)
    for _ in range(50):
        words = [rng.randrange(3) for _ in range(rng.randrange(1, 60))] + [99]
        order, match = periodic.sorted_suffixes(periodic.np.array(words))
        assert sorted(order.tolist()) == list(range(len(words)))
        tails = [words[place:] for place in order]
        assert tails == sorted(tails)
        for one, other, length in zip(tails, tails[1:], match[1:].tolist()):
            assert one[:length] == other[:length] and one[length] != other[length]


def test_exponents_that_neighbours_cannot_decide_are_refused():
    with pytest.raises(ValueError):
        periodic.find_runs([[b"a"]], 6, 2)


def test_query_equals_brute_force(spark, tmp_path):
    docs = [(i, " ".join(words)) for i, words in enumerate(random_texts(3, 150))]
    rng = random.Random(8)
    # Long texts in words of their own, which only the planted blocks repeat; odd blanks; letters outside ASCII.
    docs += [(1000 + i, " \t".join(f"w{rng.randrange(10**6)}é " for _ in range(rng.randrange(1, 3000)))) for i in range(60)]
    docs += [(5000 + i, "  one\ttwo\x0bthree \r\n" * 40) for i in range(5)] + [(None, "tail of the null id " * 9), (None, None), (7, ""), (7, "x x x x x x"), (8, " \n "), (-3, None)]
    path = str(tmp_path / "sf")
    spark.createDataFrame([(*doc, "k", 1) for doc in docs], "doc_id long, text string, starts string, N int").write.parquet(f"{path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, path)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = sorted(map(repr, map(tuple, got.collect())))
    assert rows == sorted(map(repr, brute_rows(docs)))
    assert sum(zlib.crc32(str(doc_id).encode()) % 10 == 0 for doc_id, _ in docs) > 10


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.collapse_runs(empty).collect() == []
    rows = [(1, "na na na na na na na batman"), (1, "na na na na na na na batman"), (None, None), (2, "")]
    docs = spark.createDataFrame([(*row, "x") for row in rows], "doc_id long, text string, collapsed string")
    got = sorted((row.doc_id or 0, [tuple(run) for run in row.runs], row.collapsed) for row in periodic.collapse_runs(docs).collect())
    assert got == [(0, [], ""), (1, [(0, 7, 1)], "na batman"), (1, [(0, 7, 1)], "na batman"), (2, [], "")]


def test_a_very_long_text_is_one_run(spark):
    docs = spark.createDataFrame([(1, "a b c " * 60_000)], "doc_id long, text string")
    row = periodic.collapse_runs(docs).first()
    assert [tuple(run) for run in row.runs] == [(0, 180_000, 3)] and row.collapsed == "a b c"
