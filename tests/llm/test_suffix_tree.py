import math
import zlib
from collections import Counter

import numpy as np
import pytest

from marketsense.llm import suffix_tree


def brute_base(rows):
    words = {i: (t or "").encode().lower().split() for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in [*ws, None])
    total, distinct = sum(counts.values()), len(counts)
    for i, _ in rows:
        tokens = [*words[i], None]
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens)
        yield i, held[i], len(tokens), sum(counts[t] > 0 for t in tokens), total, base


@pytest.mark.parametrize("chunk", [400, suffix_tree.CHUNK])
def test_counts_and_base_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffix_tree, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    vocabulary = ["the", "The", "of", "été", "Été", "x\x0by", "a b", "long" * 30, "1", "anon"]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 40)))) for i in range(120)] + [(500, None), (501, ""), (502, "solo\nword \t"), (503, "hapax " * 3000)]
    docs = spark.createDataFrame([(i, t, "e", 0) for i, t in rows], "doc_id long, text string, part string, held_out int")
    got = sorted(suffix_tree.score_texts(docs).collect(), key=lambda r: r.doc_id)
    for r, want in zip(got, sorted(brute_base(rows)), strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:5]
        assert r.base_score == pytest.approx(want[5], rel=1e-9)
        assert r.score < 0


def test_tree_is_a_distribution_and_learns(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["banana", "bandana", "cabana"], 60)) for _ in range(50)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    from pyspark.sql import functions as F

    tree = suffix_tree.grow(suffix_tree.gram_counts(docs, F.lit(True)))
    words = suffix_tree.find_words(texts)
    places, _ = suffix_tree.distinct_words(words)
    grams, _ = suffix_tree.word_grams(words, places)
    for gram in grams[:40].tolist():
        every = np.array([gram >> 8 << 8 | symbol for symbol in range(256)], np.uint64)
        assert (10 ** tree.score(every)).sum() == pytest.approx(1)
    assert tree.score(grams).mean() > -0.3


def test_edge_cases(spark):
    schema = "doc_id long, text string"
    assert suffix_tree.score_texts(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b"), (None, None), (3, "a"), (3, "a")]
    got = suffix_tree.score_texts(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 1), (0, 3), (3, 2), (3, 2)]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    none = suffix_tree.score_texts(spark.createDataFrame([(i, "word") for i in held], schema)).collect()
    assert all((r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) and r.score < 0 for r in none)


def test_contexts_cross_word_borders(spark):
    """After "red " comes always "fox", after "big " always "cat": only the word before tells which."""
    texts = ["red fox big cat " * 20] * 30
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    tree = suffix_tree.grow(suffix_tree.gram_counts(docs, F.lit(True)))
    words = suffix_tree.find_words(["big red fox", "red big fox"])
    first = [words.grams[words.start[2]], words.grams[words.start[5]]]  # the f of fox, after red and after big
    likely, unlikely = tree.score(np.array(first, np.uint64))
    assert likely > -0.05 and unlikely < -1.5


def test_rare_contexts_stay_states(spark):
    """A context that diverges is a state however large the share of other texts is."""
    rng = np.random.default_rng(3)
    letters = list("abcdefghij")
    hot = [(i, " ".join("".join(rng.choice(letters, 6)) for _ in range(400))) for i in range(300)]
    rare = [(1000 + i, "zyxwa vyxwb") for i in range(8)]
    docs = spark.createDataFrame(hot + rare, "doc_id long, text string")
    from pyspark.sql import functions as F

    counts = suffix_tree.gram_counts(docs, F.lit(True))
    tree = suffix_tree.grow(counts)
    seen = int.from_bytes(b"zyxw", "big")  # what stands before "yxw" tells a from b
    assert counts.filter("gram >= 0").agg(F.sum("n")).first()[0] * 1e-5 > 8 and seen in tree.contexts[3].tolist()


def test_parts_score_like_the_whole_tree(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(suffix_tree, "CHUNK", 300)
    monkeypatch.setattr(suffix_tree, "UNIT", 3)
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "été", "gamma", "x"], rng.integers(0, 30)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learned = [zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows]
    kept = spark.createDataFrame([row for row, used in zip(rows, learned) if used], "doc_id long, text string")
    tree = suffix_tree.grow(suffix_tree.gram_counts(kept, F.lit(True)))
    got = {r.doc_id: r.score for r in suffix_tree.score_texts(docs).collect()}
    for i, text in rows:
        words = suffix_tree.find_words([text])
        grams = np.append(words.grams[1:], words.ends)
        assert got[i] == pytest.approx(tree.score(grams).sum(), rel=1e-5)


def test_held_out_score_beats_word_counts(spark):
    from marketsense.llm import queries

    held = queries.op7_suffix_tree_scores(spark, "/root/testdata/sf0.1").filter("held_out").toPandas()
    assert held.score.sum() > held.base_score.sum()


@pytest.mark.parametrize("unit", [1, suffix_tree.UNIT])
def test_scores_equal_a_naive_tree(spark, monkeypatch, unit):
    """Contexts, divergence test, smoothing and back-off, against dictionaries in plain Python."""
    from naive_suffix_tree import Naive

    monkeypatch.setattr(suffix_tree, "CHUNK", 2000)
    monkeypatch.setattr(suffix_tree, "UNIT", unit)
    monkeypatch.setattr(suffix_tree, "PENDING", 500)
    rng = np.random.default_rng(7)
    stock = ["banana", "bandana", "Été", "the", "of", "then", "x", "1999", "cabana,", "\t", "zebra" * 3]
    rows = [(i, " ".join(rng.choice(stock, rng.integers(0, 40)))) for i in range(200)] + [(1000, None), (1001, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tree = Naive([text for i, text in rows if zlib.crc32(str(i).encode()) % 10])
    assert 50 < len(tree.kept) < len(tree.counts)
    for r in suffix_tree.score_texts(docs).collect():
        assert r.score == pytest.approx(tree.score(dict(rows)[r.doc_id]), rel=1e-5, abs=1e-5)


@pytest.mark.parametrize("split", [False, True])
def test_texts_are_written_once(spark, monkeypatch, split):
    """What is dealt out by word and branch holds no texts; chunks of a unit may be read by several tasks."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "été", "gamma", "x"], rng.integers(0, 30)))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    whole = {r.doc_id: r for r in suffix_tree.score_texts(docs).collect()}
    tables, stage = {}, suffix_tree.stage

    def staged(df, name):
        if split and name == "suffix-texts":
            df = df.repartitionByRange(5, "task", "chunk").sortWithinPartitions("task", "chunk")
        tables[name] = stage(df, name)
        return tables[name]

    monkeypatch.setattr(suffix_tree, "CHUNK", 300)
    monkeypatch.setattr(suffix_tree, "UNIT", 4)
    monkeypatch.setattr(suffix_tree, "stage", staged)
    got = suffix_tree.score_texts(docs).collect()
    assert tables["suffix-sums"].filter("part < 0").isEmpty()
    assert tables["suffix-texts"].count() > 12
    assert len(got) == len(rows)
    for r in got:
        assert r[:5] == whole[r.doc_id][:5]
        assert (r.base_score, r.score) == (pytest.approx(whole[r.doc_id].base_score, rel=1e-9), pytest.approx(whole[r.doc_id].score, rel=1e-5))
