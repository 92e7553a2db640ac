import hashlib

import numpy as np
import pytest

from marketsense.llm import fingerprints as fp


def chained(rows):
    rows = sorted(rows, key=lambda r: r[0])
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        own, other, following = (fp.fingerprint_texts([t])[0] for t in (text, changed, after))
        yield i, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, other, fp.likeness(own, other), fp.likeness(own, following)


@pytest.mark.parametrize("rows", [5, 1000])
def test_chain_equals_brute_force(spark, rows):
    rng = np.random.default_rng(4)
    syllables = ["an", "the", "or ", "ti", "on ", "é", "ll", ", ", "😀"]
    texts = [(i * 7 - 100, "".join(rng.choice(syllables, rng.integers(0, 300)))) for i in range(60)] + [(10**9, ""), (10**9 + 1, "x"), (10**15, "y " * 40000)]
    docs = spark.createDataFrame([(i, t, 0, "f") for i, t in texts], "doc_id long, text string, bucket int, Fingerprint string")
    assert sorted(map(tuple, fp.fingerprint_chain(docs, rows=rows).collect())) == sorted(chained(texts))


def test_edge_cases(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert fp.fingerprint_chain(make([])).collect() == []
    one = fp.fingerprint_chain(make([(3, None)])).collect()[0]
    assert (one.n_chars, one.fingerprint, one.near_edited, one.near_next) == (0, "", 1.0, 1.0)
    rows = [(1, "abc def " * 20), (1, "abc def " * 20), (None, "tail " * 50), (None, None), (2, "other text")]
    got = fp.fingerprint_chain(make(rows), rows=1).collect()
    assert len(got) == 5 and sum(r.doc_id is None for r in got) == 2
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1 and max(r.near_next for r in got if r.doc_id == 1) == 1.0


def test_equal_parts_share_names_wherever_they_lie():
    rng = np.random.default_rng(6)
    core = "".join(rng.choice(list("abcdefgh "), 3000))
    sets = []
    for before in ("", "x", "some other beginning " * 3):
        found = fp.fingerprint_texts([before + core])[0]
        sets.append(found)
    assert fp.likeness(sets[0], sets[1]) > 0.9 and fp.likeness(sets[0], sets[2]) > 0.85
    other = fp.fingerprint_texts(["".join(rng.choice(list("abcdefgh "), 3000))])[0]
    assert fp.likeness(sets[0], other) < 0.05
    # Position in a batch has no say.
    assert fp.fingerprint_texts([core, "aaa", core + "z"])[0] == sets[0]
