import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marketsense.llm import packing

PATH, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def check_packed(pieces, texts, length):
    coder = Tokenizer.from_file(PATH)
    coder.encode_special_tokens = True
    want = sorted([*coder.encode(text or "", add_special_tokens=False).ids, 1] for text in texts)
    by_place = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    docs, fill = [], {}
    for p in by_place:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length and p.offset == fill.get(p.sequence_id, 0)
        fill[p.sequence_id] = p.offset + p.length
        if p.start == 0:
            docs.append([])
        assert len(docs[-1]) == p.start
        docs[-1] += ids
        assert p.start + p.length < p.doc_tokens or len(docs[-1]) == p.doc_tokens
    assert sorted(docs) == want
    assert all(size == length for seq, size in fill.items() if seq != max(fill)) and set(fill) == set(range(len(fill)))


def test_pieces_cover_every_id_once(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["alpha", "beta,", "gamma.", "été", "42", "\n"], rng.integers(0, 80))) for _ in range(150)]
    texts += [None, "", " ", "same text"] + ["same text"] * 30 + ["long " * 5000, "<|endoftext|> x"]
    docs = spark.createDataFrame([(None if i % 50 == 7 else i // 2, t, "z", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, part int")
    pieces = packing.pack_documents(docs, PATH, RANKS, length=64).collect()
    check_packed(pieces, texts, 64)
    assert packing.pack_documents(docs.limit(0), PATH).collect() == []


@pytest.mark.parametrize("ranks", [None, RANKS])
def test_parts_code_like_whole_texts(ranks):
    coder, order = packing.load_coders(PATH, ranks)
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("ab1' \n\té!s  ,. \x1c"), rng.integers(0, 30))) for _ in range(3000)] + ["", "a." * 200]
    parts = packing.PartCoder(coder, order)
    got = [ids.tolist() for at in range(0, len(texts), 100) for ids in parts.encode(texts[at : at + 100])]
    assert got == [found.ids for found in coder.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("ranks", [None, RANKS])
def test_real_texts_code_alike(spark, ranks):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    coder, order = packing.load_coders(PATH, ranks)
    parts = packing.PartCoder(coder, order)
    got = [ids.tolist() for at in range(0, len(texts), 100) for ids in parts.encode(texts[at : at + 100])]
    assert got == [found.ids for found in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_hilbert_neighbours_are_one_step_apart():
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_keys(points, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_sequences_follow_the_curve(spark):
    rng = np.random.default_rng(12)
    texts = [" ".join(rng.choice(["alpha", "beta,", "gamma.", "été", "42"], rng.integers(1, 60))) for _ in range(400)] + ["the same text again"] * 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    pieces = packing.pack_documents(docs, PATH, RANKS, length=128).collect()
    firsts = sorted((p for p in pieces if p.start == 0), key=lambda p: (p.sequence_id, p.offset))
    keys = packing.curve_keys(texts)
    along = [keys[p.doc_id] for p in firsts]
    assert len(along) == len(texts) and along == sorted(along)


def test_copies_are_cut_apart(spark):
    rows = spark.createDataFrame([(i, "one text" if i % 3 else f"text {i}") for i in range(3000)], "row long, text string")
    cuts = packing.curve_cuts(rows, 30)
    order = packing.curve_order([r.text for r in rows.collect()], np.arange(3000))
    sizes = np.bincount(np.searchsorted(cuts, order, side="right"))
    assert len(cuts) == 29 and sizes.max() < 3 * 3000 / 30


class Known(dict):
    """Known parts that may be asked one by one, not walked as a whole for each chunk."""

    def keys(self):
        raise AssertionError("all known parts were walked")


def test_known_parts_are_not_walked():
    coder = Tokenizer.from_file(PATH)
    coder.encode_special_tokens = True
    parts = packing.PartCoder(*packing.load_coders(PATH, RANKS))
    for texts in (["alpha beta, 42", "été  x"], ["beta, gamma. алфа алфа, 4\u00a0 2", "tab\t word\n line alpha,", "日本 alpha straße"]):
        assert [ids.tolist() for ids in parts.encode(texts)] == [coder.encode(text, add_special_tokens=False).ids for text in texts]
        parts.number, parts.marks = Known(parts.number), Known(parts.marks)
