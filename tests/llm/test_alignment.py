import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from marketsense.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute_tokens(texts):
    """(A ids and bytes, B ids and bytes) of each text by the libraries alone."""
    coder, processor = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    coder.encode_special_tokens = True
    signs = alignment.byte_level_alphabet()
    for text in texts:
        a = coder.encode(" " + text, add_special_tokens=False)
        ids = processor.encode(text)
        pieces = [processor.id_to_piece(i) for i in ids]
        b = [bytes([int(piece[3:-1], 16)]) if processor.is_byte(i) else piece.replace("▁", " ").encode() for i, piece in zip(ids, pieces)]
        yield a.ids, [bytes(signs[sign] for sign in token) for token in a.tokens], ids, b


def brute_rows(docs):
    links, rows = Counter(), []
    for (doc_id, text), (ids_a, bytes_a, ids_b, bytes_b) in zip(docs, brute_tokens([text or "" for _, text in docs])):
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            rows.append((doc_id, 0, 0, [], ""))
            continue
        groups, pairs, i, j, start = [], [], 0, 0, (0, 0)
        end_a, end_b = len(bytes_a[0]), len(bytes_b[0])
        while True:
            if end_a == end_b:
                pairs.append((ids_a[i], ids_b[j]))
                groups.append((ids_a[start[0] : i + 1], ids_b[start[1] : j + 1]))
                start = i + 1, j + 1
                if i + 1 == len(ids_a):
                    break
            step_a, step_b = end_a <= end_b, end_b <= end_a
            if step_a:
                i += 1
                end_a += len(bytes_a[i])
            if step_b:
                j += 1
                end_b += len(bytes_b[j])
        links.update(pairs)
        listed = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        rows.append((doc_id, len(ids_a), len(ids_b), pairs, listed))
    most = Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    for doc_id, n_a, n_b, pairs, listed in rows:
        best = sum(links[pair] == most[pair[1]] for pair in pairs)
        yield (doc_id, n_a, n_b, len(pairs), len(pairs), best, sum(links[pair] for pair in pairs), listed)


def some_texts(seed, count):
    rng = random.Random(seed)
    stock = ["the", "river", "Straße", "naïve", "１２", "12345", "\n\n", "  ", "\t", "<s>", "<|endoftext|>", "</s>", "😀", "日本語", "don't", "-->", "x" * 40, "▁", " ", "é" * 3, "\x00", "ﬁ"]
    for _ in range(count):
        yield "".join(rng.choice(stock) + rng.choice(["", " ", " ", "."]) for _ in range(rng.randrange(1, 60)))


def test_query_equals_brute_force(spark, tmp_path):
    docs = [(i, text) for i, text in enumerate(some_texts(1, 250))]
    docs += [(900, None), (901, ""), (902, " "), (None, "no id"), (None, None), (7, "same id"), (-4, "same id"), (903, "word " * 20000)]
    path = str(tmp_path / "sf")
    spark.createDataFrame([(*doc, 1, "g") for doc in docs], "doc_id long, text string, unit int, groups string").repartition(3).write.parquet(f"{path}/documents.parquet")
    got = queries.op13_aligned_tokens(spark, path)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    expected = [(*row[:-1], hashlib.sha256(row[-1].encode()).hexdigest() if row[-1] else "") for row in brute_rows(docs)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
    assert sum(row[1] == 0 for row in expected) > 3  # some texts do not come back byte for byte


def test_units_do_not_matter(spark):
    docs = [(i, text) for i, text in enumerate(some_texts(2, 120))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = alignment.align_documents(frame, A, B, None, unit=500)
    assert sorted(map(tuple, got.collect())) == sorted(brute_rows(docs))


def test_documents_of_the_test_tables(spark):
    docs = [(row.doc_id, row.text) for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = alignment.align_documents(spark.createDataFrame(docs, "doc_id long, text string"), A, B, RANKS)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_rows(docs)))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_documents(empty, A, B).collect() == []
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.align_documents(none, A, B).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_every_word_of_the_vocabulary_is_coded_as_by_the_tokenizer():
    coder, _, vocabulary = alignment.load_vocabularies(A, RANKS, B)
    plain = Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    words = [token.decode() for token in vocabulary.bytes[0] if token.decode("utf-8", "ignore").encode() == token]
    rng = random.Random(4)
    words += ["".join(rng.choices(words, k=rng.randrange(2, 5))) for _ in range(40_000)]
    texts = [f" {' '.join(words[i : i + 50])}" for i in range(0, len(words), 50)]
    expected = [one.ids for one in plain.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in coder.encode(texts)] == expected


def test_merge_path_pieces_equal_one_merge():
    rng = np.random.default_rng(3)
    for _ in range(200):
        last = int(rng.integers(1, 120))
        a, b = (np.unique(np.append(rng.integers(1, last + 1, rng.integers(0, 60)), last)) for _ in range(2))
        merged = sorted([(end, 0) for end in a.tolist()] + [(end, 1) for end in b.tolist()])
        cuts = alignment.merge_path(a, b, np.arange(len(merged) + 1))
        assert cuts.tolist() == [sum(side == 0 for _, side in merged[:d]) for d in range(len(merged) + 1)]
        # Overlaps by comparing the byte ranges of all tokens.
        ranges = [list(zip([0, *ends[:-1]], ends)) for ends in (a.tolist(), b.tolist())]
        pairs = [(i, j, x[1] == y[1]) for i, x in enumerate(ranges[0]) for j, y in enumerate(ranges[1]) if x[0] < y[1] and y[0] < x[1]]
        for piece in (1, 2, 3, 7, 1000):
            found = [tuple(np.concatenate(some).tolist()) for some in zip(*alignment.overlaps(a, b, piece))]
            assert list(zip(*found)) == pairs
            last_a, last_b = alignment.stitched_groups(a, b, piece)
            common = sorted(set(a.tolist()) & set(b.tolist()))
            assert (a[last_a].tolist(), b[last_b].tolist()) == (common, common)
