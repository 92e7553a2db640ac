import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketsense.llm import language, mixing

from test_packing import check_packed

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """What each stage returns on sf0.001, with one more column and a few awkward rows."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("Score", F.lit(1.5)).withColumn("near_row", F.lit("x"))
    words = docs.filter("lang = 'en'").orderBy("doc_id").first().text
    odd = [(10**6, None, "en", "s", 0, 1.5, "x"), (10**6 + 1, "", None, None, None, 1.5, "x"), (10**6 + 2, words, "en", "src1", 5, 1.5, "x"), (10**6 + 2, words, "en", "src1", 5, 1.5, "x")]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    found = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        found.append((name, docs))
    return dict(found)


def test_stages_keep_columns_and_clean_documents(spark, results):
    names = ["documents", "language", "quality", "near_dedup", "mix"]
    for name in names:
        assert results[name].columns == results["documents"].columns
    counts = {name: results[name].count() for name in names}
    assert counts["documents"] - 6 <= counts["language"] <= counts["documents"] - 2  # null and empty texts go
    known = spark.read.parquet(f"{SF}/labels.parquet").join(results["language"].select("doc_id"), "doc_id")
    kept = known.join(results["quality"].select("doc_id"), "doc_id", "left_semi")
    good, left = known.filter("quality = 1").count(), kept.filter("quality = 1").count()
    assert left >= 0.95 * good and kept.filter("quality = 0").count() <= 0.3 * known.filter("quality = 0").count()


def test_dedup_equals_brute_force(results):
    before = [(r.doc_id, r.text) for r in results["quality"].select("doc_id", "text").collect()]
    after = [r.doc_id for r in results["near_dedup"].select("doc_id").collect()]
    sets = [(i, shingles(t)) for i, t in before]
    pairs = [(i, j) for n, (i, a) in enumerate(sets) for j, b in sets[:n] if len(a & b) >= 0.85 * len(a | b)]
    # Of clearly near copies one stays; a document without any relative above 0.6 always stays.
    assert not [p for p in pairs if p[0] in after and p[1] in after and p[0] != p[1]]
    near = {i for n, (i, a) in enumerate(sets) for m, (_, b) in enumerate(sets) if n != m and len(a & b) >= 0.6 * len(a | b)}
    assert {i for i, _ in sets} - near <= set(after) and len(after) == len(set(after))


def test_mix_repeats_whole_documents(results):
    taken = mixing.mix_sources(results["near_dedup"]).collect()
    counts = {r.doc_id: r["count"] for r in results["mix"].groupBy("doc_id").count().collect()}
    for r in taken:
        assert abs(counts.get(r.doc_id, 0) * r.size - r.taken) <= r.size / 2
    assert set(counts) <= {r.doc_id for r in taken}


def test_packed_rows_hold_every_document(results):
    check_packed(results["pack"].collect(), [r.text for r in results["mix"].select("text").collect()], 2048)


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_language_stage_agrees_with_predictions(spark, results):
    model = language.train(results["documents"])
    wanted = {r.doc_id for r in language.identify(results["documents"], model).filter("not rejected").collect()}
    assert {r.doc_id for r in results["language"].select("doc_id").collect()} == wanted
    assert np.isfinite(model.threshold)
