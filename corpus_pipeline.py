"""From raw documents to packed sequences: language, quality, near-copies, mixing, packing."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marketsense.llm import language, mixing, packing, quality, simhash
from marketsense.session import configure, join_path, release, shared_folder, staged_since

ORACLE_SQL = None  # trained models and hashes have no SQL; tests compare with brute-force versions

TOKENIZER, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_done: list[str] = []  # staged tables of stages that ended


def _stage(function: Stage) -> Stage:
    """A stage that first gives back the tables staged by those before it, whose results are written by then.

    Tables that ``docs`` still reads, because a result was handed on without being written, stay.
    """

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = "\n".join(docs.inputFiles())
        kept = [path for path in _done if path.rsplit("/", 1)[-1] in read]
        release(configure(spark), [path for path in _done if path not in kept])
        mark = len(staged_since())
        found = function(spark, docs, sf_dir)
        _done[:] = kept + [path for path in staged_since(mark) if path]
        return found

    return run_stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model rejects go: no letters, or a probability under the calibrated threshold."""
    return language.keep_identified(docs, language.train(docs))


@_stage
def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3 for quality go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (five-word shingles, about 0.8 alike) stays: the one with the smallest id."""
    return simhash.drop_near_copies(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights: documents outside the budget go, others appear once per epoch."""
    return mixing.repeated(docs, mixing.mix_sources(docs))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: a row per piece of a document, with its token ids."""
    return packing.pack_documents(docs, TOKENIZER, RANKS)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("quality", judge_quality),
    ("near_dedup", drop_near_copies),
    ("mix", mix),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = join_path(shared_folder(spark), "marketsense", f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            release(spark, [before])
        docs, before = spark.read.parquet(path), path
    return docs
