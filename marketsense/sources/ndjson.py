"""Compressed JSON-lines dumps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketsense.functions.text import json_object
from marketsense.session import join_path, shared_folder
from marketsense.sources.zstframes import FRAME_BYTES, SPLIT_BYTES, scan_zst, write_zst


def scan_ndjson(spark: SparkSession, path: str, pattern: str = "*.zst", spread: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines of all matching files as ``value`` with the ``source_file`` they come from.

    zst files, long match windows included, are read by a task per ``split_bytes`` of
    compressed data as far as they have frames; files of other kinds are read as Spark
    reads them (gzip: a task a file).  ``spread`` distributes the lines of files that
    cannot be split over that many partitions for the parsing work.  Every line counts,
    the last one included.
    """
    if pattern.endswith(".zst"):
        lines = scan_zst(spark, path, pattern, split_bytes)
    else:
        lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path)
        lines = lines.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("source_file"), "value")
    return lines.repartition(spread) if spread else lines


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Add ``fields``: the top-level members as a map of strings, null unless the line is one JSON object.

    A map keeps "key missing" and "key is null" apart.
    """
    return lines.withColumn("fields", json_object(F.col(column)))


def rewrite_dump(lines: DataFrame, name: str, frame_bytes: int = FRAME_BYTES) -> str:
    """Write lines as zst files into the shared folder and return the folder."""
    folder = join_path(shared_folder(lines.sparkSession), f"{name}-{uuid.uuid4().hex}")
    write_zst(lines, folder, frame_bytes)
    return folder
