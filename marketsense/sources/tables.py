"""Stage and text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_texts(spark: SparkSession, path: str, spread_by: str | None = None) -> DataFrame:
    """A table with long texts, ready for per-row work.

    Text work is bound by cores, and a task reads at least one row group.  A table
    of few large row groups can be spread by a key, which moves every text once;
    the caller knows how the table was written, so nothing is guessed from its files.
    """
    df = spark.read.parquet(path)
    return df.repartition(spread_by) if spread_by else df
