"""Writers and the matching readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketsense.schemas import MENTIONS_FILE
from marketsense.session import stage
from marketsense.sources.files import file_report, listed
from marketsense.sources.quoted import SPLIT_BYTES, all_files, scan_quoted


def write_mentions(mentions: DataFrame, path: str) -> None:
    """Quoted CSV in time order; nothing is written for an empty table.

    The sort is a range shuffle: files are ordered among themselves and inside.  It
    and the check for rows read a staged copy, so the mentions are computed once.
    """
    columns = [c for c in ("created_date", "author", "body", "score", "id") if c in mentions.columns]
    staged = stage(mentions.select(*dict.fromkeys([*columns, "created_date", "id"])), "mentions")
    if staged.isEmpty():
        return
    ordered = staged.orderBy("created_date", "id").select(*columns)
    writer = ordered.write.mode("overwrite").option("header", True).option("quoteAll", True)
    writer.option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)


def scan_mentions_csv(spark: SparkSession, path: str | list[str], ticker_of_file: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Mentions from quoted CSV, everything as text; bodies may contain line breaks, and a large file is read by many tasks.

    ``ticker_of_file`` adds ``ticker``, the file's name up to the first ``_`` or ``.``.
    Paths that do not exist are an error; ``load_mentions`` reports them instead.
    """
    paths = [path] if isinstance(path, str) else path
    absent = [one for one in paths if listed(one) is None]
    if absent:
        raise FileNotFoundError(", ".join(absent))
    rows = scan_quoted(spark, all_files(paths), MENTIONS_FILE, split_bytes)
    if ticker_of_file:
        rows = rows.withColumn("ticker", F.regexp_extract("source_path", r"([^/_.]+)[^/]*$", 1))
    return rows.drop("source_path")


def load_mentions(spark: SparkSession, paths: list[str], ticker_of_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """(mentions of all readable files, report of every path and file): missing and broken ones are left out and reported."""
    report = stage(file_report(spark, paths, "csv"), "report")
    good = [row.file for row in report.where("status = 'read'").select("file").collect()]  # names that the driver listed itself
    return scan_mentions_csv(spark, good, ticker_of_file), report


def write_stage(df: DataFrame, path: str, by: str = "ticker") -> None:
    """Parquet partitioned by ticker; rewrites only the tickers present in ``df``.

    Rows are rebalanced by ticker: small tickers share a task and a busy one is
    split over as many tasks as its size asks for.
    """
    writer = df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(by).parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_tickers(universe: DataFrame, path: str) -> None:
    """CSV with the single column ``Symbol``."""
    universe.select(F.col("symbol").alias("Symbol")).write.mode("overwrite").option("header", True).csv(path)


def write_current_mentions(mentions: DataFrame, path: str) -> None:
    """CSV of filtered live mentions (without a row index)."""
    writer = mentions.write.mode("overwrite").option("header", True).option("quoteAll", True)
    writer.option("escape", '"').csv(path)
