"""Price bars: file scan, stage tables, range reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketsense.schemas import PRICE_FILE
from marketsense.session import stage
from marketsense.sources.files import file_report


def scan_ohlcv(spark: SparkSession, path: str | list[str], pattern: str = r"([^/]+)_1d") -> DataFrame:
    """Bars from ``<ticker>_1d.csv`` files with three header lines.

    Header lines are the ones whose first field is not a date, so the order in
    which files and splits are read does not matter.
    """
    raw = spark.read.schema(PRICE_FILE).option("header", False).csv(path)
    numbers = [name for name in raw.columns if name != "date"]
    return raw.select(
        F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).alias("ticker"),
        F.try_to_timestamp("date").cast("date").alias("date"),
        *[F.nanvl(F.col(name).try_cast("double"), F.lit(None)).alias(name) for name in numbers],
    ).where(F.col("date").isNotNull())


def load_range(bars: DataFrame, tickers: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of the tickers with start <= date < end (pushed down to the scan)."""
    if tickers is not None:
        bars = bars.where(F.col("ticker").isin(tickers))
    if start is not None:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.where(F.col("date") < F.lit(end).cast("date"))
    return bars


def range_report(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Available and loaded date range and row count per ticker, in one pass."""
    wanted = (F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(end).cast("date"))
    loaded = F.when(wanted, F.col("date"))
    return bars.groupBy("ticker").agg(
        F.min("date").alias("available_from"),
        F.max("date").alias("available_to"),
        F.min(loaded).alias("loaded_from"),
        F.max(loaded).alias("loaded_to"),
        F.count(loaded).alias("n_rows"),
    )


def load_summary(bars: DataFrame, tickers: list[str], start: str, end: str) -> DataFrame:
    """One row per requested ticker: rows loaded, success, and the overall n/m."""
    loaded = load_range(bars, tickers, start, end).groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"))
    n_loaded = loaded.agg(F.count(F.lit(1))).scalar()
    wanted = requested(bars.sparkSession, tickers).select("ticker")
    return wanted.join(loaded, "ticker", "left").select(
        "ticker",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.col("n_rows").isNotNull().alias("loaded"),
        n_loaded.alias("n_loaded"),
        F.lit(len(tickers)).cast("bigint").alias("n_requested"),
    )


def failed_tickers(bars: DataFrame, tickers: list[str]) -> DataFrame:
    """Requested tickers without a single row."""
    return requested(bars.sparkSession, tickers).select("ticker").join(bars.select("ticker"), "ticker", "left_anti")


def requested(spark: SparkSession, tickers: list[str]) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(tickers)], "ticker string, ticker_ord int")


def load_merged(spark: SparkSession, paths: list[str], fmt: str = "parquet", schema=None) -> tuple[DataFrame, DataFrame]:
    """(union of the stage tables' readable files, report of every path and file).

    Missing paths and files that cannot be read are left out, and the report says which
    and why (path, file, size, status, reason).  A file that breaks although its footer
    is sound fails its task: nothing vanishes without a word.
    """
    report = stage(file_report(spark, paths, fmt), "report")
    good = [row.file for row in report.where("status = 'read'").select("file").collect()]  # names that the driver listed itself
    if not good:
        raise ValueError("none of the paths has a readable file")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(good), report


def stack_tickers(df: DataFrame, tickers: list[str]) -> DataFrame:
    """Keep the listed tickers, tagging each row with its place in the list."""
    place = F.array_position(F.array(*[F.lit(t) for t in tickers]), F.col("ticker")) - 1
    return df.where(F.col("ticker").isin(tickers)).withColumn("ticker_ord", place.cast("int"))
