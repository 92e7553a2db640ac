"""Source profiles, coverage, and validation of mention tables."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marketsense.operators.mentions import epoch_seconds
from marketsense.schemas import MENTION_COLUMNS
from marketsense.sinks import scan_mentions_csv
from marketsense.sources.ndjson import parse_lines

MAX_BODY = 1000


def profile_source(lines: DataFrame, source: str = "source_file", column: str = "value") -> DataFrame:
    """Time range and line counts per source file.

    Lines without a usable time are errors; a missing or zero time counts
    neither as processed nor as error; blank lines only in the total.
    """
    rows = parse_lines(lines.select(source, column), column)
    rows = rows.withColumn("_seconds", epoch_seconds(F.col("fields")))
    written = F.length(F.btrim(column)) > 0
    timed = written & (F.col("_seconds") != 0)
    return rows.groupBy(F.col(source).alias("source")).agg(
        F.min(F.when(timed, F.col("_seconds"))).alias("earliest"),
        F.max(F.when(timed, F.col("_seconds"))).alias("latest"),
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(timed).alias("processed_lines"),
        F.count_if(written & F.col("_seconds").isNull()).alias("error_lines"),
    )


def coverage_check(profiles: DataFrame, start: str, end: str) -> DataFrame:
    """Overall range of all sources and whether it covers [start, end]."""
    first, last = (F.unix_timestamp(F.lit(f"{day} 00:00:00")) for day in (start, end))
    overall = profiles.agg(F.min("earliest").alias("earliest"), F.max("latest").alias("latest"))
    status = (
        F.when(F.col("earliest").isNull() | F.col("latest").isNull(), "undetermined")
        .when((F.col("earliest") <= first) & (F.col("latest") >= last), "covered")
        .otherwise("not covered")
    )
    return overall.withColumn("coverage", status)


def _day(text: str) -> bool:
    try:
        return bool(re.fullmatch(r"\d{4}-\d{1,2}-\d{1,2}", text)) and bool(date(*map(int, text.split("-"))))
    except ValueError:
        return False


def validate_mentions(mentions: DataFrame, start: str, end: str, max_body: int = MAX_BODY) -> DataFrame:
    """Checks per ticker as rows (ticker, check_name, value, severity), in one aggregation.

    ``mentions`` holds the file columns as text.  Rows with an unparsable date
    count once and are left out of the later checks.  Only missing columns,
    fractional scores and malformed bounds fail; everything else warns.
    """
    columns = set(mentions.columns) - {"ticker"}
    missing, extra = MENTION_COLUMNS - columns, columns - MENTION_COLUMNS
    bounds_ok = _day(start) and _day(end)
    rows = mentions
    for name in missing:
        rows = rows.withColumn(name, F.lit(None).cast("string"))
    number = F.trim("score").try_cast("double")
    rows = rows.select(
        "ticker",
        "id",
        F.try_to_timestamp("created_date").alias("stamp"),
        F.char_length("body").alias("length"),
        number.alias("number"),
    ).withColumn("dated", F.col("stamp").isNotNull())

    dated = F.col("dated")
    fraction = F.col("number") != F.floor("number")
    measures = {
        "records": F.count(F.lit(1)),
        "dated": F.count_if(dated),
        "invalid_dates": F.count_if(~dated),
        "invalid_scores": F.count_if(dated & F.col("number").isNull()),
        "fractional_scores": F.count_if(dated & fraction),
        "null_body": F.count_if(dated & F.col("length").isNull()),
        "null_id": F.count_if(dated & F.col("id").isNull()),
        "distinct_ids": F.count_distinct(F.when(dated, F.col("id"))),
        "negative_scores": F.count_if(dated & (F.col("number") < 0)),
        "long_bodies": F.count_if(dated & (F.col("length") > max_body)),
        "first_stamp": F.min("stamp"),
        "last_stamp": F.max("stamp"),
    }
    found = rows.groupBy("ticker").agg(*[measure.alias(name) for name, measure in measures.items()])
    late = F.col("first_stamp") > F.lit(start).cast("timestamp") if bounds_ok else F.lit(False)
    early = F.col("last_stamp") < F.lit(end).cast("timestamp") if bounds_ok else F.lit(False)
    duplicates = F.col("dated") - F.col("distinct_ids") - F.when(F.col("null_id") > 0, 1).otherwise(0)
    checks = [
        ("records", F.col("records"), "info"),
        ("invalid_dates", F.col("invalid_dates"), "warn"),
        ("invalid_date_percent", F.coalesce(F.try_divide(F.col("invalid_dates") * 100.0, F.col("records")), F.lit(0.0)), "warn"),
        ("missing_columns", F.lit(len(missing)), "fail"),
        ("extra_columns", F.lit(len(extra)), "warn"),
        ("invalid_scores", F.col("invalid_scores"), "warn"),
        ("fractional_scores", F.col("fractional_scores"), "fail"),
        ("null_created_date", F.lit(0), "warn"),
        ("null_body", F.col("null_body"), "warn"),
        ("null_score", F.col("invalid_scores"), "warn"),
        ("null_id", F.col("null_id"), "warn"),
        ("duplicate_ids", duplicates, "warn"),
        ("bad_bounds", F.lit(int(not bounds_ok)), "fail"),
        ("starts_late", F.coalesce(late, F.lit(False)).cast("int"), "warn"),
        ("ends_early", F.coalesce(early, F.lit(False)).cast("int"), "warn"),
        ("negative_scores", F.col("negative_scores"), "warn"),
        ("long_bodies", F.col("long_bodies"), "warn"),
    ]
    failures = [value.cast("double") for _, value, severity in checks if severity == "fail"]
    checks.append(("failed", F.when(sum(failures[1:], failures[0]) > 0, 1).otherwise(0), "fail"))
    tidy = F.array(
        *[
            F.struct(
                F.lit(name).alias("check_name"),
                value.cast("double").alias("value"),
                F.when(value.cast("double") > 0, severity).otherwise("info").alias("severity"),
            )
            for name, value, severity in checks
        ]
    )
    return found.select("ticker", F.inline(tidy))


def with_missing_files(checks: DataFrame, tickers: list[str]) -> DataFrame:
    """Checks plus a failing ``missing_file`` row, and ``failed``, for every requested ticker without any row."""
    spark = checks.sparkSession
    wanted = spark.createDataFrame([(ticker,) for ticker in tickers], "ticker string")
    absent = wanted.join(checks.select("ticker").distinct(), "ticker", "left_anti")
    names = F.explode(F.array(F.lit("missing_file"), F.lit("failed")))
    return checks.unionByName(absent.select("ticker", names.alias("check_name"), F.lit(1.0).alias("value"), F.lit("fail").alias("severity")))


def validate_folder(spark: SparkSession, folder: str, start: str, end: str, tickers: list[str] | None = None) -> DataFrame:
    """One report over all mention files of a folder; a file's ticker is its name up to the first ``_`` or ``.``.

    Tickers that were asked for and have no file fail.
    """
    rows = scan_mentions_csv(spark, folder, ticker_of_file=True)
    checks = validate_mentions(rows, start, end)
    return with_missing_files(checks, tickers) if tickers else checks


def bad_date_samples(mentions: DataFrame, limit: int = 5) -> DataFrame:
    """First unparsable dates per ticker; tasks keep only ``limit`` rows before the shuffle."""
    bad = mentions.where(F.try_to_timestamp("created_date").isNull()).select("ticker", "id", "created_date")
    first = Window.partitionBy("ticker").orderBy("created_date", "id")
    return bad.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit).drop("_n")
