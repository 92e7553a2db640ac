"""Daily rollup of live mentions as a stream over landed JSON-lines files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from marketsense.functions.lexicon import Lexicon
from marketsense.operators import daily, mentions


def read_lines(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)


def live_mentions(lines: DataFrame, names: dict[str, str], start: str, end: str) -> DataFrame:
    """The batch extraction and word counts of all tickers (ticker -> company name), applied to a stream (or a batch) of lines."""
    found = mentions.extract_mentions(lines, list(names), start, end).withColumnRenamed("ticker", "_ticker")
    counted = mentions.named_tickers(found, names)
    return counted.where(F.col("ticker") == F.col("_ticker")).drop("_ticker")


def rollup(live: DataFrame, lexicon: Lexicon | None = None, watermark: str = "2 days") -> DataFrame:
    """Per ticker and day: mean sentiment, total score, word hits.

    An id seen again within the watermark counts once.  State is bounded by the
    watermark: ids and day totals older than it are dropped, and a day is
    emitted when the watermark has passed its end.
    """
    scored = daily.word_hits(daily.score_mentions(live, lexicon)).drop("body")
    if live.isStreaming:
        scored = scored.withWatermark("created_date", watermark).dropDuplicatesWithinWatermark(["ticker", "id"])
    else:
        scored = scored.dropDuplicates(["ticker", "id"])
    days = scored.groupBy(F.window("created_date", "1 day"), "ticker").agg(
        F.avg("sentiment").alias("average_sentiment"),
        F.coalesce(F.sum("score"), F.lit(0)).cast("bigint").alias("total_score"),
        F.coalesce(F.sum("mention_count"), F.lit(0)).cast("bigint").alias("mention_count"),
    )
    return days.select(
        "ticker", F.to_date("window.start").alias("date"), "average_sentiment", "total_score", "mention_count"
    )


def start(days: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Process everything that has landed, append closed days as parquet, then stop."""
    writer = days.writeStream.outputMode("append").format("parquet").option("path", output)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
