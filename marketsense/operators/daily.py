"""Daily rollups of scored mentions and the decision rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from marketsense.functions.lexicon import Lexicon
from marketsense.functions.sentiment import sentiment
from marketsense.operators import series
from marketsense.schemas import require_columns

AVERAGE = "average_sentiment"


def score_mentions(mentions: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """Add ``sentiment`` of ``body``; the text itself does not travel further than its task."""
    return require_columns(mentions, "body").withColumn("sentiment", sentiment("body", lexicon))


def daily_sentiment(scored: DataFrame) -> DataFrame:
    """Mean sentiment, number of scored mentions and total score per ticker and day.

    Partial aggregation runs before the shuffle, so a ticker or day that holds
    most mentions sends one row per task.
    """
    return scored.groupBy("ticker", F.to_date("created_date").alias("date")).agg(
        F.avg("sentiment").alias(AVERAGE),
        F.count("sentiment").alias("mention_count"),
        F.coalesce(F.sum("score"), F.lit(0)).cast("bigint").alias("total_score"),
    )


def word_hits(df: DataFrame) -> DataFrame:
    """Add ``mention_count``: both word counts together, 0 where either column is absent."""
    present = {"ticker_count", "name_count"} <= set(df.columns)
    hits = F.col("ticker_count") + F.col("name_count") if present else F.lit(0)
    return df.withColumn("mention_count", hits.cast("bigint"))


def daily_current_sentiment(scored: DataFrame) -> DataFrame:
    """Rollup of live mentions; ``mention_count`` adds up word hits, not rows."""
    rows = word_hits(require_columns(scored, "sentiment", "created_date", "score"))
    return rows.groupBy("ticker", F.to_date("created_date").alias("date")).agg(
        F.avg("sentiment").alias(AVERAGE),
        F.coalesce(F.sum("score"), F.lit(0)).cast("bigint").alias("total_score"),
        F.coalesce(F.sum("mention_count"), F.lit(0)).alias("mention_count"),
    )


def sentiment_decision(scored: DataFrame) -> DataFrame:
    """'yes' per ticker when some day is above the mean of the day means with a mean score >= 0.

    ``threshold`` (1.5 times the mean) and the deviation are reported only.
    """
    days = scored.where(F.col("created_date").isNotNull())
    days = days.groupBy("ticker", F.to_date("created_date").alias("date")).agg(
        F.avg("sentiment").alias(AVERAGE), F.avg("score").alias("average_score")
    )
    # One row per ticker and day is left, at most the calendar per ticker, so a
    # window is safe and spares the scores a second computation.
    ticker = Window.partitionBy("ticker")
    days = days.withColumns(
        {
            "mean_sentiment": F.avg(AVERAGE).over(ticker),
            "std_sentiment": F.stddev_samp(AVERAGE).over(ticker),
        }
    )
    good = (F.col(AVERAGE) > F.col("mean_sentiment")) & (F.col("average_score") >= 0)
    result = days.groupBy("ticker").agg(
        F.count_if(good).alias("good_days"),
        F.first("mean_sentiment").alias("mean_sentiment"),
        F.first("std_sentiment").alias("std_sentiment"),
    )
    return result.select(
        "ticker",
        F.when(F.col("good_days") > 0, "yes").otherwise("no").alias("decision"),
        "good_days",
        "mean_sentiment",
        "std_sentiment",
        (F.col("mean_sentiment") * 1.5).alias("threshold"),
    )


def moving_average(df: DataFrame, window: int = 3, column: str = AVERAGE) -> DataFrame:
    """Mean of the last ``window`` rows (not days); null unless all of them have a value."""
    return with_moving_average(series.placed(df), window, column)


def with_moving_average(rows: DataFrame, window: int = 3, column: str = AVERAGE) -> DataFrame:
    frame = series.ordered_window().rowsBetween(1 - window, 0)
    full = F.count(column).over(frame) == window
    return rows.withColumn(f"sentiment_moving_average_{window}d", F.when(full, F.avg(column).over(frame)))
