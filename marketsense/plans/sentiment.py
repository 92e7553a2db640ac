"""The complete daily sentiment table, historic and current."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketsense.functions.lexicon import Lexicon
from marketsense.operators import align, daily, scaling, series
from marketsense.plans.technical import train_rows
from marketsense.schemas import SENTIMENT

AVERAGE, MOVING = "average_sentiment", "sentiment_moving_average_3d"
NUMBERS = [AVERAGE, "mention_count", "total_score"]


def with_interaction(df: DataFrame) -> DataFrame:
    return df.withColumn("sentiment_mentions_interaction", F.col("average_sentiment") * F.col("mention_count"))


def sentiment_features(
    mentions: DataFrame, bars: DataFrame, lexicon: Lexicon | None = None, leak_free: bool = False, train_until: str | None = None, skip: int = 0
) -> DataFrame:
    """Daily sentiment aligned to trading days: scaled, smoothed, filled.

    ``bars`` tells the trading days, one row per ticker and day; a ticker without bars
    trades on its sentiment days.  Nulls afterwards: the average before the first mention
    and the interaction of such days stay null; counts become 0; the moving average is
    filled forward, then back (``leak_free`` leaves the back fill out).  ``train_until`` fits
    the scaling on the days before that date only; the first ``skip`` days of each ticker
    are left out of everything.
    """
    dated = mentions.where(F.col("created_date").isNotNull())
    days = daily.daily_sentiment(daily.score_mentions(dated, lexicon))
    return aligned_features(days, bars.select("ticker", "date"), leak_free, train_until, skip)


def aligned_features(days: DataFrame, calendar: DataFrame, leak_free: bool = False, train_until: str | None = None, skip: int = 0) -> DataFrame:
    """Align, scale, smooth and fill.

    Scaling is linear, so smoothing and filling run on the raw values and the
    results are scaled.
    """
    rows = align.asof_backward(calendar, days, own_days=True).where(F.col("pos") >= skip)
    rows = rows.withColumns({name: F.col(name).cast("double") for name in NUMBERS})
    rows = daily.with_moving_average(rows)
    rows = rows.withColumns({"_average": series.filled(AVERAGE, backward=False), "_moving": series.filled(MOVING, backward=not leak_free)})
    rows = scaling.with_extremes(rows, NUMBERS, train_rows(train_until))
    count = scaling.scaled_sql("mention_count")
    rows = rows.selectExpr(
        "ticker",
        "date",
        f"{scaling.scaled_sql(AVERAGE, '_average')} as {AVERAGE}",
        f"coalesce({count}, 0.0D) as mention_count",
        f"coalesce({scaling.scaled_sql('total_score')}, 0.0D) as total_score",
        f"{scaling.scaled_sql(AVERAGE, '_moving')} as {MOVING}",
        f"({scaling.scaled_sql(AVERAGE)}) * ({count}) as sentiment_mentions_interaction",
    )
    return rows.select("ticker", "date", *SENTIMENT)


def current_features(scored: DataFrame) -> DataFrame:
    """Current daily table, unscaled: average filled forward, everything else 0."""
    rows = series.number_rows(daily.daily_current_sentiment(scored), fill=["average_sentiment"], backward=False)
    rows = daily.with_moving_average(rows)
    rows = with_interaction(rows)
    return rows.select("ticker", "date", *[F.coalesce(F.col(name).cast("double"), F.lit(0.0)).alias(name) for name in SENTIMENT])
