"""Explicit schemas of the tables (no inference anywhere)."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

TECHNICAL = ["macd", "signal", "rsi", "atr", "obv", "volume"]
LAG_STEPS = 5
LAGS = [f"{name}_lag_{step}" for name in TECHNICAL for step in range(1, LAG_STEPS + 1)]
SENTIMENT = [
    "average_sentiment",
    "mention_count",
    "total_score",
    "sentiment_moving_average_3d",
    "sentiment_mentions_interaction",
]
MODEL_FEATURES = TECHNICAL + LAGS + SENTIMENT

# Positional layout of the price files, after their three header lines.
PRICE_FILE = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("adj_close", T.StringType()),
        T.StructField("close", T.StringType()),
        T.StructField("high", T.StringType()),
        T.StructField("low", T.StringType()),
        T.StructField("open", T.StringType()),
        T.StructField("volume", T.StringType()),
    ]
)

# All text: the validator must see values that do not parse.
MENTIONS_FILE = T.StructType(
    [
        T.StructField("created_date", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("id", T.StringType()),
    ]
)

MENTION_COLUMNS = {"created_date", "author", "body", "score", "id"}


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Raise ``ValueError`` when a required column is missing."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
