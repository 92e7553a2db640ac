"""The merged feature table: technical and sentiment features per ticker and day."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marketsense.functions.lexicon import Lexicon
from marketsense.operators.align import merge_price_sentiment
from marketsense.plans.sentiment import sentiment_features
from marketsense.plans.technical import technical_features
from marketsense.schemas import LAG_STEPS


def merged_features(
    bars: DataFrame, mentions: DataFrame, lexicon: Lexicon | None = None, leak_free: bool = False, train_until: str | None = None
) -> DataFrame:
    """41 features and the target, keyed by (ticker, date).

    Sentiment is aligned to the days of the technical table: the first rows of a
    series are lost to the lags.  ``leak_free`` leaves out all that looks ahead, and
    then needs ``train_until``: scaling is fitted on the rows before that date.
    """
    if leak_free and train_until is None:
        raise ValueError("a leak-free table needs train_until, the date that ends the training rows")
    technical = technical_features(bars, leak_free=leak_free, train_until=train_until)
    if leak_free:
        return merge_price_sentiment(technical, sentiment_features(mentions, technical, lexicon, leak_free, train_until))
    # Fills leave no gaps, so the days are known without the indicators: all but the first ones.
    return merge_price_sentiment(technical, sentiment_features(mentions, bars, lexicon, skip=LAG_STEPS))
