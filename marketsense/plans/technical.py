"""The complete technical feature table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from marketsense.operators import indicators, scaling, series
from marketsense.schemas import LAG_STEPS, LAGS, TECHNICAL

PRICES = ["close", "high", "low", "volume"]


def technical_features(
    bars: DataFrame,
    leak_free: bool = False,
    drop_last: bool = False,
    scale: bool = True,
    train_until: str | None = None,
) -> DataFrame:
    """ticker, date, 6 indicators, 30 lags (grouped by indicator) and target.

    Order of work: fill prices, indicators, fill indicators, lags, drop
    incomplete rows, scale, target.  Back fills and whole-history scaling look
    ahead; ``leak_free`` leaves out the back fills (the first rows of a series
    then drop out), ``train_until`` (a date) fits the scaling on the rows before it
    only, and ``scale=False`` leaves scaling out.
    """
    look_back = not leak_free
    prices = bars.select("ticker", "date", *[F.nanvl(F.col(c), F.lit(None)).alias(c) for c in PRICES])
    rows = series.number_rows(prices, fill=PRICES, backward=look_back)
    if leak_free:
        rows = series.number_rows(rows.where(F.col("close").isNotNull()).drop("pos"))

    halo, size = series.ema_layout(indicators.MACD_CHAINS)
    rows = series.own_rows(indicators.with_macd(series.cut_blocks(rows, before=halo, size=size), halo, size))
    rows = indicators.with_obv(indicators.with_atr(indicators.with_rsi(rows)))
    rows = indicators.with_target(rows, drop_last)
    rows = rows.withColumns({name: series.filled(name, backward=look_back) for name in ("rsi", "atr")})
    rows = rows.select("ticker", "date", *TECHNICAL, "target")

    rows = rows.selectExpr("*", *indicators.lagged(TECHNICAL, LAG_STEPS)).dropna("any", subset=TECHNICAL + LAGS + ["target"])
    if scale:
        rows = scaling.minmax_features(rows, TECHNICAL + LAGS, fit_on=train_rows(train_until))
    return rows.select("ticker", "date", *TECHNICAL, *LAGS, "target")


def train_rows(train_until: str | None) -> str | None:
    """SQL condition of the rows that scaling is fitted on."""
    return None if train_until is None else f"date < date'{date.fromisoformat(train_until)}'"
