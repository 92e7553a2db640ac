"""Technical indicators of price bars (one row per ticker and date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketsense.operators import series
from marketsense.schemas import LAG_STEPS, TECHNICAL

FAST, SLOW, SIGNAL = 12, 26, 9
WINDOW = 14
MACD_CHAINS = [[FAST, SIGNAL], [SLOW, SIGNAL]]


def _pick(df: DataFrame, *names: str) -> DataFrame:
    return df.select("ticker", "date", *names)


def _rolling(rows: int):
    return series.ordered_window().rowsBetween(1 - rows, 0)


def change_of(close: str = "close") -> Column:
    return F.expr(f"{close} - lag({close}) over ({series.ordered_sql()})")


def with_ema(rows: DataFrame, spans: dict[str, int], value: str, halo: int, size: int) -> DataFrame:
    return rows.withColumns({name: series.ema(value, span, halo, size) for name, span in spans.items()})


def with_macd(rows: DataFrame, halo: int, size: int) -> DataFrame:
    """MACD (12/26) and its signal line (9); needs blocks from ``MACD_CHAINS``."""
    rows = with_ema(rows, {"ema_12": FAST, "ema_26": SLOW}, "close", halo, size)
    rows = rows.withColumn("macd", F.col("ema_12") - F.col("ema_26"))
    return with_ema(rows, {"signal": SIGNAL}, "macd", halo, size)


def with_rsi(rows: DataFrame) -> DataFrame:
    """RSI over the simple mean of 14 changes.

    A missing first change counts as no change.  No losses: 100; neither gains
    nor losses: null.
    """
    rows = rows.withColumn("_change", change_of())
    gains = F.when(F.col("_change") > 0, F.col("_change")).otherwise(0.0)
    losses = F.when(F.col("_change") < 0, -F.col("_change")).otherwise(0.0)
    rows = rows.withColumns({"_gain": F.avg(gains).over(_rolling(WINDOW)), "_loss": F.avg(losses).over(_rolling(WINDOW))})
    rsi = (
        F.when(F.col("pos") < WINDOW - 1, None)
        .when(F.col("_loss") > 0, F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.try_divide("_gain", "_loss")))
        .when(F.col("_gain") > 0, F.lit(100.0))
    )
    return rows.withColumn("rsi", rsi).drop("_change", "_gain", "_loss")


def with_atr(rows: DataFrame) -> DataFrame:
    """Mean true range of 14 rows."""
    previous = F.lag("close", 1).over(series.ordered_window())
    true_range = F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous)
    )
    rows = rows.withColumn("_range", true_range)
    enough = F.count("_range").over(_rolling(WINDOW)) == WINDOW
    return rows.withColumn("atr", F.when(enough, F.avg("_range").over(_rolling(WINDOW)))).drop("_range")


def signed_volume(flat: str = "subtract") -> Column:
    """Volume with the sign of the price move.

    Days without a rise subtract, flat days and the first row included;
    ``flat='zero'`` leaves those at zero, the textbook form.
    """
    change = change_of()
    if flat == "zero":
        sign = F.when(change > 0, 1.0).when(change < 0, -1.0).otherwise(0.0)
    elif flat == "subtract":
        sign = F.when(change > 0, 1.0).otherwise(-1.0)
    else:
        raise ValueError("flat must be 'subtract' or 'zero'")
    return sign * F.col("volume")


def with_obv(rows: DataFrame, flat: str = "subtract") -> DataFrame:
    """Running total of the signed volume."""
    return rows.withColumn("_flow", signed_volume(flat)).withColumn("obv", series.so_far("sum(_flow)")).drop("_flow")


def lagged(names: list[str], steps: int) -> list[str]:
    """SQL of the lag columns, grouped by name."""
    ordered = series.ordered_sql()
    return [f"lag({name}, {step}) over ({ordered}) as {name}_lag_{step}" for name in names for step in range(1, steps + 1)]


# -- stand-alone operators -----------------------------------------------------


def ema(bars: DataFrame, spans: list[int] | None = None, column: str = "close") -> DataFrame:
    """Exponential averages ``ema_<span>`` of a gap-free column.

    Spans that fit one block layout are computed together; others get blocks of their own.
    """
    spans = spans or [FAST, SLOW]
    numbered = series.number_rows(_pick(bars, column))
    result = None
    for group in series.span_groups(spans):
        halo, size = series.ema_layout([[span] for span in group])
        rows = with_ema(series.cut_blocks(numbered, before=halo, size=size), {f"ema_{span}": span for span in group}, column, halo, size)
        found = _pick(series.own_rows(rows), *[f"ema_{span}" for span in group])
        result = found if result is None else result.join(found, ["ticker", "date"])
    return _pick(result, *[f"ema_{span}" for span in spans])


def macd(bars: DataFrame) -> DataFrame:
    halo, size = series.ema_layout(MACD_CHAINS)
    rows = series.cut_blocks(series.number_rows(_pick(bars, "close")), before=halo, size=size)
    return _pick(series.own_rows(with_macd(rows, halo, size)), "macd", "signal")


def rsi(bars: DataFrame) -> DataFrame:
    return _pick(with_rsi(series.number_rows(_pick(bars, "close"))), "rsi")


def atr(bars: DataFrame) -> DataFrame:
    return _pick(with_atr(series.placed(_pick(bars, "close", "high", "low"))), "atr")


def obv(bars: DataFrame, flat: str = "subtract") -> DataFrame:
    return _pick(with_obv(series.placed(_pick(bars, "close", "volume")), flat), "obv")


def lag_features(df: DataFrame, names: list[str] | None = None, steps: int = LAG_STEPS) -> DataFrame:
    """``<name>_lag_<k>`` for k = 1..steps, all in one window."""
    names = names or TECHNICAL
    rows = series.placed(_pick(df, *names))
    columns = [f"{name}_lag_{step}" for name in names for step in range(1, steps + 1)]
    return _pick(rows.selectExpr("*", *lagged(names, steps)), *names, *columns)


def target_label(bars: DataFrame, drop_last: bool = False) -> DataFrame:
    """1 when the next close is higher, else 0.

    A comparison with a missing close is not higher.  The last row of a series has
    no next close: it gets 0 and stays, unless ``drop_last`` is set.
    """
    return _pick(with_target(series.placed(_pick(bars, "close")), drop_last), "target")


def with_target(rows: DataFrame, drop_last: bool = False) -> DataFrame:
    following = F.lead("close", 1).over(series.ordered_window())
    rows = rows.withColumn("target", F.coalesce(following > F.col("close"), F.lit(False)).cast("int"))
    if drop_last:
        rows = rows.withColumn("_next", F.lead("date", 1).over(series.ordered_window()))
        rows = rows.where(F.col("_next").isNotNull()).drop("_next")
    return rows
