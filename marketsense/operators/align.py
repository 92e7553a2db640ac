"""Alignment of daily sentiment to trading days, and the per-day join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from marketsense.operators import series


def trading_calendar(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """Trading days per ticker; a ticker without bars trades on its sentiment days."""
    days = bars.select("ticker", "date").distinct()
    priced = bars.select("ticker").distinct()
    own = daily.select("ticker", "date").distinct().join(priced, "ticker", "left_anti")
    return days.unionByName(own)


def asof_backward(calendar: DataFrame, facts: DataFrame, own_days: bool = False) -> DataFrame:
    """For each calendar day the latest facts row with date <= day, however old.

    The found row is taken as it is, nulls included, so whole rows are carried,
    not columns.  Days before the first row get nulls.  Both sides are laid out as one
    series per ticker: one exchange, one sort.  With ``own_days`` a ticker that the
    calendar does not know trades on the days of its facts.  Also returns ``pos``, the
    day's position.
    """
    names = [c for c in facts.columns if c not in ("ticker", "date")]
    row_type = facts.schema
    payload = F.struct(*names)
    days = calendar.select("ticker", "date", F.lit(1).alias("_day"), F.lit(None).cast(_struct(row_type, names)).alias("_row"))
    rows = series.placed(days.unionByName(facts.select("ticker", "date", F.lit(0).alias("_day"), payload.alias("_row"))))
    earlier = Window.partitionBy("ticker").orderBy("date", "_day").rowsBetween(Window.unboundedPreceding, 0)
    if own_days:
        known = F.max("_day").over(Window.partitionBy("ticker"))
        rows = rows.withColumn("_day", F.when(known == 0, 1).otherwise(F.col("_day")))
    rows = rows.withColumns({"_found": F.last("_row", ignorenulls=True).over(earlier), "pos": F.sum("_day").over(earlier) - 1})
    return rows.where(F.col("_day") == 1).select("ticker", "date", *[F.col("_found").getField(n).alias(n) for n in names], "pos")


def _struct(schema, names):
    from pyspark.sql import types as T

    return T.StructType([T.StructField(n, schema[n].dataType, True) for n in names])


def merge_price_sentiment(technical: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Inner join per ticker and day."""
    return technical.join(sentiment, ["ticker", "date"], "inner")


def to_utc(column: str, zone: str | None = None):
    """Timestamp in UTC; without a declared zone the value is UTC already."""
    stamp = F.col(column).cast("timestamp")
    return stamp if zone is None else F.to_utc_timestamp(stamp, zone)
