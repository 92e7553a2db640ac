"""Scaling, imputation and outlier flags per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_extremes(df: DataFrame, names: list[str], fit_on: str | None = None, key: str = "ticker") -> DataFrame:
    """Add ``_<name>_min`` and ``_<name>_max`` of the whole series, or of its rows where ``fit_on`` (SQL) holds."""
    value = f"case when {fit_on} then {{}} end" if fit_on else "{}"
    sides = [f"{side}({value.format(name)}) over (partition by {key}) as _{name}_{side}" for name in names for side in ("min", "max")]
    return df.selectExpr("*", *sides)


def scaled_sql(name: str, value: str | None = None) -> str:
    """(x - min) / (max - min); a constant column becomes 0, nulls stay null.

    ``value`` names another column to scale by the extremes of ``name``.
    """
    value = value or name
    ratio = f"try_divide({value} - _{name}_min, _{name}_max - _{name}_min)"
    return f"case when {value} is not null then coalesce({ratio}, 0.0D) end"


def minmax_features(df: DataFrame, names: list[str], key: str = "ticker", fit_on: str | None = None) -> DataFrame:
    """Min-max scale columns per series.

    With ``fit_on`` (SQL) only such rows set the extremes; a series without any becomes 0.
    """
    types = dict(df.dtypes)
    kept = [f"cast({c} as double) as {c}" if c in names and types[c] != "double" else c for c in df.columns]
    rows = with_extremes(df.selectExpr(*kept), names, fit_on, key)
    return rows.selectExpr(*[f"{scaled_sql(c)} as {c}" if c in names else c for c in df.columns])


def impute_mean(df: DataFrame, names: list[str], fit_on: Column | None = None) -> DataFrame:
    """Replace nulls by the column mean (of the rows where ``fit_on`` holds)."""
    fit = df if fit_on is None else df.where(fit_on)
    means = fit.agg(F.struct(*[F.avg(name).alias(name) for name in names]).alias("means")).scalar()
    return df.withColumns({name: F.coalesce(F.col(name).cast("double"), means.getField(name)) for name in names})


def significant_volume(bars: DataFrame, deviations: float = 2.0, key: str = "ticker", order: str = "date") -> DataFrame:
    """Days whose volume exceeds mean + deviations * sample standard deviation."""
    whole = Window.partitionBy(key)
    deviation = F.coalesce(F.stddev_samp("volume").over(whole), F.lit(0.0))
    rows = bars.withColumn("threshold", F.avg("volume").over(whole) + F.lit(deviations) * deviation)
    return rows.where(F.col("volume") > F.col("threshold")).select(key, order, "volume", "threshold")
