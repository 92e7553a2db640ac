"""Positional train/test split and expanding time-series folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketsense.operators import series
from marketsense.operators.series import span_of

TRAIN_SHARE = 0.8
N_FOLDS = 5


def global_positions(df: DataFrame, by: str = "ticker", rank: str = "ticker") -> DataFrame:
    """Add ``pos``, the position in the whole table, and ``total``, its length.

    ``by='ticker'``: tickers one after the other (in order of ``rank``, a column
    constant per ticker), each by date.  ``by='date'``: chronological, ties by
    ticker.  Rows are only sorted inside small groups; group sizes are added up
    on a summary table (one row per ticker and time span, or per date).
    """
    rows = series.placed(df)
    if by == "date":
        group, inside = ["date"], Window.partitionBy("date").orderBy("ticker")
        # One row per calendar day.
        sizes = rows.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
        ordered = Window.orderBy("date")
        sizes = sizes.select("date", _before("_n", ordered).alias("_start"), F.sum("_n").over(_whole(ordered)).alias("total"))
    elif by == "ticker":
        rows = rows.withColumn("_span", span_of("date"))
        group, inside = ["ticker", "_span"], Window.partitionBy("ticker", "_span").orderBy("date")
        spans = rows.groupBy("ticker", "_span").agg(F.count(F.lit(1)).alias("_n"), F.min(rank).alias("_rank"))
        # One row per ticker.
        tickers = spans.groupBy("ticker").agg(F.sum("_n").alias("_n"), F.min("_rank").alias("_rank"))
        ordered = Window.orderBy("_rank", "ticker")
        tickers = tickers.select(
            "ticker", _before("_n", ordered).alias("_offset"), F.sum("_n").over(_whole(ordered)).alias("total")
        )
        within = Window.partitionBy("ticker").orderBy("_span")
        sizes = spans.withColumn("_inner", _before("_n", within)).join(tickers, "ticker")
        sizes = sizes.select("ticker", "_span", (F.col("_offset") + F.col("_inner")).alias("_start"), "total")
    else:
        raise ValueError("by must be 'ticker' or 'date'")
    placed = rows.join(sizes, group).withColumn("pos", F.col("_start") + F.row_number().over(inside) - 1)
    return placed.drop("_start", "_span")


def _before(name: str, ordered) -> Column:
    return F.coalesce(F.sum(name).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _whole(ordered):
    return ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def train_test_split(df: DataFrame, share: float = TRAIN_SHARE, by: str = "ticker", rank: str = "ticker") -> DataFrame:
    """Add ``split``: the first int(share * n) rows train, the others test.

    By ticker the test rows are the end of the last tickers, not the latest
    dates; ``by='date'`` gives the chronological split.
    """
    rows = global_positions(df, by, rank)
    train = F.col("pos") < F.floor(F.col("total") * F.lit(share))
    return rows.withColumn("split", F.when(train, "train").otherwise("test"))


def fold_bounds(total: Column | int, fold: int, n_folds: int = N_FOLDS):
    """(first, end) test positions of a 1-based fold."""
    size = F.floor(total / (n_folds + 1)) if isinstance(total, Column) else total // (n_folds + 1)
    return total - (n_folds + 1 - fold) * size, total - (n_folds - fold) * size


def time_series_folds(positioned: DataFrame, n_folds: int = N_FOLDS) -> DataFrame:
    """One row per (row, fold) with its role; a fold trains on everything before its test rows."""
    total, pos = F.col("total"), F.col("pos")
    parts = []
    for fold in range(1, n_folds + 1):
        first, end = fold_bounds(total, fold, n_folds)
        role = F.when(pos < first, "train").when(pos < end, "test")
        parts.append(F.struct(F.lit(fold).alias("fold"), role.alias("role")))
    rows = positioned.withColumn("_part", F.explode(F.array(*parts))).where(F.col("_part.role").isNotNull())
    return rows.select(*positioned.columns, "_part.fold", "_part.role")
