"""Ordered work on daily series: one exchange by ticker, windows from there on.

A series has one row per ticker and day, so the calendar bounds it: a century is 36,525
rows, a few megabytes, however many texts or trades stand behind a row (those are added up
per day before they meet a series).  Every operator here therefore keeps a series in
one task, sorted by date, and says all it needs as window functions over the same
partitioning: positions, fills, lags, running totals, extremes.  Spark runs them
after a single exchange, without a self-join or a summary table, and tickers are
what is dealt out.

Exponential averages need more: their weights leave the range of a double within some
thousand rows.  ``cut_blocks`` cuts a series into blocks of equal length with copies of
the rows before them ("halo"); windows over (ticker, block) stay inside the series' task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

SPAN_DAYS = 512
BLOCK_ROWS = 4096


def ordered_sql(key: str = "ticker", order: str = "date") -> str:
    """The series window as SQL, without a frame."""
    return f"partition by {key} order by {order}"


def ordered_window(key: str = "ticker", order: str = "date"):
    return Window.partitionBy(key).orderBy(order)


def so_far(aggregate: str, key: str = "ticker", order: str = "date") -> Column:
    """An aggregate (SQL) over the series up to the row."""
    return F.expr(f"{aggregate} over ({ordered_sql(key, order)} rows between unbounded preceding and current row)")


def filled(name: str, key: str = "ticker", order: str = "date", backward: bool = True) -> Column:
    """Forward fill, then back fill, of a column.

    Only leading nulls are left to the back fill, so its value is the first one
    of the series; a frame that looks ahead from every row is not needed (Spark
    evaluates those in quadratic time).
    """
    last = so_far(f"last({name}, true)", key, order)
    if not backward:
        return last
    return F.coalesce(last, F.expr(f"first({name}, true) over ({ordered_sql(key, order)} rows between unbounded preceding and unbounded following)"))


def span_of(order: str) -> Column:
    return F.floor(F.datediff(F.col(order), F.lit("1970-01-01").cast("date")) / F.lit(SPAN_DAYS))


def placed(df: DataFrame, key: str = "ticker", order: str = "date") -> DataFrame:
    """``df``, failing on the first row without a key or a place in its series: it belongs nowhere, and dropping it unseen would hide the loss."""
    known = F.col(key).isNotNull() & F.col(order).isNotNull()
    return df.where(F.when(known, True).otherwise(F.raise_error(F.lit(f"a row has no {key} or no {order}; drop or repair such rows first"))))


def number_rows(
    df: DataFrame,
    key: str = "ticker",
    order: str = "date",
    fill: Iterable[str] = (),
    backward: bool = True,
) -> DataFrame:
    """Add ``pos``, the dense 0-based position in the series, filling ``fill``.

    ``order`` must be unique within ``key``, and neither may be null.
    """
    fill = list(fill)
    return placed(df, key, order).select(
        *[filled(c, key, order, backward).alias(c) if c in fill else c for c in df.columns],
        F.expr(f"row_number() over ({ordered_sql(key, order)}) - 1 as pos"),
    )


def fill_gaps(df: DataFrame, names: Iterable[str], key: str = "ticker", order: str = "date", backward: bool = True) -> DataFrame:
    """Forward fill then back fill; ``backward=False`` never looks ahead."""
    return number_rows(df, key, order, fill=names, backward=backward).drop("pos")


def cut_blocks(df: DataFrame, before: int, size: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_block`` and ``_halo``; the last ``before`` rows of a block are copied into the next one."""
    if size < max(before, 1):
        raise ValueError("a block must be at least as long as its halo")
    own = F.floor(F.col("pos") / F.lit(size))
    next_block = F.when(F.col("pos") % F.lit(size) >= size - before, own + 1)
    rows = df.withColumn("_block", F.explode(F.array_compact(F.array(own, next_block))))
    return rows.withColumn("_halo", F.col("_block") != own)


def block_sql(key: str = "ticker", order: str = "date") -> str:
    """The block window as SQL, without a frame."""
    return f"partition by {key}, _block order by {order}"


def own_rows(df: DataFrame) -> DataFrame:
    """Drop the halo copies."""
    return df.where(~F.col("_halo")).drop("_halo", "_block")


# -- exponential averages ------------------------------------------------------
#
# e = a*x + (1-a)*e' forgets: after ``memory`` rows the start weighs less than
# TOLERANCE, below the rounding of a double.  So a halo of that length makes
# the average of a block independent of everything before it.  Inside a block
# the recursion is a running sum of x * q**-n, scaled back by q**n (q = 1-a);
# the block size keeps q**-n inside the range of a double.

TOLERANCE_DIGITS = 18
RANGE_DIGITS = 280


def _decay(span: int) -> float:
    if span < 2:
        raise ValueError("span must be at least 2")
    return 1.0 - 2.0 / (span + 1.0)


def memory(span: int) -> int:
    """Rows after which a value's weight is below TOLERANCE."""
    return math.ceil(TOLERANCE_DIGITS / -math.log10(_decay(span)))


def ema_layout(chains: Iterable[Iterable[int]]) -> tuple[int, int]:
    """(halo, block size) for averages computed together.

    Each chain lists the spans applied one after the other to the same input.
    """
    chains = [list(chain) for chain in chains]
    halo = max(sum(memory(span) for span in chain) for chain in chains)
    fastest = min(span for chain in chains for span in chain)
    size = _room(fastest) - halo
    if size < halo:
        raise ValueError("spans too far apart for one pass; compute them in separate passes")
    return halo, min(size, 8 * halo)


def span_groups(spans: Iterable[int]) -> list[list[int]]:
    """Spans in groups that one block layout serves, close spans together."""
    groups: list[list[int]] = []
    for span in sorted(set(spans)):
        if groups and _room(groups[-1][0]) >= 2 * memory(span):
            groups[-1].append(span)
        else:
            groups.append([span])
    return groups


def _room(span: int) -> int:
    """Rows over which the powers of a span's decay stay inside the range of a double."""
    return int(RANGE_DIGITS / -math.log10(_decay(span)))


def ema(value: str, span: int, halo: int, size: int, key: str = "ticker") -> Column:
    """Exponential average (no bias correction) over blocks cut by ``ema_layout``.

    ``value`` (SQL) must not be null: fill gaps first.
    """
    q = _decay(span)
    n = f"cast(pos - greatest(0, _block * {size} - {halo}) as double)"
    term = f"case when {n} = 0 then 1.0D else {1.0 - q!r}D end * ({value}) * pow({q!r}D, -{n})"
    running = f"({block_sql(key)} rows between unbounded preceding and current row)"
    return F.expr(f"sum({term}) over {running} * pow({q!r}D, {n})")
