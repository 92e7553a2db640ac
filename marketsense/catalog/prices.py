"""Price bars: indicators, fills, scaling, the technical table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from marketsense import fixtures
from marketsense.operators import indicators, scaling, series
from marketsense.plans.technical import technical_features
from marketsense.schemas import LAG_STEPS, LAGS, TECHNICAL
from marketsense.session import join_path, shared_folder
from marketsense.sources import bars as sources


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


def _bars(spark, sf):
    return fixtures.table(spark, sf, "bars")


def _technical(spark, sf):
    df = technical_features(_bars(spark, sf))
    return rounded(df, 8, *TECHNICAL, *LAGS)


TICKERS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "9-UNKNOWN"]
RANGE = ("1996-01-01", "1998-01-01")

def _load_parts(spark, sf):
    """Two stage tables, one that does not exist and one that is no parquet, read back as one; with the report."""
    bars, folder = _bars(spark, sf), join_path(shared_folder(spark), "marketsense", f"merged-{uuid.uuid4().hex}")
    first = F.col("ticker") < "3"
    paths = [join_path(folder, name) for name in ("first", "second", "broken", "missing")]
    bars.where(first).write.parquet(paths[0])
    bars.where(~first).write.parquet(paths[1])
    bars.select("ticker").write.text(paths[2])
    return sources.load_merged(spark, paths, schema=bars.schema)


def _load_merged(spark, sf):
    return sources.stack_tickers(_load_parts(spark, sf)[0], TICKERS)


def _load_report(spark, sf):
    """What became of each of the paths, and the rows that came from it."""
    rows, report = _load_parts(spark, sf)
    name = r"/merged-[0-9a-f]+/([a-z]+)"
    counts = rows.groupBy(F.regexp_extract(F.col("_metadata.file_path"), name, 1).alias("part")).agg(F.count(F.lit(1)).alias("n_rows"))
    paths = report.select(F.regexp_extract("path", name, 1).alias("part"), "status").distinct()
    return paths.join(counts, "part", "left").select("part", "status", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


QUERIES = {
    "ema": lambda s, d: rounded(indicators.ema(_bars(s, d)), 4, "ema_12", "ema_26"),
    "macd": lambda s, d: rounded(indicators.macd(_bars(s, d)), 4, "macd", "signal"),
    "rsi": lambda s, d: rounded(indicators.rsi(_bars(s, d)), 8, "rsi"),
    "atr": lambda s, d: rounded(indicators.atr(_bars(s, d)), 4, "atr"),
    "obv": lambda s, d: indicators.obv(_bars(s, d)),
    "lag_features": lambda s, d: indicators.lag_features(_bars(s, d), ["close", "volume"]),
    "target_label": lambda s, d: indicators.target_label(_bars(s, d)),
    "fill_gaps": lambda s, d: series.fill_gaps(
        fixtures.table(s, d, "bars_gaps").select("ticker", "date", "close", "volume"), ["close"]
    ),
    "minmax_features": lambda s, d: rounded(
        scaling.minmax_features(_bars(s, d).select("ticker", "date", "close", "volume"), ["close", "volume"]),
        10, "close", "volume",
    ),
    "impute_mean": lambda s, d: rounded(
        scaling.impute_mean(fixtures.table(s, d, "bars_gaps").select("ticker", "date", "close"), ["close"]), 4, "close"
    ),
    "significant_volume": lambda s, d: rounded(scaling.significant_volume(_bars(s, d)), 4, "threshold"),
    "technical_features": _technical,
    "bars_range_report": lambda s, d: sources.range_report(_bars(s, d), *RANGE),
    "ticker_load_summary": lambda s, d: sources.load_summary(_bars(s, d), TICKERS, *RANGE),
    "load_merged": _load_merged,
    "load_report": _load_report,
}

_RSI = """select ticker, date, case when n < 14 then null when loss > 0 then 100 - 100 / (1 + gain / loss)
       when gain > 0 then 100 end as rsi
from (select ticker, date, row_number() over (partition by ticker order by date) as n,
             avg(greatest(coalesce(delta, 0), 0)) over w as gain, avg(greatest(coalesce(-delta, 0), 0)) over w as loss
      from (select ticker, date, close - lag(close) over (partition by ticker order by date) as delta from {bars}) d
      window w as (partition by ticker order by date rows 13 preceding)) r"""

_ATR = """select ticker, date, case when n = 14 then v end as atr
from (select ticker, date, count(tr) over w as n, avg(tr) over w as v
      from (select ticker, date, greatest(high - low, abs(high - p), abs(low - p)) as tr
            from (select *, lag(close) over (partition by ticker order by date) as p from {bars}) b) t
      window w as (partition by ticker order by date rows 13 preceding)) r"""

_OBV = """select ticker, date, sum(case when close > p then volume else -volume end) over
       (partition by ticker order by date rows unbounded preceding) as obv
from (select *, lag(close) over (partition by ticker order by date) as p from {bars}) b"""

# Recursive averages: one step per row.
_EMA = """numbered as (select *, row_number() over (partition by ticker order by date) as rn from {bars}),
steps as (
  select ticker, date, rn, close as e12, close as e26, 0.0::double as sig from numbered where rn = 1
  union all
  select n.ticker, n.date, n.rn, 2.0::double / 13 * n.close + (1 - 2.0::double / 13) * s.e12,
         2.0::double / 27 * n.close + (1 - 2.0::double / 27) * s.e26,
         0.2::double * ((2.0::double / 13 * n.close + (1 - 2.0::double / 13) * s.e12)
                        - (2.0::double / 27 * n.close + (1 - 2.0::double / 27) * s.e26)) + 0.8::double * s.sig
  from steps s join numbered n on n.ticker = s.ticker and n.rn = s.rn + 1)"""

_MINMAX = "coalesce(({c} - min({c}) over (partition by ticker)) / nullif(max({c}) over (partition by ticker) - min({c}) over (partition by ticker), 0), 0)"


def _technical_sql(train_until: str | None = None) -> str:
    """CTEs ending in ``technical``; with a date the leak-free table, scaled by the rows before it."""
    fill = "last_value({c} ignore nulls) over (partition by ticker order by date rows unbounded preceding)"
    minmax = _MINMAX
    if train_until is None:
        fill = f"coalesce({fill}, first_value({{c}} ignore nulls) over (partition by ticker order by date rows between current row and unbounded following))"
    else:
        minmax = _MINMAX.replace(") over", f") filter (where date < date '{train_until}') over")
    lags = ", ".join(
        f"lag({c}, {k}) over (partition by ticker order by date) as {c}_lag_{k}" for c in TECHNICAL for k in range(1, LAG_STEPS + 1)
    )
    scaled = ", ".join(f"round(case when {c} is not null then {minmax.format(c=c)} end, 8) as {c}" for c in TECHNICAL + LAGS)
    kept = " and ".join(f"{c} is not null" for c in TECHNICAL + LAGS)
    return f"""{fixtures.ctes("bars")}, {_EMA.format(bars="bars")},
rsi_ as ({_RSI.format(bars="bars")}), atr_ as ({_ATR.format(bars="bars")}), obv_ as ({_OBV.format(bars="bars")}),
joined as (
  select b.ticker, b.date, s.e12 - s.e26 as macd, s.sig as signal, r.rsi, a.atr, o.obv, b.volume,
         coalesce(cast(lead(b.close) over (partition by b.ticker order by b.date) > b.close as int), 0) as target
  from bars b join steps s using (ticker, date) join rsi_ r using (ticker, date)
  join atr_ a using (ticker, date) join obv_ o using (ticker, date)),
filled as (select ticker, date, macd, signal, {fill.format(c="rsi")} as rsi, {fill.format(c="atr")} as atr, obv, volume, target from joined),
lagged as (select *, {lags} from filled),
technical as (select ticker, date, {scaled}, target from lagged where {kept})"""


TRAIN_UNTIL = "1999-07-01"
TECHNICAL_CTES, TECHNICAL_LEAK_FREE = _technical_sql(), _technical_sql(TRAIN_UNTIL)

_TICKER_LIST = ", ".join(f"('{t}', {i})" for i, t in enumerate(TICKERS))

ORACLES = {
    "ema": f"{fixtures.ctes('bars')}, {_EMA.format(bars='bars')} select ticker, date, round(e12, 4) as ema_12, round(e26, 4) as ema_26 from steps",
    "macd": f"{fixtures.ctes('bars')}, {_EMA.format(bars='bars')} select ticker, date, round(e12 - e26, 4) as macd, round(sig, 4) as signal from steps",
    "rsi": f"{fixtures.ctes('bars')} select ticker, date, round(rsi, 8) as rsi from ({_RSI.format(bars='bars')}) q",
    "atr": f"{fixtures.ctes('bars')} select ticker, date, round(atr, 4) as atr from ({_ATR.format(bars='bars')}) q",
    "obv": f"{fixtures.ctes('bars')} {_OBV.format(bars='bars')}",
    "lag_features": f"{fixtures.ctes('bars')} select ticker, date, close, volume, "
    + ", ".join(f"lag({c}, {k}) over (partition by ticker order by date) as {c}_lag_{k}" for c in ("close", "volume") for k in range(1, 6))
    + " from bars",
    "target_label": f"{fixtures.ctes('bars')} select ticker, date, coalesce(cast(lead(close) over (partition by ticker order by date) > close as int), 0) as target from bars",
    "fill_gaps": f"""{fixtures.ctes('bars_gaps')} select ticker, date,
coalesce(last_value(close ignore nulls) over (partition by ticker order by date rows unbounded preceding),
         first_value(close ignore nulls) over (partition by ticker order by date rows between current row and unbounded following)) as close, volume
from bars_gaps""",
    "minmax_features": f"{fixtures.ctes('bars')} select ticker, date, round({_MINMAX.format(c='close')}, 10) as close, round({_MINMAX.format(c='volume')}, 10) as volume from bars",
    "impute_mean": f"{fixtures.ctes('bars_gaps')} select ticker, date, round(coalesce(close, (select avg(close) from bars_gaps)), 4) as close from bars_gaps",
    "significant_volume": f"""{fixtures.ctes('bars')} select ticker, date, volume, round(threshold, 4) as threshold
from (select *, avg(volume) over w + 2 * stddev_samp(volume) over w as threshold from bars window w as (partition by ticker)) t
where volume > threshold""",
    "technical_features": f"{TECHNICAL_CTES} select * from technical",
    "bars_range_report": f"""{fixtures.ctes('bars')} select ticker, min(date) as available_from, max(date) as available_to,
min(date) filter (where date >= date '{RANGE[0]}' and date < date '{RANGE[1]}') as loaded_from,
max(date) filter (where date >= date '{RANGE[0]}' and date < date '{RANGE[1]}') as loaded_to,
count(*) filter (where date >= date '{RANGE[0]}' and date < date '{RANGE[1]}') as n_rows
from bars group by ticker""",
    "ticker_load_summary": f"""{fixtures.ctes('bars')}, wanted(ticker, ord) as (values {_TICKER_LIST}),
loaded as (select ticker, count(*) as n from bars where date >= date '{RANGE[0]}' and date < date '{RANGE[1]}' group by ticker)
select w.ticker, coalesce(n, 0) as n_rows, n is not null as loaded,
(select count(*) from wanted join loaded using (ticker)) as n_loaded, (select count(*) from wanted) as n_requested
from wanted w left join loaded l using (ticker)""",
    "load_report": f"""{fixtures.ctes('bars')}
select part, status, case part when 'first' then (select count(*) from bars where ticker < '3') when 'second' then (select count(*) from bars where not ticker < '3') else 0 end as n_rows
from (values ('first', 'read'), ('second', 'read'), ('broken', 'broken'), ('missing', 'missing')) v(part, status)""",
    "load_merged": f"""{fixtures.ctes('bars')}, wanted(ticker, ord) as (values {_TICKER_LIST})
select bars.*, ord as ticker_ord from bars join wanted using (ticker)""",
}
