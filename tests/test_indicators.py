import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import bars_frame, by_date
from marketsense.operators import indicators, scaling, series
from marketsense.plans.technical import technical_features
from marketsense.schemas import LAGS, TECHNICAL


def walk(n, seed=1):
    return [float(x) for x in 100 + np.random.default_rng(seed).normal(size=n).cumsum()]


def test_rsi_flat_is_null_and_rising_is_100(spark):
    flat = by_date(indicators.rsi(bars_frame(spark, [5.0] * 20)), "rsi")
    rising = by_date(indicators.rsi(bars_frame(spark, [float(i) for i in range(20)])), "rsi")
    assert flat == [None] * 20
    assert rising == [None] * 13 + [100.0] * 7


def test_obv_subtracts_flat_days_and_the_first_row(spark):
    bars = bars_frame(spark, [1.0, 2.0, 2.0, 1.0], volume=[10, 20, 30, 40])
    assert by_date(indicators.obv(bars), "obv") == [-10.0, 10.0, -20.0, -60.0]
    assert by_date(indicators.obv(bars, flat="zero"), "obv") == [0.0, 20.0, 20.0, -20.0]


def test_target_keeps_the_last_row_as_zero(spark):
    bars = bars_frame(spark, [1.0, 2.0, 1.0, 3.0])
    assert by_date(indicators.target_label(bars), "target") == [1, 0, 1, 0]
    assert by_date(indicators.target_label(bars, drop_last=True), "target") == [1, 0, 1]


def test_fills_forward_then_back(spark, small_groups):
    closes = [None, None, 3.0] + [None] * 30 + [4.0, None]
    bars = bars_frame(spark, closes)
    assert by_date(series.fill_gaps(bars, ["close"]), "close") == [3.0] * 33 + [4.0, 4.0]
    assert by_date(series.fill_gaps(bars, ["close"], backward=False), "close") == [None, None] + [3.0] * 31 + [4.0, 4.0]


def test_constant_column_scales_to_zero_and_nulls_stay(spark):
    bars = bars_frame(spark, [5.0, 5.0, None])
    assert by_date(scaling.minmax_features(bars, ["close"]), "close") == [0.0, 0.0, None]


@pytest.mark.parametrize("span", [2, 9, 12, 26, 200])
def test_ema_equals_the_recursion(spark, span):
    values = walk(3000)
    got = by_date(indicators.ema(bars_frame(spark, values, start="1990-01-01"), [span]), f"ema_{span}")
    want = pd.Series(values).ewm(span=span, adjust=False).mean()
    assert np.allclose(got, want, rtol=1e-11, atol=1e-9)


def test_ema_survives_a_large_drop(spark):
    values = [1e9] * 100 + [1.0] * 2500
    got = by_date(indicators.ema(bars_frame(spark, values, start="1990-01-01"), [12]), "ema_12")
    want = pd.Series(values).ewm(span=12, adjust=False).mean()
    assert np.allclose(got, want, rtol=1e-9)


def pandas_technical(values, volume):
    frame = pd.DataFrame({"close": values, "volume": volume})
    frame["high"], frame["low"] = frame.close + 1, frame.close - 1
    frame = frame.ffill().bfill()
    macd = frame.close.ewm(span=12, adjust=False).mean() - frame.close.ewm(span=26, adjust=False).mean()
    change = frame.close.diff()
    gain = change.clip(lower=0).fillna(0).rolling(14).mean()
    loss = (-change.clip(upper=0)).fillna(0).rolling(14).mean()
    previous = frame.close.shift()
    ranges = pd.concat([frame.high - frame.low, (frame.high - previous).abs(), (frame.low - previous).abs()], axis=1).max(axis=1)
    out = pd.DataFrame(
        {
            "macd": macd,
            "signal": macd.ewm(span=9, adjust=False).mean(),
            "rsi": 100 - 100 / (1 + gain / loss),
            "atr": ranges.rolling(14).mean(),
            "obv": (frame.volume * np.where(frame.close > previous, 1, -1)).cumsum(),
            "volume": frame.volume,
        }
    )
    out = out.ffill().bfill()
    for name in TECHNICAL:
        for step in range(1, 6):
            out[f"{name}_lag_{step}"] = out[name].shift(step)
    out = out.dropna()
    out = (out - out.min()) / (out.max() - out.min())
    out["target"] = (frame.close.shift(-1) > frame.close).astype(int)
    return out


def test_technical_table_equals_pandas_for_any_grouping(spark, small_groups):
    values = walk(2600, seed=3)
    values[0] = values[40] = values[41] = None
    volume = [float(v) for v in np.random.default_rng(4).integers(1, 1000, 2600)]
    bars = bars_frame(spark, values, volume=volume, start="2010-01-01").orderBy(F.rand(5)).repartition(7)
    got = technical_features(bars).orderBy("date").toPandas()
    want = pandas_technical(values, volume)
    assert len(got) == len(want) == 2595
    assert np.allclose(got[TECHNICAL + LAGS].to_numpy(float), want[TECHNICAL + LAGS].to_numpy(float), atol=1e-9)
    assert got["target"].tolist() == want["target"].tolist()


def test_leak_free_table_never_looks_ahead(spark):
    values = walk(80, seed=5)
    whole = technical_features(bars_frame(spark, values), leak_free=True, scale=False).orderBy("date").toPandas()
    part = technical_features(bars_frame(spark, values[:60]), leak_free=True, scale=False).orderBy("date").toPandas()
    features = TECHNICAL + LAGS
    assert len(part) == 60 - 18
    assert np.allclose(whole[features].to_numpy(float)[: len(part)], part[features].to_numpy(float))


def test_significant_volume(spark):
    volume = [10.0] * 30 + [100.0]
    got = scaling.significant_volume(bars_frame(spark, [1.0] * 31, volume=volume)).collect()
    limit = np.mean(volume) + 2 * np.std(volume, ddof=1)
    assert [row["volume"] for row in got] == [100.0]
    assert abs(got[0]["threshold"] - limit) < 1e-9


def test_impute_mean_can_be_fitted_on_some_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 10.0)], "n int, x double")
    assert [r.x for r in scaling.impute_mean(df, ["x"]).orderBy("n").collect()] == [2.0, 6.0, 10.0]
    assert [r.x for r in scaling.impute_mean(df, ["x"], fit_on=F.col("n") < 3).orderBy("n").collect()] == [2.0, 2.0, 10.0]


def test_target_of_a_missing_close_is_zero(spark):
    assert by_date(indicators.target_label(bars_frame(spark, [1.0, None, 3.0, 4.0])), "target") == [0, 0, 1, 0]


def test_test_rows_do_not_change_scaled_training_rows(spark):
    values = [10.0 + (i * 7) % 13 for i in range(90)]
    changed = values[:60] + [v * 50 for v in values[60:]]
    tables = []
    for closes in (values, changed):
        got = technical_features(bars_frame(spark, closes), leak_free=True, train_until="2024-03-01").orderBy("date").toPandas()
        tables.append(got[got.date < pd.Timestamp("2024-02-28").date()].reset_index(drop=True))
    assert len(tables[0]) > 20
    pd.testing.assert_frame_equal(*tables)
    assert tables[0][["macd", "rsi"]].max().max() <= 1.0 and tables[0]["macd"].max() > 0.5


def test_rows_without_a_place_are_an_error(spark):
    bars = bars_frame(spark, [1.0, 2.0]).withColumn("date", F.when(F.col("close") > 1, F.col("date")))
    with pytest.raises(Exception, match="no ticker or no date"):
        series.fill_gaps(bars, ["close"]).collect()


def test_far_apart_spans_are_averaged_too(spark):
    closes = walk(700)
    got = indicators.ema(bars_frame(spark, closes), [200, 2, 3]).orderBy("date").toPandas()
    for span in (2, 3, 200):
        want = pd.Series(closes).ewm(span=span, adjust=False).mean()
        np.testing.assert_allclose(got[f"ema_{span}"], want, rtol=1e-10)
    assert len(series.span_groups([2, 3, 200])) == 2
