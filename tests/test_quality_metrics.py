import random

import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from marketsense.operators import folds, metrics, quality

COLUMNS = "ticker string, created_date string, author string, body string, score string, id string"


def checks(df, start="2020-01-01", end="2020-12-31"):
    return {r.check_name: (r.value, r.severity) for r in quality.validate_mentions(df, start, end).collect()}


def good(i, **changes):
    row = {"ticker": "T", "created_date": f"2020-06-{i:02d} 10:00:00", "author": "a", "body": "b", "score": "1", "id": str(i)}
    return tuple((row | changes).values())


def test_every_defect_is_counted(spark):
    rows = [
        good(1), good(2, created_date="soon"), good(3, created_date=None), good(4, score="-1"), good(5, score="many"),
        good(6, id="1"), good(7, id=None), good(8, id=None), good(9, body="x" * 1001), good(10, body="x" * 1000), good(11, body=None),
    ]
    got = checks(spark.createDataFrame(rows, COLUMNS))
    want = {
        "records": 11, "invalid_dates": 2, "invalid_date_percent": 200 / 11, "missing_columns": 0, "extra_columns": 0,
        "invalid_scores": 1, "fractional_scores": 0, "null_created_date": 0, "null_body": 1, "null_score": 1, "null_id": 2,
        "duplicate_ids": 2, "bad_bounds": 0, "starts_late": 1, "ends_early": 1, "negative_scores": 1, "long_bodies": 1, "failed": 0,
    }
    assert {k: v for k, (v, _) in got.items()} == pytest.approx(want)
    assert got["null_id"][1] == "warn" and got["failed"][1] == "info"


@pytest.mark.parametrize("change", ["column", "fraction", "bounds"])
def test_only_these_fail(spark, change):
    df = spark.createDataFrame([good(1), good(2, score="2.5" if change == "fraction" else "2.0")], COLUMNS)
    df = df.drop("author") if change == "column" else df.withColumn("more", F.lit(1))
    got = checks(df, "soon" if change == "bounds" else "2020-06-01")
    assert got["failed"] == (1.0, "fail")
    assert checks(spark.createDataFrame([good(1)], COLUMNS))["failed"] == (0.0, "info")


def test_bad_date_samples_are_limited(spark):
    rows = [good(i, created_date=f"bad {i}") for i in range(1, 9)]
    assert quality.bad_date_samples(spark.createDataFrame(rows, COLUMNS)).count() == 5


def test_profile_and_coverage(spark):
    lines = ['{"created_utc": 1600000000}', '{"created_utc": "1500000000.5"}', '{"created_utc": 0}', "{}", "", "  ", "{x", "[1]", '{"created_utc": null}']
    df = spark.createDataFrame([("f", v) for v in lines] + [("g", "")], "source_file string, value string")
    got = {r.source: r for r in quality.profile_source(df).collect()}
    f = got["f"]
    assert (f.earliest, f.latest, f.total_lines, f.processed_lines, f.error_lines) == (1500000000.5, 1600000000.0, 9, 2, 3)
    profiles = quality.profile_source(df)
    assert quality.coverage_check(profiles, "2018-01-01", "2020-01-01").first().coverage == "covered"
    assert quality.coverage_check(profiles, "2015-01-01", "2020-01-01").first().coverage == "not covered"
    assert quality.coverage_check(profiles.where("source = 'g'"), "2015-01-01", "2020-01-01").first().coverage == "undetermined"


def scored_rows(n=400, seed=1, kinds=37):
    rng = random.Random(seed)
    return [(rng.randint(0, 1), rng.randint(0, kinds) / kinds - 0.3, rng.randint(0, 1)) for _ in range(n)]


def test_auc_is_exact_and_antisymmetric(spark):
    df = spark.createDataFrame(scored_rows(), "label int, score double, prediction int")
    auc = metrics.roc_auc(df).first().roc_auc
    assert auc == pytest.approx(1 - metrics.roc_auc(df.withColumn("score", -F.col("score"))).first().roc_auc)
    frame = df.toPandas()
    ranks, p = frame.score.rank(), frame.label.sum()
    assert auc == pytest.approx((ranks[frame.label == 1].sum() - p * (p + 1) / 2) / (p * (len(frame) - p)))
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    assert auc == pytest.approx(evaluator.evaluate(df.withColumn("label", F.col("label").cast("double"))))


def test_auc_of_one_class_is_null(spark):
    assert metrics.roc_auc(spark.createDataFrame([(1, 0.5, 1)], "label int, score double, prediction int")).first().roc_auc is None


def test_cumulative_counts_of_crowded_scores(spark):
    rows = [(i % 2, 0.5 + i * 1e-13, 0) for i in range(300)] + [(1, 1e9, 1), (0, -1e9, 0)]
    df = spark.createDataFrame(rows, "label int, score double, prediction int")
    got = metrics.cumulative_counts(df).orderBy(F.desc("score")).toPandas()
    assert got.cum_pos.tolist() == got.pos.cumsum().tolist()
    assert got.cum_neg.tolist() == got.neg.cumsum().tolist()


def test_no_range_holds_many_scores(spark):
    crowded = spark.range(20_000).select((F.col("id") * 1e-9 + 0.5).alias("score")).union(spark.createDataFrame([(1e9,), (-1e9,)], "score double"))
    sizes = [r["count"] for r in metrics.score_ranges(crowded, 64).groupBy("_range").count().collect()]
    assert sum(sizes) == 20_002 and max(sizes) <= 2 * 20_002 / 64
    assert metrics.cumulative_counts(spark.createDataFrame([], "label int, score double, prediction int")).collect() == []


def test_zero_denominators_are_zero(spark):
    df = spark.createDataFrame([(1, 0.1, 0), (0, 0.2, 0)], "label int, score double, prediction int")
    report = {r.row_name: r for r in metrics.classification_report(df).collect()}
    assert (report["1"].precision, report["1"].recall, report["1"].f1) == (0.0, 0.0, 0.0)
    assert report["accuracy"].f1 == 0.5


def series_frame(spark):
    days = pd.date_range("2020-01-01", periods=13)
    rows = [(t, d.date()) for t in ("B", "A") for d in days]
    return spark.createDataFrame(rows, "ticker string, date date").orderBy(F.rand(3))


def test_positions_and_split(spark, small_groups):
    got = folds.train_test_split(series_frame(spark)).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(26))
    assert [(r.ticker, r.date) for r in got] == sorted((r.ticker, r.date) for r in got)
    assert [r.split for r in got] == ["train"] * 20 + ["test"] * 6
    by_date = folds.train_test_split(series_frame(spark), by="date").orderBy("pos").collect()
    assert [(r.date, r.ticker) for r in by_date] == sorted((r.date, r.ticker) for r in by_date)
    ranked = folds.global_positions(series_frame(spark).withColumn("ord", F.when(F.col("ticker") == "B", 0).otherwise(1)), rank="ord")
    assert ranked.orderBy("pos").first().ticker == "B"


def test_expanding_folds(spark):
    rows = folds.time_series_folds(folds.global_positions(series_frame(spark))).collect()
    for fold in range(1, 6):
        train = sorted(r.pos for r in rows if r.fold == fold and r.role == "train")
        test = sorted(r.pos for r in rows if r.fold == fold and r.role == "test")
        first = 26 - (6 - fold) * 4
        assert train == list(range(first)) and test == list(range(first, first + 4))
