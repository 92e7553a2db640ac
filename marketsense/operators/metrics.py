"""Classifier metrics from (label, score, prediction) rows, all relational and exact."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from marketsense.session import stage

RANGES = 1024


def confusion_matrix(scored: DataFrame) -> DataFrame:
    return scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def _outcomes(scored: DataFrame, *by: str) -> DataFrame:
    label, prediction = F.col("label") == 1, F.col("prediction") == 1
    return scored.groupBy(*by).agg(
        F.count_if(label & prediction).alias("tp"),
        F.count_if(~label & prediction).alias("fp"),
        F.count_if(label & ~prediction).alias("fn"),
        F.count_if(~label & ~prediction).alias("tn"),
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))


def _prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [_ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn)]


def classification_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and averages."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    negative, positive = _prf(tn, fn, fp), _prf(tp, fp, fn)
    n0, n1 = tn + fp, tp + fn
    total, accuracy = n0 + n1, _ratio(tp + tn, tp + tn + fp + fn)
    rows = {
        "0": (negative, n0),
        "1": (positive, n1),
        "accuracy": ([accuracy] * 3, total),
        "macro avg": ([(a + b) / 2 for a, b in zip(negative, positive)], total),
        "weighted avg": ([_ratio(a * n0 + b * n1, total) for a, b in zip(negative, positive)], total),
    }
    report = F.array(
        *[
            F.struct(
                F.lit(name).alias("row_name"),
                values[0].alias("precision"),
                values[1].alias("recall"),
                values[2].alias("f1"),
                support.alias("support"),
            )
            for name, (values, support) in rows.items()
        ]
    )
    return _outcomes(scored).select(F.inline(report))


def precision_recall_f1(scored: DataFrame, *by: str) -> DataFrame:
    """Metrics of class 1, optionally per group."""
    values = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return _outcomes(scored, *by).select(*by, *[v.alias(n) for v, n in zip(values, ("precision", "recall", "f1"))])


def score_ranges(counts: DataFrame, ranges: int = RANGES) -> DataFrame:
    """``counts`` with ``_range``: its place among at most ``ranges`` ranges that hold about as many scores each.

    The cuts are approximate quantiles, so crowded scores and outliers do not matter.
    """
    shares = [k / ranges for k in range(1, ranges)]
    cuts = counts.agg(F.percentile_approx("score", shares, 20 * ranges)).first()[0] or []
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) < 3:
        return counts.withColumn("_range", F.lit(0.0))
    return Bucketizer(splits=splits, inputCol="score", outputCol="_range").transform(counts)


def cumulative_counts(scored: DataFrame) -> DataFrame:
    """Per distinct score the positives and negatives at or above it; null scores take no part.

    Ties collapse first and are staged.  The running totals then go through ranges of
    about equally many scores, so no task sorts more than one range and the only window
    without a partition covers one row per range.
    """
    counts = scored.where(F.col("score").isNotNull()).groupBy(F.col("score").cast("double").alias("score")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    counts = score_ranges(stage(counts, "ties"))
    by_range = Window.orderBy(F.desc("_range"))
    everything = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = counts.groupBy("_range").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    totals = totals.select(
        "_range",
        _above("pos", by_range).alias("_pos"),
        _above("neg", by_range).alias("_neg"),
        F.sum("pos").over(everything).alias("total_pos"),
        F.sum("neg").over(everything).alias("total_neg"),
    )
    inside = Window.partitionBy("_range").orderBy(F.desc("score"))
    # At most RANGES rows are broadcast.
    return counts.join(F.broadcast(totals), "_range").select(
        "score",
        "pos",
        "neg",
        (F.col("_pos") + _above("pos", inside) + F.col("pos")).alias("cum_pos"),
        (F.col("_neg") + _above("neg", inside) + F.col("neg")).alias("cum_neg"),
        "total_pos",
        "total_neg",
    )


def _above(name: str, ordered) -> Column:
    return F.coalesce(F.sum(name).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve; ties count half.  Null when a class is missing."""
    rows = cumulative_counts(scored)
    wins = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") + F.col("pos") / 2.0))
    pairs = F.max("total_pos").cast("double") * F.max("total_neg")
    return rows.agg(F.try_divide(wins, pairs).alias("roc_auc"))


def _with_end_point(rows: DataFrame, **end: float) -> DataFrame:
    point = rows.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), *[F.lit(v).alias(n) for n, v in end.items()]
    )
    return rows.unionByName(point)


def roc_curve(scored: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, and the start (0, 0) with a null threshold."""
    rows = cumulative_counts(scored).select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("cum_neg").cast("double"), F.col("total_neg")).alias("fpr"),
        F.try_divide(F.col("cum_pos").cast("double"), F.col("total_pos")).alias("tpr"),
    )
    return _with_end_point(rows, fpr=0.0, tpr=0.0)


def pr_curve(scored: DataFrame) -> DataFrame:
    """(threshold, precision, recall) at every distinct score, and the end (1, 0)."""
    rows = cumulative_counts(scored).select(
        F.col("score").alias("threshold"),
        _ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        F.try_divide(F.col("cum_pos").cast("double"), F.col("total_pos")).alias("recall"),
    )
    return _with_end_point(rows, precision=1.0, recall=0.0)


def cv_summary(fold_scores: DataFrame) -> DataFrame:
    """Mean and population deviation per metric over rows (fold, metric, value)."""
    return fold_scores.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def melt(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.unpivot(keys, names, "metric", "value")
