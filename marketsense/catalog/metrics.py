"""Splits, folds and classifier metrics on fixed scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketsense import fixtures
from marketsense.catalog.prices import rounded
from marketsense.operators import folds, metrics


def _scored(spark, sf):
    return fixtures.table(spark, sf, "scored")


def _positions(spark, sf):
    return folds.global_positions(fixtures.table(spark, sf, "bars").select("ticker", "date"))


def _summary(spark, sf):
    rows = _scored(spark, sf).withColumn("fold", F.col("id") % 5)
    names = ["precision", "recall", "f1"]
    per_fold = metrics.precision_recall_f1(rows, "fold")
    return rounded(metrics.cv_summary(metrics.melt(per_fold, ["fold"], names)), 9, "mean", "std")


QUERIES = {
    "train_test_split": lambda s, d: folds.train_test_split(
        fixtures.table(s, d, "bars").select("ticker", "date")
    ).drop("total"),
    "train_test_split_by_date": lambda s, d: folds.train_test_split(
        fixtures.table(s, d, "bars").select("ticker", "date"), by="date"
    ).drop("total"),
    "time_series_folds": lambda s, d: folds.time_series_folds(_positions(s, d)).drop("total"),
    "confusion_matrix": lambda s, d: metrics.confusion_matrix(_scored(s, d)),
    "classification_report": lambda s, d: rounded(
        metrics.classification_report(_scored(s, d)), 9, "precision", "recall", "f1"
    ),
    "roc_auc": lambda s, d: rounded(metrics.roc_auc(_scored(s, d)), 9, "roc_auc"),
    "roc_curve": lambda s, d: rounded(metrics.roc_curve(_scored(s, d)), 9, "threshold", "fpr", "tpr"),
    "pr_curve": lambda s, d: rounded(metrics.pr_curve(_scored(s, d)), 9, "threshold", "precision", "recall"),
    "cv_summary": _summary,
}


def _placed(order: str) -> str:
    return f"""{fixtures.ctes("bars")}, placed as (select ticker, date, row_number() over (order by {order}) - 1 as pos, count(*) over () as n from bars)"""


_OUTCOMES = """select count(*) filter (where label = 1 and prediction = 1)::double as tp, count(*) filter (where label = 0 and prediction = 1)::double as fp,
count(*) filter (where label = 1 and prediction = 0)::double as fn, count(*) filter (where label = 0 and prediction = 0)::double as tn"""

_CUMULATIVE = f"""{fixtures.ctes("scored")},
per_score as (select score, sum(label)::double as pos, sum(1 - label)::double as neg from scored group by score),
cum as (select score, pos, neg, sum(pos) over w as cp, sum(neg) over w as cn, sum(pos) over () as p, sum(neg) over () as n
        from per_score window w as (order by score desc rows unbounded preceding))"""

_REPORT = f"""{fixtures.ctes("scored")}, o as ({_OUTCOMES} from scored),
c as (select '0' as k, coalesce(tn / nullif(tn + fn, 0), 0) as p, coalesce(tn / nullif(tn + fp, 0), 0) as r, coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) as f, tn + fp as s from o
      union all select '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0), coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), tp + fn from o),
rows_ as (select * from c union all select 'accuracy', (tp + tn) / (tp + tn + fp + fn), (tp + tn) / (tp + tn + fp + fn), (tp + tn) / (tp + tn + fp + fn), tp + tn + fp + fn from o
      union all select 'macro avg', avg(p), avg(r), avg(f), sum(s) from c
      union all select 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) from c)"""

ORACLES = {
    "train_test_split": f"{_placed('ticker, date')} select ticker, date, pos, case when pos < floor(n * 0.8::double) then 'train' else 'test' end as split from placed",
    "train_test_split_by_date": f"{_placed('date, ticker')} select ticker, date, pos, case when pos < floor(n * 0.8::double) then 'train' else 'test' end as split from placed",
    "time_series_folds": f"""{_placed('ticker, date')} select ticker, date, pos, fold, case when pos < n - (6 - fold) * (n // 6) then 'train' else 'test' end as role
from placed, (values (1), (2), (3), (4), (5)) f(fold) where pos < n - (5 - fold) * (n // 6)""",
    "confusion_matrix": f"{fixtures.ctes('scored')} select label, prediction, count(*) as n from scored group by all",
    "classification_report": f"{_REPORT} select k as row_name, round(p, 9) as precision, round(r, 9) as recall, round(f, 9) as f1, s::bigint as support from rows_",
    "roc_auc": f"{_CUMULATIVE} select round(sum(neg * (cp - pos + pos / 2)) / (any_value(p) * any_value(n)), 9) as roc_auc from cum",
    "roc_curve": f"{_CUMULATIVE} select round(score, 9) as threshold, round(cn / n, 9) as fpr, round(cp / p, 9) as tpr from cum union all select null, 0, 0",
    "pr_curve": f"{_CUMULATIVE} select round(score, 9) as threshold, round(cp / (cp + cn), 9) as precision, round(cp / p, 9) as recall from cum union all select null, 1, 0",
    "cv_summary": f"""{fixtures.ctes("scored")}, o as (select fold, o.* from (select distinct id % 5 as fold from scored) f, lateral ({_OUTCOMES} from scored where id % 5 = f.fold) o),
m as (select coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1 from o),
long_ as (select 'precision' as metric, precision as value from m union all select 'recall', recall from m union all select 'f1', f1 from m)
select metric, round(avg(value), 9) as mean, round(stddev_pop(value), 9) as std from long_ group by metric""",
}
