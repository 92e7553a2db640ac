"""Model training on the merged table.

All folds and every axis of the grids are searched.  ``train_pipeline`` searches
the whole grids; in the other queries only the trees are few, so that they finish
on a test machine.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marketsense import fixtures
from marketsense.operators import sampling
from marketsense.plans import modeling
from marketsense.plans.merged import merged_features

FOREST = {**modeling.FOREST_GRID, "numTrees": [2, 3]}
BOOSTED = {**modeling.BOOSTED_GRID, "maxIter": [1, 2]}


def _merged(spark, sf):
    return merged_features(fixtures.table(spark, sf, "bars"), fixtures.table(spark, sf, "mentions"))


def _table(spark, sf):
    return modeling.model_table(_merged(spark, sf))


def _evaluated(spark, sf):
    table = _table(spark, sf)
    best = modeling.train_random_forest(table, {"numTrees": [5], "maxDepth": [4]}).bestModel
    return modeling.evaluate_model(best, table.where("split = 'test'"), "random_forest")


def _balanced(spark, sf):
    scored = fixtures.table(spark, sf, "scored")
    rows = scored.join(fixtures.table(spark, sf, "documents"), scored.id == F.col("doc_id")).select(
        "id", "label", F.array(F.col("score"), F.length("text").cast("double"), F.sqrt(F.col("id"))).alias("features")
    )
    return sampling.smote(rows)


def _smote_counts(spark, sf):
    return _balanced(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))


def _smote_sums(spark, sf):
    sums = [F.round(F.sum(F.col("features")[place]), 2).alias(f"sum_{place}") for place in range(3)]
    return _balanced(spark, sf).groupBy("label", F.col("id").isNull().alias("made")).agg(F.count(F.lit(1)).alias("n_rows"), *sums)


QUERIES = {
    "smote_counts": _smote_counts,
    "smote_sums": _smote_sums,
    "train_random_forest": lambda s, d: modeling.grid_results(modeling.train_random_forest(_table(s, d), FOREST)),
    "train_gbt": lambda s, d: modeling.grid_results(modeling.train_gbt(_table(s, d), BOOSTED)),
    "grid_search_cv": lambda s, d: modeling.grid_results(
        modeling.train_random_forest(_table(s, d), {**FOREST, "maxDepth": [3, 5]})
    ),
    "cross_validate": lambda s, d: modeling.cross_validate({"numTrees": 5, "maxDepth": 3}, "forest", _table(s, d)),
    "evaluate_model": _evaluated,
    "feature_importance": lambda s, d: modeling.feature_importance(
        modeling.train_random_forest(_table(s, d), {"numTrees": [5], "maxDepth": [4]}).bestModel
    ),
    "train_pipeline": lambda s, d: modeling.train_pipeline(_merged(s, d)),
}

ORACLES = {
    "smote_sums": f"""{fixtures.ctes("scored")},
r as (select id, label, score as f0, cast(length(text) as double) as f1, sqrt(id) as f2 from scored join documents on doc_id = id),
c as (select label, count(*) as n from r group by label),
few as (select label as small, n, (select max(n) from c) - n as missing from c order by n, label limit 1),
points as (select row_number() over (order by md5(cast(id as varchar)), id) - 1 as point, f0, f1, f2 from r, few where label = small),
pairs as (
  select a.point, row_number() over (
           partition by a.point
           order by (a.f0 - b.f0) * (a.f0 - b.f0) + (a.f1 - b.f1) * (a.f1 - b.f1) + (a.f2 - b.f2) * (a.f2 - b.f2), b.point) - 1 as place,
         a.f0 as f0, a.f1 as f1, a.f2 as f2, b.f0 as g0, b.f1 as g1, b.f2 as g2
  from points a join points b on a.point <> b.point),
made as (
  select s % n as point, md5(concat(s % n, '-', s // n, '-42')) as h, least(5, n - 1) as reach
  from few, range(cast(few.missing as bigint)) t(s)),
spots as (
  select point, cast('0x' || substr(h, 1, 8) as bigint) % reach as place, cast('0x' || substr(h, 9, 8) as bigint) / cast(4294967296 as double) as share from made),
every as (
  select label, false as made, f0, f1, f2 from r
  union all
  select small, true, f0 + share * (g0 - f0), f1 + share * (g1 - f1), f2 + share * (g2 - f2) from spots join pairs using (point, place), few)
select label, made, count(*) as n_rows, round(sum(f0), 2) as sum_0, round(sum(f1), 2) as sum_1, round(sum(f2), 2) as sum_2 from every group by label, made""",
    "smote_counts": f"""{fixtures.ctes("scored")}, c as (select label, count(*) as n from scored join documents on doc_id = id group by label)
select label, (select max(n) from c) as n_rows from c""",
}
