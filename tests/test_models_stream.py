import json
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketsense.catalog import models
from marketsense.operators import mentions, sampling
from marketsense.plans import modeling, prefixes
from marketsense.schemas import MODEL_FEATURES
from marketsense.streaming import current, live


@pytest.fixture(scope="module")
def merged(spark):
    rng = np.random.default_rng(7)
    frame = pd.DataFrame(rng.normal(size=(240, len(MODEL_FEATURES))), columns=MODEL_FEATURES)
    frame["target"] = (frame["rsi"] + 0.1 * rng.normal(size=240) > 0).astype(int)
    frame.loc[::9, "average_sentiment"] = None
    frame["ticker"] = ["A"] * 120 + ["B"] * 120
    frame["date"] = list(pd.date_range("2020-01-01", periods=120).date) * 2
    return spark.createDataFrame(frame)


def test_training_evaluation_and_persistence(spark, merged, tmp_path):
    table = modeling.model_table(merged)
    search = modeling.train_random_forest(table, {"numTrees": [5], "maxDepth": [1, 4]}, n_folds=2)
    results = modeling.grid_results(search).collect()
    assert len(results) == 2 and sum(r.best for r in results) == 1
    test = table.where("split = 'test'")
    values = {r.metric: r.value for r in modeling.evaluate_model(search.bestModel, test).collect()}
    assert set(values) == {"roc_auc", "precision", "recall", "f1"} and values["roc_auc"] > 0.8
    top = modeling.feature_importance(search.bestModel).collect()
    assert len(top) == 10 and top[0].feature == "rsi"
    modeling.save_model(search.bestModel, str(tmp_path / "m"))
    again = modeling.load_model(str(tmp_path / "m"))
    assert modeling.predictions(again, test).collect() == modeling.predictions(search.bestModel, test).collect()


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_prefixes_of_an_ensemble(spark, merged, kind):
    """All trees give the model's own scores; the first trees of a boosted model are the smaller model."""
    table = modeling.model_table(merged)
    rows = modeling.Pipeline(stages=modeling.feature_stages(MODEL_FEATURES)).fit(table).transform(table).select("pos", "label", "features").coalesce(1).sortWithinPartitions("pos")
    make = {"forest": lambda n: modeling.forest(numTrees=n, maxDepth=4), "boosted": lambda n: modeling.boosted(maxIter=n, maxDepth=3, subsamplingRate=0.8)}[kind]
    model = make(6).fit(rows)
    trees = prefixes.flat_trees(spark, model)
    got = prefixes.score_sizes(trees, rows, [2, 6]).toPandas()
    own = modeling.predictions(model, rows).toPandas()
    np.testing.assert_allclose(got.score_6, own.score, atol=1e-12)
    if kind == "boosted":
        np.testing.assert_allclose(got.score_2, modeling.predictions(make(2).fit(rows), rows).toPandas().score, atol=1e-12)
    else:
        parts = [modeling.predictions(tree, rows).toPandas().score for tree in model.trees[:2]]
        np.testing.assert_allclose(got.score_2, sum(parts) / 2, atol=1e-12)


def test_one_fit_serves_all_sizes(spark, merged, monkeypatch):
    fits = []
    monkeypatch.setattr(modeling, "flat_trees", lambda spark, model: fits.append(len(model.trees)) or prefixes.flat_trees(spark, model))
    search = modeling.train_gbt(modeling.model_table(merged), {"maxIter": [1, 3], "maxDepth": [1, 2]}, n_folds=2)
    results = modeling.grid_results(search).collect()
    assert [r.params for r in results] == ["maxDepth=1, maxIter=1", "maxDepth=2, maxIter=1", "maxDepth=1, maxIter=3", "maxDepth=2, maxIter=3"]
    assert sorted(fits) == [3] * 4 and sum(r.best for r in results) == 1 and all(0 <= r.mean_auc <= 1 for r in results)


def test_preparation_imputes_and_balances(merged):
    table = modeling.model_table(merged)
    out = modeling.preprocess_features(table)
    counts = sampling.class_counts(out)
    assert counts[0] == counts[1]
    assert out.where(F.exists("features", lambda x: x.isNull())).isEmpty()
    assert out.where("id is not null").count() == 240


def test_folds_train_on_the_past_only(merged):
    table = modeling.model_table(merged)
    for fit, held in modeling.expanding_folds(table, 3):
        assert fit.agg(F.max("pos")).first()[0] < held.agg(F.min("pos")).first()[0]


def test_folds_are_fitted_side_by_side(merged, monkeypatch):
    table, meet, evaluate = modeling.model_table(merged), threading.Barrier(2, timeout=60), modeling.evaluate_model
    monkeypatch.setattr(modeling, "evaluate_model", lambda *task: meet.wait() >= 0 and evaluate(*task))
    rows = modeling.cross_validate({"numTrees": 2, "maxDepth": 2}, "forest", table, n_folds=2).collect()
    assert [(r.fold, r.metric) for r in rows] == [(fold, name) for fold in (1, 2) for name in ("roc_auc", "precision", "recall", "f1")]


def test_a_failing_model_does_not_stop_the_other(merged):
    grids = {"random_forest": {"numTrees": [-1]}, "boosted_trees": {"maxIter": [2], "maxDepth": [2]}}
    rows = modeling.train_pipeline(merged, grids, n_folds=2).collect()
    status = {r.model: r.status for r in rows}
    assert status["random_forest"].startswith("failed") and status["boosted_trees"] == "ok"


def test_the_query_searches_the_whole_grids(spark, merged, monkeypatch):
    """No axis of either grid is shortened, no row of the table and no fold left out."""
    searched = []
    monkeypatch.setattr(models, "_merged", lambda spark, folder: merged)
    monkeypatch.setattr(modeling, "grid_search", lambda classifier, grid, train, features, n_folds, *more: searched.append((grid, train.count(), len(features), n_folds)) or 1 / 0)
    assert {r.status for r in models.QUERIES["train_pipeline"](spark, "").collect()} == {"failed: ZeroDivisionError"}
    assert searched == [(modeling.FOREST_GRID, 192, 41, 5), (modeling.BOOSTED_GRID, 192, 41, 5)]
    assert modeling.FOREST_GRID["numTrees"] == modeling.BOOSTED_GRID["maxIter"] == [100, 200]


def brute_neighbours(x, k):
    distance = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(distance, np.inf)
    return np.argsort(distance, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("ring", [4096, 13, 3])
@pytest.mark.parametrize("kind", ["ties", "clusters", "copies"])
def test_neighbours_equal_brute_force(spark, ring, kind):
    rng = np.random.default_rng(3)
    if kind == "ties":
        x = rng.integers(0, 6, size=(60, 3)).astype(float)
    elif kind == "clusters":
        x = rng.normal(size=(6, 4))[rng.integers(0, 6, 200)] * 50 + rng.normal(size=(200, 4))
    else:  # a third of all rows are one vector, some others come twice
        x = np.concatenate([np.full((70, 2), 0.5), rng.integers(0, 12, size=(130, 2)) / 7])
    points = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "point bigint, features array<double>").repartition(5)
    got = sampling.nearest_neighbours(points, k=5, ring=ring).orderBy("point", "place").toPandas()
    assert got.neighbour.to_numpy().reshape(len(x), 5).tolist() == brute_neighbours(x, 5).tolist()


def test_far_rings_are_never_met(spark):
    """Of well parted clusters only rings of the same cluster meet."""
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(20, 3)) * 1000)[np.arange(2000) % 20] + rng.normal(size=(2000, 3))
    distinct = spark.createDataFrame([(i, 1, list(map(float, v))) for i, v in enumerate(x)], "own bigint, copies int, features array<double>")
    rows, bounds, pivots = sampling._rings(distinct, 5, 50)
    rings = bounds.count()
    assert bounds.agg({"n": "max"}).first()[0] <= 50 and rows.count() == 2000
    assert sampling._ring_pairs(bounds, pivots, 5).count() < 0.2 * rings * rings


def test_neighbours_of_few_points(spark):
    make = lambda rows: spark.createDataFrame(rows, "point bigint, features array<double>")
    assert sampling.nearest_neighbours(make([]), 3).collect() == []
    assert sampling.nearest_neighbours(make([(4, [1.0])]), 3).collect() == []
    assert sorted(map(tuple, sampling.nearest_neighbours(make([(4, [1.0]), (9, [2.0])]), 3).collect())) == [(4, 9, 0), (9, 4, 0)]
    with pytest.raises(Exception, match="finite"):
        sampling.nearest_neighbours(make([(4, [1.0]), (9, [float("nan")])]), 3).collect()


def test_two_rows_against_a_million(spark):
    df = spark.range(1_000_002).selectExpr("id", "cast(id >= 2 as int) as label", "array(cast(id as double), 1.0D) as features")
    out = sampling.smote(df).where("id is null")
    found = out.selectExpr("count(*) as n", "min(features[0]) as low", "max(features[0]) as high", "avg(features[0]) as middle", "min(label) as label").first()
    assert (found.n, found.label) == (999_998, 0) and 0 <= found.low < 0.001 < 0.999 < found.high <= 1 and abs(found.middle - 0.5) < 0.01


@pytest.mark.parametrize("small", [2, 7, 45])
def test_smote_balances_with_points_between_neighbours(spark, small):
    rows = [(i, int(i >= small), [float(i % 11), float(i % 7)]) for i in range(small + 50)]
    df = spark.createDataFrame(rows, "id int, label int, features array<double>").repartition(5)
    out = sampling.smote(df)
    assert sampling.class_counts(out) == {0: 50, 1: 50}
    made = [r.features for r in out.where("id is null").collect()]
    x = np.array([r[2] for r in rows if r[1] == 0])
    for point in made:
        assert (x.min(axis=0) <= point).all() and (point <= x.max(axis=0)).all()
    assert sorted(made) == sorted(r.features for r in sampling.smote(df.repartition(2)).where("id is null").collect())


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    texts = ["AAPL is good", "apple is bad", "nothing", "AAPL AAPL scum!"]
    day = 1600041600  # a midnight
    rows = [
        {"id": str(i % 30), "created_utc": day + (i % 30) * 20000, "body": texts[i % 4], "score": i % 30} for i in range(40)
    ]  # the last ten repeat the first ones
    rows = [r | {"body": texts[int(r["id"]) % 4]} for r in rows]
    rows.append({"id": "end", "created_utc": day + 86400 * 300, "body": "AAPL", "score": 0})
    (folder / "a.json").write_text("\n".join(json.dumps(r) for r in rows[:20]) + "\n{broken\n")
    (folder / "b.json").write_text("\n".join(json.dumps(r) for r in rows[20:]))
    span = ("2020-01-01", "2023-12-31")

    def build(lines):
        return current.rollup(current.live_mentions(lines, {"AAPL": "apple"}, *span))

    query = current.start(build(current.read_lines(spark, str(folder), 1)), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert query.exception() is None
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = build(spark.read.text(str(folder))).where("date < '2021-01-01'")
    keep = ["date", "average_sentiment", "mention_count", "ticker", "total_score"]
    assert sorted(map(tuple, streamed.select(keep).collect())) == sorted(map(tuple, batch.select(keep).collect()))
    assert streamed.count() == 7


def test_replayed_threads_equal_the_batch_query(spark, tmp_path):
    """Posts and comments land in three batches, in any order, some comments before their post."""
    rng = np.random.default_rng(11)
    limits = {"a": 5, "b": 2, "c": 50}
    rows = []
    for post in range(60):
        forum = "abcx"[post % 4]
        at = int(rng.integers(0, 30))  # ties on purpose
        rows.append((forum, post, 0, "submission", f"post {post}", f"2024-01-01T00:{at:02d}:00Z", int(rng.integers(-3, 9))))
        for turn in range(1, int(rng.integers(1, 6))):
            rows.append((forum, post, turn, "comment", f"comment {post}/{turn}", f"2024-01-02T00:{turn:02d}:00Z", int(rng.integers(-3, 9))))
    rng.shuffle(rows)
    names = ["subreddit", "post_id", "turn", "type", "body", "created_date", "score"]
    rows = [dict(zip(names, (r[0], int(r[1]), int(r[2]), r[3], r[4], r[5], int(r[6])))) for r in rows]
    folder, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    folder.mkdir()
    for part in range(3):
        # One query per landed batch: the state survives in the checkpoint.
        (folder / f"{part}.json").write_text("\n".join(json.dumps(r) for r in rows[part::3]))
        query = live.start(live.live_threads(live.read_threads(spark, str(folder), 1), limits), out, marks)
        query.awaitTermination(300)
        assert query.exception() is None
    got = live.current_threads(spark.read.parquet(out))
    batch = spark.read.schema(live.THREAD).json(str(folder))
    want = mentions.newest_threads(batch, limits).drop("comments")
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))
    states = spark.read.format("statestore").option("path", marks).option("operatorId", 1).option("stateVarName", "kept").load()
    kept = states.groupBy(F.col("key.subreddit")).count().collect()
    assert {r.subreddit: r["count"] for r in kept} == {"a": 5, "b": 2, "c": 15}
