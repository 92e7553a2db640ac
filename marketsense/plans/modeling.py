"""Training, grid search, cross validation and evaluation with Spark ML."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketsense.operators import folds, metrics
from marketsense.operators.sampling import smote
from marketsense.operators.scaling import impute_mean
from marketsense.schemas import MODEL_FEATURES
from marketsense.plans.prefixes import flat_trees, score_sizes
from marketsense.session import join_path, release, shared_folder, stage, staged_since

log = logging.getLogger(__name__)

SEED = 42

# The search grids.  Trees deeper than 30 are not possible here,
# so "no limit" becomes 30, and there is no minimum node size for a split.
FOREST_GRID = {
    "numTrees": [100, 200],
    "maxDepth": [30, 10, 20],
    "minInstancesPerNode": [1, 2],
    "bootstrap": [True, False],
}
BOOSTED_GRID = {
    "maxIter": [100, 200],
    "stepSize": [0.01, 0.05],
    "maxDepth": [3, 5],
    "subsamplingRate": [0.6, 0.8],
    "featureSubsetStrategy": ["0.6", "0.8"],
}


def model_table(merged: DataFrame, by: str = "ticker") -> DataFrame:
    """Features as doubles, ``label``, position and split; written once because fits read it often."""
    rows = folds.train_test_split(merged, by=by)
    features = [F.col(name).cast("double").alias(name) for name in MODEL_FEATURES]
    return stage(
        rows.select("ticker", "date", *features, F.col("target").cast("double").alias("label"), "pos", "total", "split"),
        "model",
    )


def preprocess_features(rows: DataFrame, features: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """Opt-in preparation: mean imputation, rows still incomplete dropped, classes balanced.

    ``rows`` has ``pos`` and ``label``; returns (id, label, features array), the
    id being null on synthetic rows.
    """
    features = features or MODEL_FEATURES
    complete = impute_mean(rows, features).dropna("any", subset=features)
    prepared = complete.select(
        F.col("pos").alias("id"), F.col("label").cast("int").alias("label"), F.array(*features).alias("features")
    )
    return smote(stage(prepared, "prepared"), seed=seed)


def feature_stages(features: list[str]) -> list:
    """Mean imputation, fitted on the rows a model trains on, and assembly."""
    filled = [f"{name}_filled" for name in features]
    return [
        Imputer(strategy="mean", inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep"),
    ]


def forest(**params) -> RandomForestClassifier:
    return RandomForestClassifier(seed=SEED, **params)


def boosted(**params) -> GBTClassifier:
    return GBTClassifier(seed=SEED, **params)


def expanding_folds(rows: DataFrame, n_folds: int) -> list[tuple[DataFrame, DataFrame]]:
    """(rows to fit on, rows to test on) of each fold; a fold trains on earlier rows only (column ``pos``)."""
    total, parts = rows.count(), []
    for fold in range(1, n_folds + 1):
        first, end = folds.fold_bounds(total, fold, n_folds)
        parts.append((rows.where(F.col("pos") < first), rows.where((F.col("pos") >= first) & (F.col("pos") < end))))
    return parts


def exact_auc(column: str = "rawPrediction") -> BinaryClassificationEvaluator:
    return BinaryClassificationEvaluator(rawPredictionCol=column, metricName="areaUnderROC", numBins=0)


@dataclass
class GridSearch:
    points: list[dict]
    aucs: list[list[float]]  # of each point, by fold
    bestModel: PipelineModel


def grid_search(classifier, grid: dict, train: DataFrame, features: list[str], n_folds: int, parallelism: int = 8) -> GridSearch:
    """Score every grid point on every fold, refit the best mean AUC on all of ``train``.

    Points that differ in the number of trees only share a fit: the smaller model is
    read off the larger one's first trees (for boosting they are the same trees; of a
    forest they are a forest).  Imputation is fitted once per fold, and the assembled rows are written once.
    """
    spark, mark = train.sparkSession, len(staged_since())
    cut_lineage(spark)
    size = "maxIter" if classifier.hasParam("maxIter") else "numTrees"
    sizes = sorted(set(grid.get(size, [classifier.getOrDefault(size)])))
    if sizes[0] < 1:
        raise ValueError(f"{size} must be at least 1")
    others = {name: values for name, values in grid.items() if name != size}
    fits = [dict(zip(others, values)) for values in product(*others.values())]
    parts = []
    for fit_rows, test_rows in expanding_folds(train, n_folds):
        prepared = Pipeline(stages=feature_stages(features)).fit(fit_rows)
        parts.append([stage(prepared.transform(rows).select("label", "features"), "fold") for rows in (fit_rows, test_rows)])

    def fitted(task: tuple[dict, list[DataFrame]]) -> dict[int, float]:
        params, (fit_rows, test_rows) = task
        model = configured(classifier, {**params, size: sizes[-1]}).fit(fit_rows)
        scored = score_sizes(flat_trees(spark, model), test_rows, sizes).persist()
        aucs = {n: exact_auc(f"score_{n}").evaluate(scored) for n in sizes}
        scored.unpersist()
        return aucs

    # Largest folds first, one fit at a time: no thread ends long after the others.
    tasks = [(params, part) for part in reversed(parts) for params in fits]
    with ThreadPool(parallelism) as pool:
        found = pool.map(inheritable_thread_target(spark)(fitted), tasks, chunksize=1)
    by_fit = [found[place :: len(fits)][::-1] for place in range(len(fits))]
    points = [dict(zip(grid, values)) for values in product(*grid.values())]
    aucs = [[fold[point.get(size, sizes[-1])] for fold in by_fit[fits.index({k: v for k, v in point.items() if k != size})]] for point in points]
    means = [sum(folds_) / len(folds_) for folds_ in aucs]
    best = points[means.index(max(means))]
    model = Pipeline(stages=[*feature_stages(features), configured(classifier, best)]).fit(train)
    release(spark, [path for path in staged_since(mark) if path])
    return GridSearch(points, aucs, model)


def cut_lineage(spark: SparkSession) -> None:
    """A folder for the checkpoints of long fits: without one each boosting step plans all steps before it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(join_path(shared_folder(spark), "marketsense", "checkpoints"))


def configured(classifier, params: dict):
    """A copy of a classifier with some parameters set by name."""
    return classifier.copy({classifier.getParam(name): value for name, value in params.items()})


def grid_results(search: GridSearch) -> DataFrame:
    """One row per grid point: parameters, mean and deviation of the AUC, rank."""
    rows = []
    for point, aucs in zip(search.points, search.aucs):
        rows.append((", ".join(f"{name}={value}" for name, value in sorted(point.items())), float(np.mean(aucs)), float(np.std(aucs))))
    # Of equal means the first was refitted.
    means = [mean for _, mean, _ in rows]
    rows = [(*row, place == means.index(max(means))) for place, row in enumerate(rows)]
    return SparkSession.active().createDataFrame(rows, "params string, mean_auc double, std_auc double, best boolean")


def train_random_forest(table: DataFrame, grid: dict | None = None, n_folds: int = folds.N_FOLDS, features=None) -> GridSearch:
    """The nodes that rows have reached are kept: a level of deep trees then needs no walk from the roots, nor the trees in its tasks."""
    train = table.where("split = 'train'")
    return grid_search(forest(cacheNodeIds=True, maxMemoryInMB=128), grid or FOREST_GRID, train, features or MODEL_FEATURES, n_folds)


def train_gbt(table: DataFrame, grid: dict | None = None, n_folds: int = folds.N_FOLDS, features=None) -> GridSearch:
    train = table.where("split = 'train'")
    return grid_search(boosted(), grid or BOOSTED_GRID, train, features or MODEL_FEATURES, n_folds)


def predictions(model: Model, rows: DataFrame) -> DataFrame:
    """label, score (probability of class 1), prediction."""
    return model.transform(rows).select(
        "label", vector_to_array("probability")[1].alias("score"), F.col("prediction").cast("int").alias("prediction")
    )


def evaluate_model(model: Model, test: DataFrame, name: str = "model") -> DataFrame:
    """AUC, precision, recall, F1 and support of a fitted model on held-out rows."""
    scored = stage(predictions(model, test), "scored")
    prf = metrics.melt(metrics.precision_recall_f1(scored).withColumn("model", F.lit(name)), ["model"], ["precision", "recall", "f1"])
    auc = metrics.roc_auc(scored).select(F.lit(name).alias("model"), F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value"))
    return auc.unionByName(prf)


def cross_validate(
    estimator_params: dict, kind: str, table: DataFrame, n_folds: int = folds.N_FOLDS, features=None, parallelism: int = 8
) -> DataFrame:
    """(fold, metric, value) of one parameter set on the expanding folds, which are fitted side by side."""
    features, spark = features or MODEL_FEATURES, table.sparkSession
    classifier = {"forest": forest, "boosted": boosted}[kind](**estimator_params)
    train = table.where("split = 'train'")

    def validated(task: tuple[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
        fold, (fit_rows, test_rows) = task
        model = Pipeline(stages=[*feature_stages(features), classifier]).fit(fit_rows)
        return evaluate_model(model, test_rows, kind).select(F.lit(fold).alias("fold"), "metric", "value")

    with ThreadPool(parallelism) as pool:
        results = pool.map(inheritable_thread_target(spark)(validated), list(enumerate(expanding_folds(train, n_folds), start=1)), chunksize=1)
    result = results[0]
    for more in results[1:]:
        result = result.unionByName(more)
    return result


def feature_importance(model: PipelineModel, features: list[str] | None = None, top: int = 10) -> DataFrame:
    """The ``top`` features by impurity importance."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = list(zip(features or MODEL_FEATURES, map(float, weights)))
    frame = SparkSession.active().createDataFrame(rows, "feature string, importance double")
    return frame.orderBy(F.desc("importance"), "feature").limit(top)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def train_pipeline(
    merged: DataFrame, grids: dict[str, dict] | None = None, n_folds: int = folds.N_FOLDS, save_to: str | None = None, by: str = "ticker"
) -> DataFrame:
    """Search, evaluate and optionally save both models; one failing does not stop the other.

    Rows: model, status, metric, value.
    """
    grids = grids or {"random_forest": FOREST_GRID, "boosted_trees": BOOSTED_GRID}
    trainers = {"random_forest": train_random_forest, "boosted_trees": train_gbt}
    table = model_table(merged, by)
    results = []
    for name, grid in grids.items():
        try:
            best = trainers[name](table, grid, n_folds).bestModel
            rows = evaluate_model(best, table.where("split = 'test'"), name)
            if save_to:
                try:
                    save_model(best, f"{save_to.rstrip('/')}/{name}")
                except Exception:  # the model is good all the same
                    log.exception("model %s could not be saved", name)
            results.append(rows.select("model", F.lit("ok").alias("status"), "metric", "value"))
        except Exception as error:  # isolate the models from one another
            log.exception("model %s failed", name)
            failed = [(name, f"failed: {type(error).__name__}", None, None)]
            results.append(merged.sparkSession.createDataFrame(failed, "model string, status string, metric string, value double"))
    result = results[0]
    for more in results[1:]:
        result = result.unionByName(more)
    return result


