"""Tree ensembles scored at several sizes in one pass: a model of 200 trees also tells what its first 100 say."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketsense.session import release, staged_path

TREE = "treeID int, nodeData struct<id: int, prediction: double, impurityStats: array<double>, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>>>"


class FlatTrees:
    """The trees of an ensemble as flat arrays, one entry a node; a leaf has feature -1, children are places in the arrays."""

    def __init__(self, nodes: pd.DataFrame, weights: Sequence[float], boosted: bool):
        """``nodes``: tree, id, feature, threshold, left, right, value; sorted by tree, then id, which counts from 0."""
        self.weights, self.boosted = np.asarray(weights, float), boosted
        self.roots = np.searchsorted(nodes.tree.to_numpy(), np.arange(len(self.weights)))
        base = self.roots[nodes.tree.to_numpy()]
        self.feature, self.threshold, self.value = (nodes[name].to_numpy() for name in ("feature", "threshold", "value"))
        self.left, self.right = base + nodes.left.to_numpy(), base + nodes.right.to_numpy()

    def scores(self, x: np.ndarray, sizes: Sequence[int]) -> list[np.ndarray]:
        """The score for class 1 by the first trees only, for each of the (ascending) sizes."""
        total, found, wanted = np.zeros(len(x)), [], set(sizes)
        rows = np.arange(len(x))
        for tree, (root, weight) in enumerate(zip(self.roots, self.weights), 1):
            at = np.full(len(x), root)
            open_ = rows if self.feature[root] >= 0 else rows[:0]
            while len(open_):
                node = at[open_]
                low = x[open_, self.feature[node]] <= self.threshold[node]
                at[open_] = np.where(low, self.left[node], self.right[node])
                open_ = open_[self.feature[at[open_]] >= 0]
            total += weight * self.value[at]
            if tree in wanted:
                found.append(1 / (1 + np.exp(-2 * total)) if self.boosted else total / tree)
        return found


def flat_trees(spark: SparkSession, model: Model) -> FlatTrees:
    """The trees of a fitted forest or boosted classifier, from the node table that Spark saves; as large as the model itself."""
    path = staged_path(spark, "trees")
    model.write().overwrite().save(path)
    node, stats = F.col("nodeData"), F.col("nodeData.impurityStats")
    boosted = "GBT" in type(model).__name__
    share = F.try_divide(stats[1], F.aggregate(stats, F.lit(0.0), lambda a, b: a + b))
    saved = spark.read.schema(TREE).parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("id"), node["split"]["featureIndex"].alias("feature"),
        F.coalesce(F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)), F.lit(0.0)).alias("threshold"),
        node["leftChild"].alias("left"), node["rightChild"].alias("right"), (node["prediction"] if boosted else F.coalesce(share, F.lit(0.0))).alias("value"),
    )
    nodes = saved.toPandas().sort_values(["tree", "id"], ignore_index=True)
    release(spark, [f"{path}/data"])
    return FlatTrees(nodes, model.treeWeights, boosted)


def score_sizes(trees: FlatTrees, rows: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """label and ``score_<size>`` of assembled rows (label, features), all sizes in one pass."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    sizes = sorted(set(sizes))
    names = [f"score_{size}" for size in sizes]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["x"].tolist(), float).reshape(len(batch), -1)
            yield pd.DataFrame({"label": batch["label"], **dict(zip(names, shared.value.scores(x, sizes)))})

    return rows.select("label", vector_to_array("features").alias("x")).mapInPandas(score, ", ".join(["label double", *[f"{name} double" for name in names]]))
