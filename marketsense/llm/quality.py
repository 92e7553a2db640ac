"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown level by level from gradient histograms of quantile-binned features
and stored as complete binary trees in flat arrays, so a batch of documents goes
through all trees with one array step per level.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketsense.llm.common import fold_of, labelled_texts

PER_CLASS = 6000  # labelled texts per class that the trees are fitted on
KEPT = 0.3
FEATURES = [
    "log_chars", "log_words", "word_length", "word_length_spread", "upper", "digit", "blank", "symbol", "high_byte", "byte_entropy",
    "distinct_words", "top_word", "repeated_next", "log_lines", "repeated_lines", "bare_words", "symbol_ends", "log_longest", "single_chars", "comma_stop",
]
_CLASS = np.full(256, 3)  # symbol
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 0
_CLASS[[ord(c) for c in "0123456789"]] = 1
_CLASS[[9, 10, 11, 12, 13, 32]] = 2
_CLASS[128:] = 4
_CLASS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 5


def statistics(text: str | None) -> list[float]:
    """The numbers ``FEATURES`` names; all 0 for a null or empty text."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=bytes_, minlength=6) / len(raw)
    share = bytes_[bytes_ > 0] / len(raw)
    words = raw.split()
    n = len(words) or 1
    sizes = np.fromiter(map(len, words), np.int64) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    bare = sum(count for word, count in counts.items() if not any(byte >= 128 or chr(byte).isalpha() for byte in word))
    ends = sum(count for word, count in counts.items() if word[-1] < 128 and not chr(word[-1]).isalnum() and word[-1] not in b".,")
    stops = sum(count for word, count in counts.items() if word[-1] in b".,")
    return [
        np.log1p(len(text)), np.log1p(len(words)), sizes.mean(), sizes.std(), kinds[0], kinds[1], kinds[2], kinds[3], kinds[4],
        float(-(share * np.log2(share)).sum()), len(counts) / n, max(counts.values(), default=0) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, np.log1p(len(lines)), 1 - len(set(lines)) / (len(lines) or 1), bare / n, ends / n,
        np.log1p(sizes.max()), float((sizes == 1).mean()), stops / n,
    ]


@dataclass
class Forest:
    """Complete trees of one depth: inner nodes in breadth-first order, leaves left to right."""

    base: float
    feature: np.ndarray  # trees x (2**depth - 1)
    cut: np.ndarray  # go right above this value
    leaf: np.ndarray  # trees x 2**depth
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        node = np.zeros((len(x), len(self.feature)), np.int64)
        tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.cut[tree, node])
        margin = self.base + self.leaf[tree, node - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Forest:
    """Gradient boosting for the logistic loss on weighted rows; without rows every score is 0.5."""
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y):
        return Forest(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), depth)
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(edge, column, side="left") for edge, column in zip(edges, x.T)], axis=1)
    share = np.clip((weight @ y) / weight.sum(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    found = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for tree in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best, where, at = np.full(width, 1e-6), np.zeros(width, np.int64), np.full(width, bins)
            for f, edge in enumerate(edges):
                slot = local * bins + binned[:, f]
                g = np.bincount(slot, slope, width * bins).reshape(width, bins).cumsum(axis=1)
                h = np.bincount(slot, bend, width * bins).reshape(width, bins).cumsum(axis=1)
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
                gain[(h < least) | (h_all - h < least)] = -1
                gain[:, len(edge) :] = -1
                pick = gain.argmax(axis=1)
                better = gain[np.arange(width), pick] > best
                best[better], where[better], at[better] = gain[np.arange(width), pick][better], f, pick[better]
            for j in np.flatnonzero(at < bins):
                found[0][tree, first + j], found[1][tree, first + j] = where[j], edges[where[j]][at[j]]
            node = 2 * node + 1 + (binned[np.arange(len(y)), where[local]] > at[local])
        place = node - inner
        value = -rate * np.bincount(place, slope, leaves) / (np.bincount(place, bend, leaves) + ridge)
        found[2][tree] = value
        margin += value[place]
    return Forest(base, *found, depth)


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, per_class: int = PER_CLASS) -> Forest:
    """Fit on a bounded sample of labelled documents outside the held-out fold; classes keep their weight in the whole."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold_of(F.col("doc_id"), folds) != held))
    whole = {int(row.quality): row["count"] for row in known.groupBy(F.col("quality").cast("int").alias("quality")).count().limit(500).collect()}

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "x": [statistics(text) for text in batch["text"]]})

    rows = labelled_texts(docs, labels, "quality", folds, held, per_class).select("label", "text").mapInPandas(measure, "label int, x array<double>").collect()
    rows.sort(key=lambda row: (row.label, row.x))
    y = np.array([row.label > 0 for row in rows], float)
    x = np.array([row.x for row in rows]).reshape(len(rows), len(FEATURES))
    sampled = Counter(row.label for row in rows)
    weight = np.array([whole.get(row.label, 1) / sampled[row.label] for row in rows])
    return fit(x, y, weight / weight.mean() if len(weight) else weight)


def score_quality(docs: DataFrame, model: Forest, folds: int = 5, held: int = 0, kept: float = KEPT) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``; null texts score as empty ones."""

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = model.scores(np.array([statistics(text) for text in batch["text"]]).reshape(len(batch), len(FEATURES)))
            yield batch[["doc_id", "held_out"]].assign(score=score, predicted=(score >= kept).astype(np.int32))

    rows = docs.select(F.col("doc_id").cast("string"), (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), "text")
    found = rows.mapInPandas(predict, "doc_id string, held_out boolean, score double, predicted int")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def keep_good(docs: DataFrame, model: Forest, kept: float = KEPT) -> DataFrame:
    """``docs`` without the rows that score below ``kept``; columns as they were."""

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([statistics(text) for text in texts]).reshape(len(texts), len(FEATURES))) >= kept)

    return docs.filter(good("text"))
