"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's byte n-grams (letters lower-cased, everything else a blank) are hashed to
buckets; the text's vector is the weighted average of the buckets' embeddings, and a
linear softmax reads the language from it.  Both are trained together by stochastic
gradient descent in numpy on a bounded sample of labelled texts.  A temperature and a
rejection threshold are set on part of the sample that training did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketsense.llm.common import fold_of, sample_classes

BUCKETS = 1 << 13
WIDTH = 16
PER_CLASS = 800  # labelled texts per language that the model is fitted on
GRAMS = (2, 3, 4)
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_BLANKED = np.array([byte if chr(byte).isalpha() and byte < 128 or byte >= 128 else 32 for byte in range(256)], np.uint32)


def gram_weights(text: str) -> np.ndarray:
    """Weight of each bucket: the root of its share of the text's n-grams, so the squares add up to 1."""
    held = _BLANKED[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    hashed = []
    for size in GRAMS:
        code = np.full(max(0, len(held) - size + 1), size, np.uint32)
        for place in range(size):
            code = code * np.uint32(0x01000193) ^ held[place : place + len(code)]
        hashed.append((code * np.uint32(2654435761)) >> np.uint32(32 - 13))
    every = np.concatenate(hashed)
    return np.sqrt(np.bincount(every, minlength=BUCKETS) / max(1, len(every))).astype(np.float32)


class WeightRows:
    """Rows of bucket weights in half precision, only those over zero; indexed by row numbers like an array, which widens those rows."""

    def __init__(self, packed: list[tuple[bytes, bytes]]):
        """``packed``: buckets (unsigned 16-bit) and weights of each row; the list is emptied on the way."""
        sizes = [len(weights) // 2 for _, weights in packed]
        self.starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.buckets, self.weights = np.empty(self.starts[-1], np.uint16), np.empty(self.starts[-1], np.float16)
        for row, (start, stop) in enumerate(zip(self.starts[:-1], self.starts[1:])):
            self.buckets[start:stop], self.weights[start:stop] = np.frombuffer(packed[row][0], np.uint16), np.frombuffer(packed[row][1], np.float16)
            packed[row] = (b"", b"")

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(rows), BUCKETS), np.float32)
        for place, row in enumerate(rows):
            held = slice(self.starts[row], self.starts[row + 1])
            wide[place, self.buckets[held]] = self.weights[held]
        return wide


@dataclass
class LanguageModel:
    names: list[str]
    logits: np.ndarray  # buckets x languages: embeddings times output weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Calibrated probabilities for rows of bucket weights."""
        z = (weights.astype(np.float32, copy=False) @ self.logits + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its probability; ``und`` and 0 for null, for texts without a letter, and where nothing was learned."""
        names, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for row, text in enumerate(texts):
            if self.names and text and _LETTER.search(text):
                p = self.scores(gram_weights(text)[None, :])[0]
                names[row], sure[row] = self.names[int(p.argmax())], float(p.max())
        return names, sure


def fit(weights: np.ndarray | WeightRows, labels: list[str], epochs: int = 15, rate: float = 0.5, batch: int = 32) -> LanguageModel:
    """Fit embeddings and softmax on rows of bucket weights; every fifth row calibrates instead."""
    names = sorted(set(labels))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    target = np.array([names.index(label) for label in labels])
    rng = np.random.default_rng(9)
    shuffled = rng.permutation(len(target))
    held, used = shuffled[::5], np.delete(shuffled, np.s_[::5]) if len(target) >= 5 else shuffled
    embed = (rng.standard_normal((BUCKETS, WIDTH)) / np.sqrt(WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(used)
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            x = weights[rows].astype(np.float32, copy=False)
            hidden = x @ embed
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), target[rows]] -= 1
            p /= len(rows)
            back = p @ out.T
            out -= step * (hidden.T @ p)
            bias -= step * p.sum(axis=0)
            seen = np.flatnonzero(x.any(axis=0))
            embed[seen] -= step * (x[:, seen].T @ back)
    model = LanguageModel(names, embed @ out, bias, 1.0, 0.0)
    return calibrate(model, weights[held], target[held])


def calibrate(model: LanguageModel, weights: np.ndarray, target: np.ndarray, lost: float = 0.001) -> LanguageModel:
    """Temperature of least log loss, and the threshold that would reject a share ``lost`` of the right predictions, at most 0.5."""
    best = np.inf
    for temperature in np.geomspace(0.05, 5, 41):
        trial = LanguageModel(model.names, model.logits, model.bias, float(temperature), 0.0)
        p = trial.scores(weights)
        loss = -np.log(np.maximum(p[np.arange(len(target)), target], 1e-9)).mean()
        if loss < best - 1e-9:
            best, model = loss, trial
    p = model.scores(weights)
    right = p.max(axis=1)[p.argmax(axis=1) == target]
    # A threshold under chance would reject nothing, one over a half would reject clear majorities.
    model.threshold = float(np.clip(np.quantile(right, lost) if len(right) else 0.0, 1.0 / len(model.names), 0.5)) if len(model.names) > 1 else 0.0
    return model


def train(docs: DataFrame, folds: int = 4, held: int = 2, per_class: int = PER_CLASS) -> LanguageModel:
    """Fit on documents outside the held-out fold that have a language and a letter.

    Executors make the bucket weights (two small numbers per bucket in use); only those
    of the bounded sample reach the driver.
    """
    known = docs.filter((fold_of(F.col("doc_id"), folds) != held) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = known.select(F.col("lang").alias("label"), "text", F.xxhash64("doc_id", "text").alias("key"))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [gram_weights(text).astype(np.float16) for text in batch["text"]]
            seen = [np.flatnonzero(row) for row in rows]
            yield batch[["key", "label"]].assign(buckets=[at.astype(np.uint16).tobytes() for at in seen], weights=[row[at].tobytes() for row, at in zip(rows, seen)])

    rows = sample_classes(known, F.col("key"), per_class).mapInPandas(weigh, "key long, label string, buckets binary, weights binary").collect()
    rows.sort(key=lambda row: (row.key, row.label))
    labels, packed = [row.label for row in rows], [(row.buckets, row.weights) for row in rows]
    del rows  # the sample stays in half precision without its zeros; a batch at a time is widened
    return fit(WeightRows(packed), labels)


def identify(docs: DataFrame, model: LanguageModel, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) per row of ``docs``.

    Texts that are null or have no letter are ``und`` with score 0 and rejected; a
    prediction below the calibrated threshold keeps its language and is rejected.
    """

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, sure = model.predict(batch["text"].tolist())
            rejected = [name == UNKNOWN or p < model.threshold for name, p in zip(names, sure)]
            yield batch[["doc_id", "held_out"]].assign(lang_pred=names, score=sure, rejected=rejected)

    rows = docs.select(F.col("doc_id").cast("string"), (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), "text")
    found = rows.mapInPandas(predict, "doc_id string, held_out boolean, lang_pred string, score double, rejected boolean")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` without the rows whose language the model rejects; columns as they were."""

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        names, sure = model.predict(texts.tolist())
        return pd.Series([name != UNKNOWN and p >= model.threshold for name, p in zip(names, sure)])

    return docs.filter(known("text"))
