"""Toxicity: restore disguised words by noisy-channel decoding, then score the restored text.

A writer's word passes a channel that swaps letters for look-alikes, repeats letters,
and puts marks or spaces between them, or marks in place of spaces.  A character trigram model of the corpus says
which restored word is likely; Viterbi decoding finds the likeliest path through the
lattice of readings of each odd-looking token, and of each run of short pieces with the
blanks between them.  A logistic model over restored words
and their beginnings gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketsense.llm.common import fold_of, labelled_texts, text_chunks
from marketsense.session import stage

PER_CLASS = 5000  # labelled texts per class that the weights are fitted on
MOST_FEATURES = 4000
LEAST_TEXTS = 4  # toxic texts that must hold a feature
PREFIXES = (4, 5)
CHUNK = 2_000_000
KNOWN_TOKENS = 200_000

# Look-alikes and the letters they stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i", "¥": "y",
}
MARKS = set("._-*~'^·/\\​­")
# Costs in natural logarithms: a letter or blank read as it stands, a look-alike, a dropped
# mark or blank (or a mark read as a blank),
# a dropped letter of a run of three or more, one of a pair.
PLAIN, SWAP, MARK, REPEAT, DOUBLE = 0.0, -2.0, -1.0, -0.5, -4.0
SPACED = -2.0  # a dropped blank between single letters
GAP = -3.0  # a dropped blank or mark that does not stand among single letters

LETTERS = "abcdefghijklmnopqrstuvwxyz"
EDGE, OTHER = 0, 27  # start and end of a word; any letter that is not a-z
SYMBOLS = 28
_CODE = np.full(0x3000, OTHER, np.int64)
_CODE[:128] = EDGE
for _place, _letter in enumerate(LETTERS):
    _CODE[ord(_letter)] = _place + 1
_CODE[[c for c in range(128, 0x3000) if not chr(c).isalpha()]] = EDGE


def symbol_of(letter: str) -> int:
    return int(_CODE[ord(letter)]) if ord(letter) < len(_CODE) else OTHER


def letter_trigrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n): counts of letter trigrams in all texts; at most 28 ** 3 rows leave a task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            texts = batch["text"].tolist()
            for start, stop in text_chunks(texts, CHUNK):
                joined = "  ".join(text.lower() for text in texts[start:stop] if text)
                codes = _CODE[np.minimum(np.frombuffer(f"  {joined}  ".encode("utf-32-le", "surrogatepass"), np.uint32), len(_CODE) - 1)]
                total += np.bincount((codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:], minlength=SYMBOLS**3)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"gram": used, "n": total[used]})

    return docs.select(F.col(text_col).alias("text")).mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """log P(third | first, second) for all symbols, mixed with shorter contexts."""
    grams = np.zeros(SYMBOLS**3)
    for row in counts.collect():  # a row per trigram of 28 symbols
        grams[row.gram] = row.n
    three = grams.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    # Runs of blanks say nothing about words.
    three[EDGE, EDGE, EDGE] = 0
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 50 * p1) / (two.sum(axis=1, keepdims=True) + 50)
    return np.log((three + 20 * p2[None]) / (three.sum(axis=2, keepdims=True) + 20))


def decode(token: str, model: Sequence, borders: bool = False) -> str:
    """The likeliest letters behind a token, by Viterbi search over (two last symbols).

    With ``borders`` the token may be several words: a blank is kept or dropped, any
    other sign but letters and digits may stand for a blank, and blanks part the result.
    """
    states = {(EDGE, EDGE): 0.0}
    steps = []  # for each place: where each state comes from, and what was read
    for place, char in enumerate(token):
        readings = []
        if char.isalpha():
            readings.append((char, symbol_of(char), PLAIN))
        readings += [(letter, symbol_of(letter), SWAP) for letter in LOOKALIKES.get(char, "")]
        drop = MARK if char in MARKS or not readings else None
        if char.isalpha() and place and token[place - 1] == char:
            drop = REPEAT if token[place - 2 : place] == 2 * char or token[place : place + 2] == 2 * char else DOUBLE
        blank = char.isspace()
        if borders and drop is not None and not char.isalnum():
            drop = GAP if not _between_letters(token, place, blank) else SPACED if blank else drop
        if borders and not char.isalnum():
            readings.append((" ", EDGE, PLAIN if blank else MARK))
        after: dict = {}
        came: dict = {}
        for state, score in states.items():
            a, b = state
            row = model[a][b]
            for letter, c, cost in readings:
                if c == EDGE and b == EDGE and letter == " ":
                    value, to, letter = score + cost, state, ""  # a border already
                else:
                    value, to = score + cost + row[c], (b, c)
                if to not in after or value > after[to]:
                    after[to], came[to] = value, (state, letter)
            if drop is not None and (state not in after or score + drop > after[state]):
                after[state], came[state] = score + drop, (state, "")
        steps.append(came)
        states = after
    last = max(states, key=lambda state: states[state] + (0.0 if borders and state[1] == EDGE else model[state[0]][state[1]][EDGE]))
    found = []
    for came in reversed(steps):
        last, letter = came[last]
        found.append(letter)
    return "".join(reversed(found))


def _between_letters(token: str, place: int, blank: bool) -> bool:
    """Whether a blank has single letters (repeats aside) on both sides, or another mark one on either side."""
    low, high = place, place + 1
    while low and not token[low - 1].isalnum() and token[low - 1] not in LOOKALIKES:
        low -= 1
    while high < len(token) and not token[high].isalnum() and token[high] not in LOOKALIKES:
        high += 1
    far, near = token[max(0, low - 2) : low], token[high : high + 2]
    before = len(far) < 2 or far[0] == far[1] or not (far[0].isalnum() or far[0] in LOOKALIKES)
    after = len(near) < 2 or near[0] == near[1] or not (near[1].isalnum() or near[1] in LOOKALIKES)
    return before and after if blank else before or after


_TRIM = re.compile(r"^[^\w@$!|+€£¡¥]+|[^\w@$€£¥]+$|\W{2,}$")
_THRICE = re.compile(r"(.)\1\1")
PIECE = 3  # signs of a piece that may be a part of a word set apart


def odd(token: str) -> bool:
    """Whether a trimmed token may be disguised: letters among other signs, or a letter three times in a row."""
    return any(map(str.isalpha, token)) and (not token.isalpha() or _THRICE.search(token) is not None)


def windows_of(tokens: list[str]) -> set[str]:
    """Runs of two or more short pieces, and those of single signs in them: the lattice of each holds the blanks between them."""
    found: set[str] = set()
    for most in (1, PIECE):
        run: list[str] = []
        for token in [*tokens, ""]:
            token = token.rstrip(".,;:!?") or token
            if 0 < len(token) <= most and (len(token) == 1 or not token.isdigit()):
                run.append(token)
                continue
            if len(run) > 1:
                found.add(" ".join(run))
            run = []
    return found


def restored_words(text: str | None, model: Sequence, known: dict[str, str]) -> set[str]:
    """The distinct words of a text after restoring; ``known`` keeps decoded tokens and windows."""
    tokens = (text or "").lower().split()
    words: set[str] = set()
    # Pieces set apart by blanks are read together as well.
    disguised = windows_of(tokens)
    for token in set(tokens):
        if token.isalpha() and not (token[:1] * 3 in token or _THRICE.search(token)):
            words.add(token)
            continue
        core = _TRIM.sub("", _TRIM.sub("", token))
        if not core:
            continue
        if odd(core):
            disguised.add(core)
        else:
            words.add(core)
    for part in disguised:
        if part not in known:
            if len(known) > KNOWN_TOKENS:
                known.clear()
            known[part] = decode(part, model, borders=True)
        words.update(known[part].split())
    words.discard("")
    return words


def features_of(words: set[str]) -> set[str]:
    """Words, and the beginnings of longer words (marked by a star)."""
    return words | {f"{word[:size]}*" for word in words for size in PREFIXES if len(word) > size}


@dataclass
class ToxicityModel:
    letters: list  # log probabilities as nested lists, which plain look-ups read fastest
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0

    def scores(self, texts: Sequence[str | None]) -> list[float]:
        known: dict[str, str] = {}
        found = []
        for text in texts:
            hit = self.weights.keys() & features_of(restored_words(text, self.letters, known))
            found.append(float(1 / (1 + np.exp(-(self.bias + sum(sorted(self.weights[name] for name in hit)))))))
        return found


def fit_weights(rows: list[tuple[list[int], int]], size: int, rows_weight: np.ndarray, steps: int = 600, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on rows of feature numbers, by full-batch steps scaled per feature (Adam); the last weight is the bias."""
    y = np.array([label for _, label in rows], float)
    at = np.concatenate([np.full(len(names) + 1, row) for row, (names, _) in enumerate(rows)]) if rows else np.zeros(0, np.int64)
    on = np.concatenate([[*names, size] for names, _ in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
    w, mean, square = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    share = rows_weight / max(rows_weight.sum(), 1e-9)
    for step in range(1, (steps if rows else 0) + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[on], len(y)), -30, 30)))
        slope = np.bincount(on, (share * (p - y))[at], size + 1) + ridge * np.append(w[:-1], 0)
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        w -= 0.05 * (1 - step / (steps + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, per_class: int = PER_CLASS) -> ToxicityModel:
    """Letter model from all texts; weights from a bounded sample of labelled ones outside the held-out fold.

    Features are counted by Spark over the sample; the driver gets at most
    ``MOST_FEATURES`` of them, the ones that tell most, and their numbers per sampled text.
    """
    letters = language_model(letter_trigrams(docs)).tolist()

    def restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, str] = {}
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "names": [sorted(features_of(restored_words(text, letters, known))) for text in batch["text"]]})

    sample = labelled_texts(docs, labels, "toxic", folds, held, per_class).select((F.col("label") > 0).cast("int").alias("label"), "text")
    sample = stage(sample.mapInPandas(restore, "label int, names array<string>"), "toxic-sample")
    sizes = {row.label: row["count"] for row in sample.groupBy("label").count().collect()}
    bad, good = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    counted = sample.select("label", F.explode("names").alias("name")).groupBy("name").agg(F.sum("label").alias("bad"), F.count("*").alias("all"))
    tells = F.log((F.col("bad") + 0.5) / bad) - F.log((F.col("all") - F.col("bad") + 0.5) / good)
    strength = F.col("bad") * tells
    # Only features that speak for toxicity carry weight: a text cannot make up for a slur by being long.
    chosen = counted.filter((F.col("bad") >= LEAST_TEXTS) & (tells > 1.5)).orderBy(strength.desc(), "name").limit(MOST_FEATURES).select("name").collect()
    names = [row.name for row in chosen]
    number = {name: place for place, name in enumerate(names)}
    listed = sample.select("label", F.filter("names", lambda name: name.isin(names)).alias("names") if names else F.array().cast("array<string>").alias("names")).collect()
    rows = sorted(([number[name] for name in row.names], row.label) for row in listed)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold_of(F.col("doc_id"), folds) != held))
    share = known.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.5
    weight = np.array([share / bad if label else (1 - share) / good for _, label in rows])
    w, b = fit_weights(rows, len(names), weight)
    return ToxicityModel(letters, {name: float(w[place]) for name, place in number.items() if w[place] > 0}, float(b))


def score_toxicity(docs: DataFrame, model: ToxicityModel, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``; null and empty texts score by the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_FEATURES weights and 28 ** 3 numbers

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = np.array(shared.value.scores(batch["text"].tolist()))
            yield batch[["doc_id", "held_out"]].assign(score=score, predicted=(score >= 0.5).astype(np.int32))

    rows = docs.select(F.col("doc_id").cast("string"), (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), "text")
    found = rows.mapInPandas(predict, "doc_id string, held_out boolean, score double, predicted int")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
