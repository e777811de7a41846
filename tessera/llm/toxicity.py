"""Toxicity categories by a classifier chain of linear models.

Features are words and word beginnings of four and five letters; the chain's dictionary holds
those that tell toxic labelled documents from others best, beyond chance. Each category's logistic model sees,
besides the words, the probabilities of the categories before it; in training those are
out-of-fold predictions, so that later models meet the errors they will meet in use.

The categories are the label columns. Where labels have the one column ``toxic``, the kinds of
toxic documents before it are found in the data: clusters of the toxic documents' marking words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tessera.llm.common import Scratch, in_small_batches, lean, sampled, spare

#: Labelled documents that training reads at most, about; the others' labels are not used.
TRAINING_ROWS = 12_000
#: Entries of the dictionary at most, and the chi-square that each has at least: one that chance
#: exceeds once in a thousand.
FEATURES = 4_000
LEAST_CHI = 10.83
FOLDS = 4
#: Kinds of toxic documents that are looked for, and the marking words that tell them apart.
KINDS = 2
MARKS = 200
STEPS = 300
MEMO_ENTRIES = 100_000

LABEL = "toxic"

_WORD = re.compile(r"[^\W\d_]+").findall


def word_features(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:n]}-" for n in (4, 5) if len(word) >= n))


def text_features(text: str | None) -> set[str]:
    return {x for word in set(_WORD((text or "").lower())) for x in word_features(word)}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Sparse:
    """Rows of feature numbers (each present or not), and dense columns after them."""

    ids: np.ndarray
    row: np.ndarray
    rows: int
    features: int
    dense: np.ndarray

    @classmethod
    def of(cls, lists: list[np.ndarray], features: int) -> Sparse:
        sizes = [len(x) for x in lists]
        ids = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
        return cls(ids, np.repeat(np.arange(len(lists)), sizes), len(lists), features, np.zeros((len(lists), 0)))

    @property
    def width(self) -> int:
        return self.features + self.dense.shape[1]

    def some(self, keep: np.ndarray) -> Sparse:
        at = keep[self.row]
        return Sparse(self.ids[at], (np.cumsum(keep) - 1)[self.row[at]], int(keep.sum()), self.features, self.dense[keep])

    def with_column(self, x: np.ndarray) -> Sparse:
        return Sparse(self.ids, self.row, self.rows, self.features, np.column_stack([self.dense, x]))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.ids], self.rows) + self.dense @ w[self.features :]

    def transposed_times(self, v: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.ids, v[self.row], self.features), v @ self.dense)


def fit_logistic(x: Sparse, y: np.ndarray, steps: int = STEPS, decay: float = 2e-4, close: float = 1e-5) -> np.ndarray:
    """Weights and, last, the intercept of a logistic model with a ridge penalty: at most ``steps``
    steps of limited-memory BFGS, fewer where the gradient is below ``close``."""
    share = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    w = np.zeros(x.width + 1)
    w[-1] = np.log(share / (1 - share))
    if not len(y) or y.min() == y.max():
        return w

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.times(w[:-1]) + w[-1]
        error = (_sigmoid(z) - y) / len(y)
        gradient = np.append(x.transposed_times(error) + decay * w[:-1], error.sum())
        return float(np.mean(np.logaddexp(0, z) - y * z) + decay / 2 * (w[:-1] @ w[:-1])), gradient

    value, gradient = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(gradient).max() < close:
            break
        direction, scales = gradient.copy(), []
        for s, g in reversed(past):
            scales.append((s @ direction) / (s @ g))
            direction -= scales[-1] * g
        if past:
            s, g = past[-1]
            direction *= (s @ g) / (g @ g)
        for s, g in past:
            direction += s * (scales.pop() - (g @ direction) / (s @ g))
        length = 1.0 if past else 1 / max(1.0, float(np.abs(gradient).sum()))
        slope = gradient @ direction
        while True:  # the slope is against the gradient, so some length is short enough
            new = w - length * direction
            new_value, new_gradient = loss(new)
            if new_value <= value - 1e-4 * length * slope or length < 1e-10:
                break
            length /= 2
        if (new - w) @ (new_gradient - gradient) > 1e-12:
            past = [*past[-9:], (new - w, new_gradient - gradient)]
        w, value, gradient = new, new_value, new_gradient
    return w


@dataclass
class Chain:
    """Linear models in their order; model j has a weight for each feature and for each of the j
    categories before it, then the intercept."""

    names: list[str]
    dictionary: dict[str, int]
    weights: list[np.ndarray]
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def _ids(self, word: str) -> tuple[int, ...]:
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        ids = tuple(i for x in word_features(word) if (i := self.dictionary.get(x)) is not None)
        self.memo[word] = ids
        return ids

    def probabilities(self, text: str | None) -> list[float]:
        found: set[int] = set()
        get = self.memo.get
        for word in set(_WORD((text or "").lower())):
            if (ids := get(word)) is None:
                ids = self._ids(word)
            if ids:
                found.update(ids)
        at = np.fromiter(found, np.int64, len(found))
        out: list[float] = []
        n = len(self.dictionary)
        for w in self.weights:
            z = w[at].sum() + sum(a * p for a, p in zip(w[n:], out, strict=False)) + w[-1]
            out.append(float(_sigmoid(np.array(z))))
        return out


def fit_chain(x: Sparse, labels: np.ndarray, names: list[str], dictionary: dict[str, int], folds: int = FOLDS) -> Chain:
    """A chain over the columns of ``labels``, with the fold of row i being i mod ``folds``."""
    fold = np.arange(x.rows) % folds
    weights = []
    for j in range(labels.shape[1]):
        held = np.zeros(x.rows)
        for k in range(folds):
            w = fit_logistic(x.some(fold != k), labels[fold != k, j])
            of = x.some(fold == k)
            held[fold == k] = _sigmoid(of.times(w[:-1]) + w[-1])
        weights.append(fit_logistic(x, labels[:, j]))
        x = x.with_column(held)
    return Chain(names, dictionary, weights)


def kinds_of(x: Sparse, toxic: np.ndarray, kinds: int = KINDS, marks: int = MARKS) -> np.ndarray:
    """A 0/1 column for each kind: clusters of the toxic rows by direction, over the ``marks``
    features that toxic rows have more often than others, rare ones weighing more. The first
    centre is the row that is furthest from the mean, each next one that furthest from those."""
    out = np.zeros((x.rows, kinds))
    rows = np.flatnonzero(toxic == 1)
    if not len(rows) or not x.features:
        return out
    a = np.bincount(x.ids, toxic[x.row], x.features)
    n = np.bincount(x.ids, minlength=x.features)
    lift = (a + 1) / (toxic.sum() + 2) / ((n - a + 1) / ((1 - toxic).sum() + 2))
    best = np.argsort(-np.log(lift) * a, kind="stable")[:marks]
    place = np.full(x.features, -1)
    place[best] = np.arange(len(best))
    of = x.some(toxic == 1)
    at = place[of.ids]
    points = np.zeros((of.rows, len(best)))
    points[of.row[at >= 0], at[at >= 0]] = np.log(1 + x.rows / n[best])[at[at >= 0]]
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    near = points @ points.mean(axis=0)
    centres = []
    for _ in range(kinds):
        centres.append(points[int(np.argmin(near))])
        near = np.max(points @ np.array(centres).T, axis=1)
    centres = np.array(centres)
    for _ in range(20):
        own = np.argmax(points @ centres.T, axis=1)
        sums = np.array([points[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(kinds)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    out[rows, np.argmax(points @ centres.T, axis=1)] = 1
    return out


def train(documents: DataFrame, labels: DataFrame, categories: tuple[str, ...] = (LABEL,), rows: int = TRAINING_ROWS, features: int = FEATURES) -> Chain:
    """A chain over the 0/1 columns ``categories`` of ``labels``, the last of which says toxic, from
    about ``rows`` labelled documents at most, chosen by a hash of the doc_id.

    One category alone is preceded by ``KINDS`` kinds that are found among its documents. Labels
    with a null and those of ids that no document has are ignored; a doc_id with several labels
    has a category if one says so, and of documents that share an id the text of greatest hash is
    read. Without labelled documents every probability is near 0. Texts are read once; the driver gets
    ``features`` dictionary rows and each training row's feature numbers.
    """
    known = " and ".join(["doc_id is not null", *(f"`{c}` is not null" for c in categories)])
    every = labels.where(known).groupBy("doc_id").agg(*(F.max(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories)))
    total = every.count()
    chosen = sampled(every, rows, total, seed=4)
    if total and chosen.isEmpty():
        raise ValueError(f"no label among {total} was chosen")
    ys = [f"y{i}" for i in range(len(categories))]
    # about ``rows`` rows of a few numbers
    found = in_small_batches(documents).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    training = found.groupBy("doc_id").agg(F.max_by("text", F.xxhash64("text")).alias("text"), F.first(F.array(*ys)).alias("y"))

    @lean()
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(text_features(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.string()))], ["doc_id", "y", "features"])

    with Scratch() as scratch:
        extracted = scratch.written(training.mapInArrow(extract, "doc_id long, y array<int>, features array<string>"))
        toxic = F.element_at("y", -1)
        of = extracted.select(toxic.alias("toxic"), F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
        sums = extracted.agg(F.count("*"), F.coalesce(F.sum(toxic), F.lit(0))).first()
        n, positives = sums[0], sums[1]
        b, c, d = F.col("n") - F.col("a"), positives - F.col("a"), F.lit(n - positives) - F.col("n") + F.col("a")
        numerator = (F.col("a") * d - b * c).cast("double")
        chi = numerator * numerator / ((F.col("n") * (c + d)).cast("double") * (b + d) * max(1, positives))
        best = of.where(f"n >= 5 and n < {n}").select("feature", (n * chi).alias("chi")).where(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "feature").limit(features).collect()
        dictionary = {r["feature"]: i for i, r in enumerate(best)}

        @lean()
        def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = [sorted(i for x in found if (i := dictionary.get(x)) is not None) for found in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "y", "ids"])

        got = extracted.mapInArrow(numbers, "doc_id long, y array<int>, ids array<int>").toArrow()
    lists = [np.array(x, np.int64) for x in got.column("ids").to_pylist()]
    order = sorted(range(len(lists)), key=lambda i: (got.column("doc_id")[i].as_py(), lists[i].tolist()))
    x = Sparse.of([lists[i] for i in order], len(dictionary))
    y = np.array([got.column("y")[i].as_py() for i in order], float).reshape(-1, len(categories))
    names = list(categories)
    if len(categories) == 1:
        y = np.column_stack([kinds_of(x, y[:, 0]), y])
        names = [*(f"kind_{i + 1}" for i in range(KINDS)), *categories]
    return fit_chain(x, y, names, dictionary)


def score(documents: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """(doc_id, toxic boolean, p_<category> double ...) of every whole text of ``documents``.

    Null and empty texts have the probabilities of a text without known words. Null ids and
    repeated rows stay; other columns are ignored.
    """
    names = [f"p_{x}" for x in chain.names]

    @lean()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array([chain.probabilities(x) for x in batch.column(1).to_pylist()]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p[:, -1] >= threshold), *(pa.array(p[:, j]) for j in range(len(names)))], ["doc_id", LABEL, *names])

    schema = "doc_id long, toxic boolean, " + ", ".join(f"{x} double" for x in names)
    return in_small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def is_toxic(chain: Chain, threshold: float = 0.5):
    """A vectorised function of a text column: whether the chain's last category reaches the threshold."""

    @pandas_udf("boolean")
    def toxic(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with spare():
            for text in texts:
                yield pd.Series([chain.probabilities(x)[-1] >= threshold for x in text], dtype=bool)

    return toxic


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that a chain trained on ``labels`` doesn't reject, with all columns."""
    return documents.where(~is_toxic(train(documents, labels))(F.col("text")))
