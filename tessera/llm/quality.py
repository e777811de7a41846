"""Quality by positive-unlabelled learning: the non-negative unbiased risk with an estimated prior.

Trusted positives are documents whose label says good; the rest of the corpus is unlabelled, and
bad labels are not used. A linear model on shares of characters, words and lines minimises
prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)) with the sigmoid loss.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_small_batches, sampled

#: Documents of each kind, positives and unlabelled, that training reads at most, about.
TRAINING_ROWS = 20_000
THRESHOLD = 0.3

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SPACE = np.array([b in (9, 10, 11, 12, 13, 32) for b in range(256)])
_HIGH = np.arange(256) >= 128
_MARK = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH)
_ALONE = [ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\n"]
N_FEATURES = 6 + len(_ALONE) + 12


def features(text: bytes | None) -> np.ndarray:
    """Shares of a whole UTF-8 text; all 0 for null and empty ones."""
    out = np.zeros(N_FEATURES, np.float32)
    words = (text or b"").split()
    if not words:
        return out
    bytes_of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, m = len(text), len(words)
    out[:6] = [bytes_of[kind].sum() / n for kind in (_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH, _MARK)]
    out[6 : 6 + len(_ALONE)] = np.log1p(200 * bytes_of[_ALONE] / n)
    counts = Counter(words)
    top = counts.most_common(3)
    lines = text.split(b"\n")
    repeats = sum(map(eq, words, words[1:]))
    out[-12:] = [
        np.log1p(m) / 5,
        np.log1p(n / m),
        len(counts) / m,
        len(counts) / m**0.8,
        np.log1p(50 * repeats / m),
        repeats / m,
        top[0][1] / m,
        sum(x for _, x in top) / m,
        len(set(lines)) / len(lines),
        np.log1p(m / len(lines)) / 3,
        sum(x.isupper() for x in counts) / len(counts),
        sum(x[-1:].isalnum() or x[-1] >= 128 for x in counts) / len(counts),
    ]
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _adam(w: np.ndarray, gradient_at, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient_at(w)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled: the least ratio, over thresholds, of the
    unlabelled to the positives whose score is as high, by scores of a positive-or-unlabelled
    model on the half of the rows that it was not fitted to; with a margin for small counts."""
    x = np.vstack([positive[::2], unlabelled[::2]])
    y = np.append(np.ones(len(positive[::2])), np.zeros(len(unlabelled[::2])))
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w = _adam(np.zeros(x.shape[1]), lambda w: x.T @ (weight * (_sigmoid(x @ w) - y)) + 1e-4 * w, 300, 0.05)
    p, u = np.sort(positive[1::2] @ w), np.sort(unlabelled[1::2] @ w)
    if not len(p) or not len(u):
        return 0.5
    at = np.quantile(p, np.linspace(0, 0.9, 91))
    share_p = 1 - np.searchsorted(p, at) / len(p)
    share_u = 1 - np.searchsorted(u, at) / len(u)
    margin = np.sqrt(np.log(20) / (2 * len(p))) + np.sqrt(np.log(20) / (2 * len(u)))
    best = int(np.argmin((share_u + margin) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.05, 0.98))


def fit_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.02) -> np.ndarray:
    """Weights that minimise the non-negative risk; while the negative part is below 0 its
    gradient is followed back instead."""

    def gradient(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(positive @ w), _sigmoid(unlabelled @ w)
        slope_p, slope_u = sp * (1 - sp), su * (1 - su)
        up = prior * (positive.T @ -slope_p) / len(positive)
        down = (unlabelled.T @ slope_u) / len(unlabelled) - prior * (positive.T @ slope_p) / len(positive)
        negative = su.mean() - prior * sp.mean()
        return (up + down if negative >= 0 else -down) + 1e-5 * w

    start = np.zeros(positive.shape[1])
    start[-1] = 1.0
    return _adam(start, gradient, steps, rate)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def rows(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, z**2 / 6, np.ones((len(x), 1))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.rows(x) @ self.weights)


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    if not len(positive) or not len(unlabelled):
        n = N_FEATURES
        return Model(np.zeros(n), np.ones(n), np.zeros(2 * n + 1), 0.5)
    model = Model(positive.mean(axis=0), positive.std(axis=0) + 1e-3, np.zeros(0), 0.5)
    p, u = model.rows(positive), model.rows(unlabelled)
    model.prior = estimate_prior(p, u)
    model.weights = fit_risk(p, u, model.prior)
    return model


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves no remainder by 5; such rows' labels are not learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _extracted(texts: DataFrame, keep: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], [keep, "x"])

    return texts.mapInArrow(run, f"{keep} long, x binary")


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """A model from about ``rows`` trusted positives and ``rows`` unlabelled documents at most,
    both chosen by a hash of the id, none held out. The driver gets their features only.

    An id is trusted if it has labels and all that are not null say 1. Labels of ids that no
    document has are ignored; of documents that share an id each is a training row. Null ids are
    never positives, and are chosen or left as one.
    """
    spark_rows = in_small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where(~held_out())
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where(~held_out())
    n_trusted, total = trusted.count(), documents.select("doc_id").count()
    chosen = sampled(trusted, rows, n_trusted, seed=5)
    # about ``rows`` ids
    positive = spark_rows.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by("text", F.xxhash64("text")).alias("text"))
    unlabelled = sampled(spark_rows.withColumn("row", F.struct("doc_id", "text")), rows, total, 50, "row").select("doc_id", "text").distinct()

    def matrix(df: DataFrame) -> np.ndarray:
        got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["x"]) for r in _extracted(df, "doc_id").collect()))
        return np.array([np.frombuffer(x, np.float32) for *_, x in got], np.float64).reshape(-1, N_FEATURES)

    found = matrix(positive), matrix(unlabelled)
    if n_trusted > rows and not len(found[0]) or total > rows and not len(found[1]):
        raise ValueError(f"no document among {n_trusted} trusted and {total} in all was chosen")
    if n_trusted and chosen.isEmpty():
        raise ValueError(f"no id among {n_trusted} trusted ones was chosen")
    return fit(*found)


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text of ``documents`` (doc_id, text).

    Null and empty texts get the score of all-zero features. Null ids count as not held out;
    repeated rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    rows = in_small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
