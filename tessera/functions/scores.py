"""Scoring expressions: BM25, cosine, reciprocal ranks, buckets. All run in the JVM, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
K1 = 1.2
B = 0.75
RANK_OFFSET = 60


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def tf_weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    """0 for an empty document or corpus."""
    return F.when((dl == 0) | (avgdl == 0), 0.0).otherwise(tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    size = l2_norm(a) * l2_norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def l2_normalized(v: Column) -> Column:
    """A vector without length stays as it is."""
    size = l2_norm(v)
    return F.transform(v, lambda x: F.when(size == 0, x.cast("double")).otherwise(x.cast("double") / size))


def reciprocal_rank(rank: Column) -> Column:
    """0 for a missing rank."""
    return F.coalesce(1.0 / (RANK_OFFSET + rank), F.lit(0.0))


def bucket(score: Column) -> Column:
    return F.when(score > 0.5, "high").when(score > 0.3, "middle").otherwise("low")


def formatted(rank: Column, score: Column, path: Column) -> Column:
    """A line of a result list: right-aligned rank, score of three decimals, path."""
    return F.format_string("%3d. %.3f %s", rank.cast("int"), score.cast("double"), path)


def status_line(n: int, seconds: float) -> str:
    return f"{n} results ({seconds:.2f}s)"
