"""Exact cosine search over arrays of floats."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tessera.functions.scores import dot, l2_norm
from tessera.operators.blocks import Best, slices
from tessera.operators.bm25 import best, no_hits, ranked_by_query


def with_norms(vectors: DataFrame) -> DataFrame:
    """``vectors`` (doc_id, embedding) with the norm that queries need, to be stored with them."""
    return vectors.withColumn("norm", l2_norm(F.col("embedding")))


def top_k(vectors: DataFrame, query: Sequence[float], k: int | None) -> DataFrame:
    """(doc_id, score), best first, ties by doc_id. Vectors without length score 0 and stay.

    Empty for k of 0, for a query without length, and where the dimensions differ.
    """
    size = math.sqrt(sum(x * x for x in query))
    if (k is not None and k <= 0) or size == 0:
        return no_hits(vectors)
    literal = F.array(*[F.lit(float(x)) for x in query])
    fitting = vectors.where(F.size("embedding") == len(query))
    norm = F.col("norm") if "norm" in vectors.columns else l2_norm(F.col("embedding"))
    score = F.when(norm == 0, 0.0).otherwise(dot(F.col("embedding"), literal) / (norm * size))
    return best(fitting.select("doc_id", F.round(score, 6).alias("score")), k)


#: Queries of a batch whose vectors are sent to every task; more go in several passes.
QUERIES_AT_ONCE = 2_000


def _matrix(lists: pa.Array) -> np.ndarray:
    """The rows of equally long lists without nulls."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _complete(lists: pa.Array) -> pa.Array:
    """Which entries are lists without a null inside."""
    holes = pc.is_in(pa.array(np.arange(len(lists))), pc.filter(pc.list_parent_indices(lists), pc.is_null(pc.list_flatten(lists))).cast(pa.int64()))
    return pc.and_(pc.is_valid(lists), pc.invert(holes))


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; those without length stay."""
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(size == 0, 1, size)


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score) of every query (query_id, query_vec) against all vectors.

    The stated queries go against all rows block by block; each block is small enough to send, and
    each task hands on its best k of a query. Vectors without length score 0; queries
    without length, nulls, and vectors of another dimension or with a null inside find nothing.
    """
    names = queries.schema["query_id"].dataType, vectors.schema["doc_id"].dataType
    schema = StructType().add("query_id", names[0]).add("doc_id", names[1]).add("score", DoubleType())
    spark = queries.sparkSession
    blocks = max(1, math.ceil(queries.count() / QUERIES_AT_ONCE))
    rows = vectors.select("doc_id", "embedding").where("embedding is not null")
    parts = []
    for i in range(blocks if k > 0 else 0):
        some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else queries
        # about QUERIES_AT_ONCE rows
        shared = spark.sparkContext.broadcast(some.select("query_id", "query_vec").where("query_vec is not null").toArrow().combine_chunks())

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            asked = asked.filter(_complete(asked.column(1).combine_chunks()))
            sizes = pc.list_value_length(asked.column(1)).to_numpy()
            units = {}
            for size in np.unique(sizes):
                of = asked.filter(pa.array(sizes == size))
                unit = _unit(_matrix(of.column(1).combine_chunks()))
                some = np.flatnonzero(unit.any(axis=1))
                units[int(size)] = of.column(0).combine_chunks().take(pa.array(some)), unit[some]
            kept = {size: Best(ids, k) for size, (ids, _) in units.items() if len(ids)}
            for batch in batches:
                for part in slices(batch):
                    part = part.filter(_complete(part.column(1)))
                    lengths = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
                    for size, found in kept.items():
                        fitting = part.filter(pa.array(lengths == size))
                        if fitting.num_rows:
                            # a cosine below 0 is a hit: 2 is added while the best are looked for
                            found.add(fitting.column(0), np.round(units[size][1] @ _unit(_matrix(fitting.column(1))).T, 6) + 2)
            for found in kept.values():
                for out in found.batches():
                    yield out.set_column(2, "score", pa.array(np.round(out.column(2).to_numpy() - 2, 6) + 0.0))

        parts.append(ranked_by_query(rows.mapInArrow(run, schema), k))
    if not parts:
        return ranked_by_query(spark.createDataFrame([], schema), k)
    return reduce(DataFrame.unionAll, parts)
