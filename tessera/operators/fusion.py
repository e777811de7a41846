"""Hybrid ranking: reciprocal-rank fusion of a vector list and a BM25 list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scores import reciprocal_rank
from tessera.operators import bm25, vectors

#: Fixed value: each list is as deep as this times k.
DEPTH = 5


def ranks(hits: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """(key, name): 1-based ranks of an already limited list."""
    # at most DEPTH * k rows stand in this window
    return hits.select(key, F.row_number().over(Window.orderBy(F.desc("score"), F.asc(key))).alias(name))


def fuse(vector_ranks: DataFrame, bm25_ranks: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """(key, score) of lists (key, v_rank) and (key, b_rank), best first, ties by key; a key in one
    list alone gets that list's share. A key that a list repeats has its worse rank."""
    worst_v = vector_ranks.groupBy(key).agg(F.max("v_rank").alias("v_rank"))
    worst_b = bm25_ranks.groupBy(key).agg(F.max("b_rank").alias("b_rank"))
    score = F.round(reciprocal_rank(F.col("v_rank")) + reciprocal_rank(F.col("b_rank")), 6)
    return worst_v.join(worst_b, key, "full_outer").select(key, score.alias("score")).orderBy(F.desc("score"), F.asc(key)).limit(k)


def top_k_hybrid(corpus: DataFrame, query: str, query_vec: Sequence[float], k: int, index: bm25.Bm25Index | None = None) -> DataFrame:
    """(doc_id, score) for ``corpus`` (doc_id, text, embedding). A blank query gives the vector
    list, with its cosines as scores."""
    found = corpus.select("doc_id", "embedding")
    if not query.strip() or k <= 0:
        return vectors.top_k(found, query_vec, k)
    near = vectors.top_k(found, query_vec, DEPTH * k)
    words = index.search(query, DEPTH * k) if index else bm25.search_corpus(corpus.select("doc_id", "text"), query, DEPTH * k)
    return fuse(ranks(near, "v_rank"), ranks(words, "b_rank"), k)


def top_k_hybrid_batch(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score) of every query (query_id, query, query_vec). Queries without
    tokens that match keep their vector list's shares."""
    near = vectors.top_k_batch(corpus.select("doc_id", "embedding"), queries.select("query_id", "query_vec"), DEPTH * k).withColumnRenamed("rank", "v_rank")
    words = bm25.search_batch(corpus.select("doc_id", "text"), queries.select("query_id", "query"), DEPTH * k).withColumnRenamed("rank", "b_rank")
    both = near.drop("score").join(words.drop("score"), ["query_id", "doc_id"], "full_outer")
    score = F.round(reciprocal_rank(F.col("v_rank")) + reciprocal_rank(F.col("b_rank")), 6)
    return bm25.ranked_by_query(both.select("query_id", "doc_id", score.alias("score")), k)
