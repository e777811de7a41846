"""BM25 over DataFrames: persisted postings for many queries, one narrow pass for a single query.

Each row of a corpus (doc_id, text) is a document of its own; rows that share a doc_id give hits
that share it. A null text is a document without tokens.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tessera.functions.scores import K1, B, idf, tf_weight
from tessera.functions.text import token_list, tokens
from tessera.operators.blocks import Best, slices
from tessera.scratch import Scratch, small, written

LARGE_K = 100_000


def no_hits(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, score) without a row, the key of the type that it has in ``rows``."""
    return rows.select(key, F.lit(0.0).alias("score")).where(F.lit(False))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is computed once a row: the optimizer doesn't copy what a
    generator makes into the expressions and lambdas that read it."""
    return rows.withColumn(name, F.explode(F.array(value)))


def tokenized(corpus: DataFrame) -> DataFrame:
    """(doc_id, tokens, dl) of ``corpus`` (doc_id, text)."""
    return once(corpus.select("doc_id", "text"), "tokens", tokens("text")).select("doc_id", "tokens", F.size("tokens").alias("dl"))


def doc_lengths(corpus: DataFrame) -> DataFrame:
    return tokenized(corpus).select("doc_id", "dl")


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: documents, empty ones included, and their mean length."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def counted(corpus: DataFrame) -> DataFrame:
    """(doc_id, dl, counts array<struct<term, tf>>): terms are counted in the row that holds them,
    so nothing is shuffled: in the sorted tokens each term is one run."""
    rows = once(tokenized(corpus), "tokens", F.sort_array("tokens"))
    at = F.sequence(F.lit(0), F.col("dl") - 1)
    shifted = F.concat(F.array(F.lit("")), F.col("tokens"))  # no token is empty
    starts = F.filter(F.zip_with(F.zip_with("tokens", shifted, lambda a, b: a != b), at, lambda new, i: F.when(new, i)), lambda i: i.isNotNull())
    rows = once(rows, "starts", F.when(F.col("dl") > 0, starts).otherwise(F.array().cast("array<int>")))
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))), F.array("dl"))
    rows = once(rows, "ends", F.slice(ends, 1, F.size("starts")))
    run = lambda a, b: F.struct(F.get("tokens", a).alias("term"), (b - a).cast("long").alias("tf"))
    return rows.select("doc_id", "dl", F.zip_with("starts", "ends", run).alias("counts"))


def _postings(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.inline("counts")).select("term", "doc_id", "tf")


def postings(corpus: DataFrame) -> DataFrame:
    """(term, doc_id, tf)."""
    return _postings(counted(corpus))


def document_frequencies(posting_rows: DataFrame) -> DataFrame:
    return posting_rows.groupBy("term").agg(F.count("*").alias("df"))


@dataclass
class Bm25Index:
    """The four tables of a corpus. Written by ``save``, they serve queries without the texts."""

    postings: DataFrame
    lengths: DataFrame
    frequencies: DataFrame
    stats: DataFrame

    @classmethod
    def build(cls, corpus: DataFrame) -> Bm25Index:
        rows = written(counted(corpus))
        lengths = rows.select("doc_id", "dl")
        return cls(_postings(rows), lengths, document_frequencies(_postings(rows)), corpus_stats(lengths))

    def save(self, path: str) -> Bm25Index:
        """Postings are written in term order, so that a query's terms prune row groups."""
        spark = self.postings.sparkSession
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.parquet(f"{path}/postings")
        self.lengths.write.parquet(f"{path}/lengths")
        document_frequencies(spark.read.parquet(f"{path}/postings")).write.parquet(f"{path}/frequencies")
        corpus_stats(spark.read.parquet(f"{path}/lengths")).write.parquet(f"{path}/stats")
        return self.load(spark, path)

    @classmethod
    def load(cls, spark, path: str) -> Bm25Index:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "frequencies", "stats")))

    def __len__(self) -> int:
        return self.stats.first()["n"]

    def added(self, corpus: DataFrame) -> Bm25Index:
        """The index with the documents of ``corpus`` as well; ids are expected to be new. Only
        they are tokenized."""
        more = Bm25Index.build(corpus)
        rows, lengths = self.postings.unionByName(more.postings), self.lengths.unionByName(more.lengths)
        both = self.frequencies.unionByName(more.frequencies).groupBy("term").agg(F.sum("df").alias("df"))
        return Bm25Index(rows, lengths, both, corpus_stats(lengths))

    def cleared(self) -> Bm25Index:
        """An index of the same types without a document."""
        lengths = self.lengths.where(F.lit(False))
        return Bm25Index(self.postings.where(F.lit(False)), lengths, self.frequencies.where(F.lit(False)), corpus_stats(lengths))

    def search(self, query: str, k: int | None) -> DataFrame:
        """(doc_id, score), best first, ties by doc_id; terms that the query repeats count again."""
        counts = Counter(token_list(query))
        spark = self.postings.sparkSession
        if not counts or (k is not None and k <= 0):
            return no_hits(self.lengths)
        # a query's own terms: a handful
        terms = F.broadcast(spark.createDataFrame(list(counts.items()), "term string, qtf long"))
        found = self.postings.where(F.col("term").isin(*counts)).join(terms, "term")
        found = found.join(F.broadcast(self.frequencies.where(F.col("term").isin(*counts))), "term")
        return best(_scored(found.join(self.lengths, "doc_id", "left"), self.stats), k)


def _scored(found: DataFrame, stats: DataFrame) -> DataFrame:
    """Sums of the terms' weights for each document; ``found``: term, doc_id, tf, dl, df, qtf."""
    one = F.coalesce(F.col("dl"), F.lit(0))
    weight = F.col("qtf") * idf(F.col("n"), F.col("df")) * tf_weight(F.col("tf"), one, F.col("avgdl"))
    # stats is one row
    return found.crossJoin(F.broadcast(stats)).groupBy("doc_id").agg(F.round(F.sum(weight), 6).alias("score"))


def best(scored: DataFrame, k: int | None, key: str = "doc_id") -> DataFrame:
    """The k rows of highest score, ties by key, best first; all of them, unsorted, for None.

    A small k is a heap in each task; a k that no heap should hold and that is at least the number
    of rows is a sort.
    """
    if k is None:
        return scored
    ordered = scored.orderBy(F.desc("score"), F.asc(key))
    return ordered if k > LARGE_K and k >= scored.count() else ordered.limit(k)


def search_corpus(corpus: DataFrame, query: str, k: int | None) -> DataFrame:
    """The same hits without an index: each document's counts of the query's terms are taken in
    one narrow pass and written, so that only sums and the best k are shuffled."""
    counts = Counter(token_list(query))
    if not counts or (k is not None and k <= 0):
        return no_hits(corpus)
    words = list(counts)
    # a few numbers for each document
    each = written(tokenized(corpus).select("doc_id", "dl", *(F.size(F.filter("tokens", _is(w))).alias(f"tf{i}") for i, w in enumerate(words))))
    stats = each.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))))
    hits = each.where(" or ".join(f"tf{i} > 0" for i in range(len(words)))).crossJoin(F.broadcast(stats))
    score = sum((counts[w] * idf(F.col("n"), F.col(f"df{i}")) * tf_weight(F.col(f"tf{i}"), F.col("dl"), F.col("avgdl")) for i, w in enumerate(words)), F.lit(0.0))
    return best(hits.select("doc_id", F.round(score, 6).alias("score")), k)


def _is(word: str):
    return lambda token: token == F.lit(word)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of ``queries`` (query_id, query)."""
    return queries.select("query_id", F.explode(tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


#: Terms of queries, repeats among queries counted, that are sent to every task; more go in
#: several passes, and one query's terms stay together.
TERMS_AT_ONCE = 3_000_000
#: Queries that are scored at once.
QUERIES_AT_ONCE = 2_000
#: Terms that at least such a share of the queries have are weighed by a matrix product, so many at most.
FREQUENT_SHARE, FREQUENT_TERMS = 0.01, 96
#: Rounded scores that are equal differ by less before.
ROUNDING = 1e-6


class _Part:
    """Some of a block's queries: the weights of frequent terms as a matrix, others by term."""

    def __init__(self, query_ids: pa.Array, query: np.ndarray, term: np.ndarray, weight: np.ndarray, column: np.ndarray, frequent: int, k: int) -> None:
        often = column[term] >= 0
        self.matrix = np.zeros((len(query_ids), frequent))
        self.matrix[query[often], column[term[often]]] = weight[often]
        order = np.argsort(term[~often], kind="stable")
        self.query, self.weight = query[~often][order], weight[~often][order]
        self.first = np.searchsorted(term[~often][order], np.arange(len(column) + 1)).astype(np.int32)
        self.best = Best(query_ids, k)

    def add(self, doc_ids: pa.Array, dense: np.ndarray, term: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> None:
        """Keeps the best of documents: the weights of frequent terms in ``dense``, a column for each
        document, and those of other terms as (term, doc, weight)."""
        n = len(doc_ids)
        out = self.matrix @ dense
        flat = out.reshape(-1)
        of = self.first[term + 1] - self.first[term]
        some = of > 0
        term, doc, weight, of = term[some], doc[some], weight[some], of[some]
        if len(of):
            for a, b in zip(*_steps(np.cumsum(of), 4_000_000), strict=True):
                each = of[a:b].astype(np.int64)
                at = np.arange(each.sum()) + np.repeat(self.first[term[a:b]] - (np.cumsum(each) - each), each)
                flat += np.bincount(self.query[at] * n + np.repeat(doc[a:b], each), self.weight[at] * np.repeat(weight[a:b], each), len(flat))
        # what can't be among the best k any more is not looked at again
        hit = out > np.maximum(self.best.least - ROUNDING, 0.0)[:, None]
        if np.count_nonzero(hit) > 4 * self.best.k * len(out):
            self.best.add(doc_ids, np.where(hit, np.round(out, 6), -1.0))
            self.best.prune()
        else:
            row, column = np.nonzero(hit)
            self.best.add_hits(row, doc_ids.take(pa.array(column)), np.round(out[row, column], 6))


class _Block:
    """Queries' terms with their weights, and what scores batches of counted documents."""

    def __init__(self, terms: pa.Table, avgdl: float, k: int) -> None:
        self.avgdl = avgdl
        encoded = terms.column("query_id").combine_chunks().dictionary_encode()
        words = terms.column("term").combine_chunks().dictionary_encode()
        self.vocabulary = words.dictionary
        query, term, weight = encoded.indices.to_numpy().astype(np.int64), words.indices.to_numpy(), terms.column("weight").to_numpy()
        having = np.bincount(term, minlength=len(self.vocabulary))
        often = np.flatnonzero(having >= max(2, FREQUENT_SHARE * len(encoded.dictionary)))
        often = often[np.argsort(-having[often], kind="stable")][:FREQUENT_TERMS]
        self.column = np.full(len(self.vocabulary), -1)
        self.column[often] = np.arange(len(often))
        self.frequent = len(often)
        order = np.argsort(query, kind="stable")
        query, term, weight = query[order], term[order], weight[order]
        self.parts = []
        for at in range(0, len(encoded.dictionary), QUERIES_AT_ONCE):
            a, b = np.searchsorted(query, (at, at + QUERIES_AT_ONCE))
            self.parts.append(_Part(encoded.dictionary.slice(at, QUERIES_AT_ONCE), query[a:b] - at, term[a:b], weight[a:b], self.column, self.frequent, k))

    def add(self, doc_ids: pa.Array, lengths: np.ndarray, counts: pa.Array) -> None:
        n = len(lengths)
        entries = counts.flatten()
        term = pc.index_in(entries.field("term"), self.vocabulary)
        known = np.flatnonzero(pc.is_valid(term).to_numpy(zero_copy_only=False))
        if not len(known):
            return
        term = term.take(pa.array(known)).to_numpy()
        doc = np.repeat(np.arange(n), pc.list_value_length(counts).to_numpy(zero_copy_only=False))[known]
        tf = entries.field("tf").to_numpy()[known]
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / self.avgdl))
        often = self.column[term] >= 0
        dense = np.zeros((self.frequent, n))
        dense[self.column[term[often]], doc[often]] = weight[often]
        term, doc, weight = term[~often], doc[~often], weight[~often]
        for part in self.parts:
            part.add(doc_ids, dense, term, doc, weight)


def _steps(ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of stretches whose ends grow by about ``most`` each."""
    starts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1], most), side="left"))
    return starts, np.append(starts[1:], len(ends))


def search_batch(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score): the best k documents of every query, ties by doc_id.

    The corpus is tokenized once, into a table of counts, and read once for each block of queries
    that is small enough to send; a task scores its documents against a block and keeps the best k
    of each query, so that no pair of query and document is shuffled but those.
    """
    spark = corpus.sparkSession
    schema = StructType().add("query_id", queries.schema["query_id"].dataType).add("doc_id", corpus.schema["doc_id"].dataType).add("score", DoubleType())
    rows = written(counted(corpus))
    stats = corpus_stats(rows.select("dl")).first()
    with Scratch() as scratch:
        terms = scratch.written(query_terms(queries))
        wanted = scratch.written(terms.select("term").distinct())
        frequencies = document_frequencies(rows.select(F.inline("counts")).join(small(wanted), "term", "left_semi"))
        weighted = written(terms.join(frequencies, "term").select("query_id", "term", (F.col("qtf") * idf(F.lit(stats["n"]), F.col("df"))).alias("weight")))
    blocks = max(1, math.ceil(weighted.count() / TERMS_AT_ONCE))
    parts = []
    for i in range(blocks if k > 0 and stats["avgdl"] else 0):
        some = weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else weighted
        # about TERMS_AT_ONCE rows
        shared = spark.sparkContext.broadcast(some.toArrow().combine_chunks())

        def run(batches: Iterator[pa.RecordBatch], shared=shared, avgdl=stats["avgdl"]) -> Iterator[pa.RecordBatch]:
            if not len(shared.value):
                return
            block = _Block(shared.value, avgdl, k)
            for batch in batches:
                for part in slices(batch):
                    block.add(part.column(0), part.column(1).to_numpy(), part.column(2))
            for part in block.parts:
                yield from part.best.batches()

        parts.append(ranked_by_query(rows.select("doc_id", "dl", "counts").mapInArrow(run, schema), k))
    if not parts:
        return ranked_by_query(spark.createDataFrame([], schema), k)
    return reduce(DataFrame.unionAll, parts)


def ranked_by_query(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    rank: Column = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key)))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "score")
