"""The engine's queries over the test tables, each with the SQL that gives the same rows.

Where a query fuses or ranks, both engines rank rounded scores, ties by key, so that floating
point noise cannot reorder rows.
"""

from __future__ import annotations

import zipfile
from collections.abc import Callable
from functools import reduce
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scores, text
from tessera.operators import bm25, chunking, fusion, preview, snapshots, vectors
from tessera.scratch import new_path, written
from tessera.sources import files
from tessera.sources.store import SnapshotStore

Query = Callable[[SparkSession, str], DataFrame]

QUERY = "the ering rest of thion le queaux"
REPEATED = "rest rest rest ering the"
UNKNOWN = "zzzznotfound qqqqabsent"
PREVIEW = "THE rest ción"
QUERY_VEC_ID = 7
K = 10

_found: dict[str, tuple[Query, str]] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _found[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items()}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a vector; statistics are over these."""
    return _corpus(spark, sf_dir).join(_vectors(spark, sf_dir), "doc_id")


def _query_vec(spark: SparkSession, sf_dir: str) -> list[float]:
    row = _vectors(spark, sf_dir).where(F.col("doc_id") == QUERY_VEC_ID).select("embedding").first()
    return list(row[0]) if row else [1.0]


def _user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))


# --- SQL that the statements below share

_SQL_TOKENS = r"list_transform(list_filter(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_-]+'), lambda x: strlen(x) >= 2), lambda x: lower(x))"


def _sql_tokens(column: str) -> str:
    return _SQL_TOKENS.format(column)


_SQL_PAIRED = "SELECT d.doc_id, d.text, e.embedding::DOUBLE[] AS v FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id"
_SQL_IDF = "ln((n - df + 0.5) / (df + 0.5) + 1)"
_SQL_TF = "CASE WHEN dl = 0 OR avgdl = 0 THEN 0.0 ELSE tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) END"


def _sql_bm25(query: str, source: str = "documents", k: int | None = K) -> str:
    """CTEs that end in ``hits`` (doc_id, score)."""
    limit = "" if k is None else f"ORDER BY score DESC, doc_id LIMIT {k}"
    return f"""
    toks AS (SELECT doc_id, {_sql_tokens("text")} AS t FROM {source}),
    lens AS (SELECT doc_id, len(t) AS dl, t FROM toks),
    stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
    q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({_sql_tokens(f"'{query}'")}) AS term) GROUP BY term),
    post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM lens) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
    freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    hits AS (SELECT doc_id, round(sum(qtf * {_SQL_IDF} * {_SQL_TF}), 6) AS score
             FROM post JOIN freq USING (term) JOIN q USING (term) JOIN lens USING (doc_id), stats GROUP BY doc_id {limit})"""


def _sql_cosine(k: int) -> str:
    """CTEs that end in ``near`` (doc_id, score) from ``vecs`` (doc_id, v)."""
    return f"""
    qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = {QUERY_VEC_ID}),
    near AS (SELECT doc_id, CASE WHEN list_dot_product(v, v) = 0 THEN 0.0 ELSE round(list_cosine_similarity(q, v), 6) END AS score
             FROM vecs, qv ORDER BY score DESC, doc_id LIMIT {k})"""


_SQL_FUSED = f"""
    vr AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM near),
    br AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM hits)
    SELECT doc_id, round(coalesce(1.0 / (60 + vr.r), 0) + coalesce(1.0 / (60 + br.r), 0), 6)::DOUBLE AS score
    FROM vr FULL OUTER JOIN br USING (doc_id) ORDER BY score DESC, doc_id LIMIT {K}"""

# --- lexical


@_query(f"SELECT doc_id, len({_sql_tokens('text')})::BIGINT AS n_tokens, len(list_distinct({_sql_tokens('text')}))::BIGINT AS n_distinct FROM documents")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bm25.tokenized(_corpus(spark, sf_dir))
    return rows.select("doc_id", F.col("dl").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"))


@_query(f"SELECT doc_id, len({_sql_tokens('text')})::INT AS dl FROM documents")
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.doc_lengths(_corpus(spark, sf_dir))


@_query(f"SELECT count(*) AS n, round(avg(len({_sql_tokens('text')})), 6) AS avgdl FROM documents")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.corpus_stats(bm25.doc_lengths(_corpus(spark, sf_dir))).select("n", F.round("avgdl", 6).alias("avgdl"))


@_query(f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_sql_tokens('text')}) AS term FROM documents) GROUP BY term, doc_id")
def postings_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.postings(_corpus(spark, sf_dir))


@_query(
    f"""WITH p AS (SELECT DISTINCT doc_id, unnest({_sql_tokens('text')}) AS term FROM documents), s AS (SELECT count(*) AS n FROM documents)
    SELECT term, df, round({_SQL_IDF}, 6) AS idf FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s"""
)
def term_df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    n = corpus.agg(F.count("*").alias("n"))
    return bm25.document_frequencies(bm25.postings(corpus)).crossJoin(F.broadcast(n)).select("term", "df", F.round(scores.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@_query(f"WITH {_sql_bm25(QUERY)} SELECT doc_id, score FROM hits")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search_corpus(_corpus(spark, sf_dir), QUERY, K)


@_query(f"WITH {_sql_bm25(QUERY)} SELECT doc_id, score FROM hits")
def bm25_search_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.Bm25Index.build(_corpus(spark, sf_dir)).search(QUERY, K)


@_query(f"WITH {_sql_bm25(REPEATED)} SELECT doc_id, score FROM hits")
def bm25_repeated_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search_corpus(_corpus(spark, sf_dir), REPEATED, K)


@_query("SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE false")
def bm25_no_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search_corpus(_corpus(spark, sf_dir), UNKNOWN, K)


@_query(f"WITH {_sql_bm25(QUERY, k=None)} SELECT doc_id, score FROM hits")
def bm25_all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search_corpus(_corpus(spark, sf_dir), QUERY, None)


@_query(
    f"""WITH toks AS (SELECT doc_id, {_sql_tokens("text")} AS t FROM documents),
    stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
    q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT conv_id * 1000 + turn AS query_id, unnest({_sql_tokens("text")}) AS term FROM conversations WHERE role = 'user') GROUP BY query_id, term),
    post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
    freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    hits AS (SELECT query_id, doc_id, round(sum(qtf * {_SQL_IDF} * {_SQL_TF}), 6) AS score FROM post JOIN freq USING (term) JOIN q USING (term), stats GROUP BY query_id, doc_id)
    SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM hits) WHERE rank <= 5"""
)
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search_batch(_corpus(spark, sf_dir), _user_turns(spark, sf_dir), 5)


_SQL_THREE = " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS query_id, (row_number() OVER (ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM (WITH {_sql_bm25(q)} SELECT doc_id, score FROM hits)"
    for i, q in enumerate((QUERY, REPEATED, UNKNOWN, "?"))
)


@_query(_SQL_THREE)
def bm25_batch_vs_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame(list(enumerate((QUERY, REPEATED, UNKNOWN, "?"))), "query_id long, query string")
    return bm25.search_batch(_corpus(spark, sf_dir), asked, K)


@_query(f"WITH {_sql_bm25(QUERY)} SELECT doc_id, score FROM hits")
def bm25_added_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of one half of the ids to which the other half is added."""
    corpus = _corpus(spark, sf_dir)
    half = F.col("doc_id") % 2 == 0
    return bm25.Bm25Index.build(corpus.where(half)).added(corpus.where(~half)).search(QUERY, K)


@_query(f"SELECT doc_id, array_to_string({_sql_tokens('text')}[1:16], ' ') AS head FROM documents")
def token_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.tokenized(_corpus(spark, sf_dir)).select("doc_id", F.array_join(text.head("tokens"), " ").alias("head"))


@_query(f"SELECT doc_id, len(list_filter({_sql_tokens('text')}, lambda x: strlen(x) = 5))::INT AS n FROM documents")
def count_of_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often one id stands among a text's ids; here an id is its token's bytes."""
    rows = bm25.tokenized(_corpus(spark, sf_dir)).select("doc_id", F.transform("tokens", F.octet_length).alias("ids"))
    return rows.select("doc_id", text.count_id("ids", 5).alias("n"))


# --- vectors


@_query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.with_norms(_vectors(spark, sf_dir)).select(F.col("doc_id").alias("vec_id"), F.round("norm", 6).alias("norm"))


@_query(f"WITH vecs AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings), {_sql_cosine(K)} SELECT doc_id, score FROM near")
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(_vectors(spark, sf_dir), _query_vec(spark, sf_dir), K)


@_query(
    f"""WITH vecs AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings
    UNION ALL SELECT -1, list_transform(embedding::DOUBLE[], lambda x: 0.0) FROM embeddings WHERE vec_id = {QUERY_VEC_ID}),
    {_sql_cosine(10**9)} SELECT doc_id, score FROM near"""
)
def vector_zero_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _vectors(spark, sf_dir)
    zero = found.where(F.col("doc_id") == QUERY_VEC_ID).select(F.lit(-1).cast("long").alias("doc_id"), F.transform("embedding", lambda x: x * 0).alias("embedding"))
    return vectors.top_k(found.unionByName(zero), _query_vec(spark, sf_dir), None)


@_query(
    """WITH pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
    FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
    SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM pairs) WHERE rank <= 5"""
)
def vector_top_k_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _vectors(spark, sf_dir)
    asked = found.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return vectors.top_k_batch(found, asked, 5)


@_query(
    f"""WITH vecs AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings), {_sql_cosine(10**9)}
    SELECT CASE WHEN score > 0.5 THEN 'high' WHEN score > 0.3 THEN 'middle' ELSE 'low' END AS bucket, count(*) AS n FROM near GROUP BY 1"""
)
def score_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.top_k(_vectors(spark, sf_dir), _query_vec(spark, sf_dir), None)
    return near.groupBy(scores.bucket(F.col("score")).alias("bucket")).agg(F.count("*").alias("n"))


# --- fusion


@_query(f"WITH pairs AS ({_SQL_PAIRED}), vecs AS (SELECT doc_id, v FROM pairs), {_sql_cosine(5 * K)}, {_sql_bm25(QUERY, 'pairs', 5 * K)}, {_SQL_FUSED}")
def hybrid_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.top_k_hybrid(_paired(spark, sf_dir), QUERY, _query_vec(spark, sf_dir), K)


@_query(f"WITH pairs AS ({_SQL_PAIRED}), vecs AS (SELECT doc_id, v FROM pairs), {_sql_cosine(K)} SELECT doc_id, score FROM near")
def hybrid_blank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.top_k_hybrid(_paired(spark, sf_dir), " \t ", _query_vec(spark, sf_dir), K)


@_query(
    f"""WITH near AS (SELECT doc_id, n_chars::DOUBLE AS score FROM documents ORDER BY score DESC, doc_id LIMIT {5 * K}),
    hits AS (SELECT doc_id, -n_chars::DOUBLE AS score FROM documents ORDER BY score DESC, doc_id LIMIT {5 * K}), {_SQL_FUSED}"""
)
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    best = lambda x: x.orderBy(F.desc("score"), "doc_id").limit(5 * K)
    return fusion.fuse(fusion.ranks(best(rows), "v_rank"), fusion.ranks(best(rows.withColumn("score", -F.col("score"))), "b_rank"), K)


@_query(
    f"""WITH pairs AS ({_SQL_PAIRED}), asked AS (SELECT doc_id AS query_id, text, v AS q FROM pairs WHERE doc_id % 20 = 0),
    toks AS (SELECT doc_id, {_sql_tokens("text")} AS t FROM pairs),
    stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
    qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_sql_tokens("text")}) AS term FROM asked) GROUP BY query_id, term),
    post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM qt) GROUP BY doc_id, term),
    freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    b AS (SELECT query_id, doc_id, round(sum(qtf * {_SQL_IDF} * {_SQL_TF}), 6) AS score FROM post JOIN freq USING (term) JOIN qt USING (term), stats GROUP BY query_id, doc_id),
    br AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM b QUALIFY r <= {5 * K}),
    vr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q, pairs.v), 6) DESC, doc_id) AS r FROM asked, pairs QUALIFY r <= {5 * K}),
    fused AS (SELECT query_id, doc_id, round(coalesce(1.0 / (60 + vr.r), 0) + coalesce(1.0 / (60 + br.r), 0), 6)::DOUBLE AS score FROM vr FULL OUTER JOIN br USING (query_id, doc_id))
    SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM fused) WHERE rank <= {K}"""
)
def hybrid_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = written(_paired(spark, sf_dir))
    asked = pairs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"), F.col("embedding").alias("query_vec"))
    return fusion.top_k_hybrid_batch(pairs, asked, K)


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))


_SQL_NAMED = f"SELECT 'd' || doc_id AS doc_id, text, v FROM ({_SQL_PAIRED})"


@_query(
    f"""WITH vecs AS (SELECT doc_id, v FROM ({_SQL_NAMED})), {_sql_cosine(5 * K)}
    SELECT doc_id, round(1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)), 6)::DOUBLE AS score FROM near ORDER BY score DESC, doc_id LIMIT {K}"""
)
def hybrid_no_token_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String keys, and a query in which the tokenizer finds nothing."""
    return fusion.top_k_hybrid(_named(_paired(spark, sf_dir)), "?", _query_vec(spark, sf_dir), K)


@_query(
    f"""WITH pairs AS ({_SQL_NAMED}), {_sql_bm25(QUERY, 'pairs', 5 * K)}
    SELECT doc_id, round(1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)), 6)::DOUBLE AS score FROM hits ORDER BY score DESC, doc_id LIMIT {K}"""
)
def hybrid_zero_vector_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String keys, and a query whose vector has no length."""
    return fusion.top_k_hybrid(_named(_paired(spark, sf_dir)), QUERY, [0.0] * 64, K)


@_query(
    f"""WITH v AS (SELECT doc_id % 97 AS doc_id, max(doc_id + 1) AS r FROM documents GROUP BY 1), b AS (SELECT doc_id % 89 AS doc_id, max(doc_id + 1) AS r FROM documents GROUP BY 1)
    SELECT doc_id, round(coalesce(1.0 / (60 + v.r), 0) + coalesce(1.0 / (60 + b.r), 0), 6)::DOUBLE AS score FROM v FULL OUTER JOIN b USING (doc_id) ORDER BY score DESC, doc_id LIMIT {K}"""
)
def rrf_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key that a list repeats counts with its last, worst rank."""
    rows = _table(spark, sf_dir, "documents").select("doc_id")
    ranked = lambda by, name: rows.select((F.col("doc_id") % by).alias("doc_id"), (F.col("doc_id") + 1).alias(name))
    return fusion.fuse(ranked(97, "v_rank"), ranked(89, "b_rank"), K)


# --- windows of tokens


@_query(
    f"""WITH l AS (SELECT doc_id, len({_sql_tokens("text")}) AS n FROM documents),
    p AS (SELECT doc_id, n, unnest(range(0, 50 * greatest(0, ceil((n - 254) / 50.0))::BIGINT + 1, 50)) AS pos FROM l)
    SELECT doc_id, (pos // 50)::INT AS chunk, pos::INT AS pos, least(pos + 254, n)::INT AS "end" FROM p"""
)
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = bm25.doc_lengths(_corpus(spark, sf_dir)).withColumnRenamed("dl", "n_tokens")
    return chunking.chunk_plan(lengths)


@_query(
    f"""WITH t AS (SELECT doc_id, {_sql_tokens("text")} AS t FROM documents),
    p AS (SELECT doc_id, t, unnest(range(0, 50 * greatest(0, ceil((len(t) - 254) / 50.0))::BIGINT + 1, 50)) AS pos FROM t)
    SELECT doc_id, (pos // 50)::INT AS chunk, sha256(array_to_string(t[pos + 1 : pos + 254], ' ')) AS digest FROM p"""
)
def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.chunks(bm25.tokenized(_corpus(spark, sf_dir)).select("doc_id", "tokens"))
    return rows.select("doc_id", "chunk", F.sha2(F.array_join("tokens", " "), 256).alias("digest"))


@_query(
    """WITH m AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos)
    SELECT label, pos::INT AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS value FROM m"""
)
def chunk_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = chunking.mean_pooled(_table(spark, sf_dir, "embeddings").select("label", "embedding"), "label")
    return pooled.select("label", F.posexplode("embedding").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("value"))


@_query("SELECT doc_id, strlen(text)::INT AS n_bytes, strlen(text) > 10000 AS chunked FROM documents")
def size_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).select("doc_id", F.octet_length("text").alias("n_bytes"), text.needs_chunks("text").alias("chunked"))


# --- text expressions


@_query("SELECT page_id, regexp_replace(html, '<[^>]*>?|>', '', 'g') AS text FROM pages")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", text.strip_tags("html").alias("text"))


@_query("SELECT doc_id, sha256(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160))) AS hash, trim(text) = '' AS blank FROM documents")
def trimmed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).select("doc_id", text.content_hash(text.unicode_trim("text")).alias("hash"), text.is_blank("text").alias("blank"))


@_query(
    """WITH p AS (SELECT page_id, url, string_split(url, '/')[-1] AS name FROM pages)
    SELECT page_id, name, regexp_extract(name, '^.+\\.([^.]*)$', 1) AS extension, regexp_extract(name, '^.+\\.([^.]*)$', 1) IN ('txt', 'pdf', 'docx', 'doc') AS known FROM p"""
)
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", text.file_name("url").alias("name"), text.extension("url").alias("extension"), text.has_known_extension("url").alias("known"))


@_query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))[1:500]) AS line, generate_subscripts(string_split(text, chr(10))[1:500], 1) AS line_no FROM documents)
    SELECT doc_id, line_no::INT AS line_no, line FROM l WHERE contains(lower(line), 'the') OR contains(lower(line), 'rest') OR contains(lower(line), 'ción')"""
)
def preview_match_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview.preview_lines(_corpus(spark, sf_dir), PREVIEW).where("matches").select("doc_id", "line_no", "line")


@_query("SELECT doc_id, strlen(text) > 40000 AS is_cut FROM documents")
def preview_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).select("doc_id", preview.is_cut(F.col("text")).alias("is_cut"))


# --- files: texts, pages and names as the three kinds of files

_SQL_TRIM = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160))"


def _as_docx(markup: pd.Series) -> pd.Series:
    def one(x: str) -> bytes:
        out = BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            archive.writestr("word/document.xml", x)
        return out.getvalue()

    return markup.map(one)


def _as_pdf(words: pd.Series) -> pd.Series:
    return words.map(lambda x: b"%PDF-1.4\n1 0 obj<</Length 9>>stream\nBT (" + x.encode() + b") Tj ET\nendstream endobj")


@_query(
    f"""SELECT 'd' || doc_id || '.txt' AS path, {_SQL_TRIM.format("text")} AS text, NULL::VARCHAR AS error FROM documents
    UNION ALL SELECT 'p' || page_id || '.docx', {_SQL_TRIM.format("regexp_replace(html, '<[^>]*>?|>', '', 'g')")}, NULL FROM pages
    UNION ALL SELECT 'n' || n_nationkey || '.pdf', n_name, NULL FROM nation
    UNION ALL SELECT 'r' || r_regionkey || '.docx', '', 'unreadable' FROM region"""
)
def extract_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of plain, DOCX and PDF files, and of files that are not what their names say."""
    kinds = [
        ("documents", F.concat(F.lit("d"), "doc_id", F.lit(".txt")), F.col("text").cast("binary")),
        ("pages", F.concat(F.lit("p"), "page_id", F.lit(".docx")), F.pandas_udf(_as_docx, "binary")("html")),
        ("nation", F.concat(F.lit("n"), "n_nationkey", F.lit(".pdf")), F.pandas_udf(_as_pdf, "binary")("n_name")),
        ("region", F.concat(F.lit("r"), "r_regionkey", F.lit(".docx")), F.col("r_name").cast("binary")),
    ]
    made = [_table(spark, sf_dir, n).select(path.alias("path"), F.lit(None).cast("timestamp").alias("mtime"), content.alias("content")) for n, path, content in kinds]
    rows = files.extract(reduce(DataFrame.unionAll, made))
    return rows.select("path", "text", F.when(F.col("error").isNotNull(), "unreadable").alias("error"))


@_query("SELECT 'd' || doc_id AS path, sha256(text) AS hash, 64 AS dimension, (SELECT count(*) FROM documents JOIN embeddings ON doc_id = vec_id) AS size FROM documents JOIN embeddings ON doc_id = vec_id")
def store_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a snapshot store reads back of the records that it published."""
    rows = _named(_paired(spark, sf_dir)).select(F.col("doc_id").alias("path"), F.lit(None).cast("timestamp").alias("mtime"), F.sha2("text", 256).alias("hash"), "text", F.lit(None).cast("string").alias("error"), "embedding")
    now = SnapshotStore(spark, new_path(spark)).publish(rows)
    return now.records.select("path", "hash", F.lit(now.dimension).alias("dimension"), F.lit(len(now)).cast("long").alias("size"))


# --- snapshots: documents are the records; the disk has lost a source, changed a language and got the pages

_SQL_SNAPSHOTS = """WITH records AS (SELECT 'd' || doc_id AS path, sha256(text) AS hash, text FROM documents),
    disk AS (SELECT 'd' || doc_id AS path, sha256(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS hash, CASE WHEN lang = 'de' THEN text || '!' ELSE text END AS text FROM documents WHERE source != 'src3'
             UNION ALL SELECT 'p' || page_id, sha256(html), html FROM pages)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = _table(spark, sf_dir, "documents")
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path")
    hashed = lambda df: df.select("path", F.sha2("text", 256).alias("hash"), "text")
    records = hashed(documents.select(path, "text"))
    later = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text")
    pages = _table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("text"))
    return hashed(documents.where("source != 'src3'").select(path, later).unionAll(pages)), records


@_query(f"{_SQL_SNAPSHOTS} SELECT path, hash FROM disk WHERE path NOT IN (SELECT path FROM records)")
def snapshot_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.added(*_snapshots(spark, sf_dir)).select("path", "hash")


@_query(f"{_SQL_SNAPSHOTS} SELECT d.path, d.hash FROM disk d JOIN records r USING (path) WHERE d.hash != r.hash")
def snapshot_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.changed(*_snapshots(spark, sf_dir)).select("path", "hash")


@_query(f"{_SQL_SNAPSHOTS} SELECT d.path, d.hash FROM disk d LEFT JOIN records r USING (path) WHERE r.path IS NULL OR d.hash != r.hash")
def snapshot_new_or_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.new_or_changed(*_snapshots(spark, sf_dir)).select("path", "hash")


@_query(f"{_SQL_SNAPSHOTS} SELECT path, hash FROM records WHERE path NOT IN (SELECT path FROM disk)")
def snapshot_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.removed(*_snapshots(spark, sf_dir)).select("path", "hash")


@_query(f"{_SQL_SNAPSHOTS} SELECT path, hash FROM records WHERE path IN (SELECT path FROM disk)")
def snapshot_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.kept(*_snapshots(spark, sf_dir)).select("path", "hash")


@_query(f"{_SQL_SNAPSHOTS} SELECT false AS differing, true AS itself")
def snapshot_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    disk, records = _snapshots(spark, sf_dir)
    found = snapshots.same(disk, records), snapshots.same(records, records)
    return spark.createDataFrame([found], "differing boolean, itself boolean")


@_query(f"{_SQL_SNAPSHOTS} SELECT path, hash FROM disk")
def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    disk, records = _snapshots(spark, sf_dir)
    fresh = snapshots.new_or_changed(disk, records)
    return snapshots.upsert(disk, records, fresh).select("path", "hash")


@_query(f"WITH vecs AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings), {_sql_cosine(K)} SELECT printf('%3d. %.3f %s', row_number() OVER (ORDER BY score DESC, doc_id), score, doc_id::VARCHAR) AS line FROM near")
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.top_k(_vectors(spark, sf_dir), _query_vec(spark, sf_dir), K)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))  # K rows
    return near.select(scores.formatted(rank, F.col("score"), F.col("doc_id").cast("string")).alias("line"))
