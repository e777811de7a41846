import math

import pytest

from tessera.operators import blocks, bm25, fusion, vectors

CATS = [(0, "the cat sits on the mat"), (1, "the dog runs in the park"), (2, "cats and dogs are pets")]


def corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def found(df):
    return [tuple(r) for r in df.collect()]


def brute(rows, query, k):
    from collections import Counter

    from tessera.functions.text import token_list

    docs = {i: token_list(t or "") for i, t in rows}
    n, avg = len(docs), sum(map(len, docs.values())) / max(1, len(docs))
    df = Counter(t for d in docs.values() for t in set(d))
    scores = {}
    for i, d in docs.items():
        tf = Counter(d)
        hits = [t for t in token_list(query) if tf[t]]
        if hits:
            scores[i] = round(sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / avg)) for t in hits), 6)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("query", ["cat", "dog", "the the park", "pets cats", ""])
def test_bm25_equals_brute_force(spark, query):
    rows = [*CATS, (3, ""), (4, None)]
    expected = brute(rows, query, 3)
    assert found(bm25.search_corpus(corpus(spark, rows), query, 3)) == expected
    assert found(bm25.Bm25Index.build(corpus(spark, rows)).search(query, 3)) == expected


def test_exact_tokens_win(spark):
    assert found(bm25.search_corpus(corpus(spark, CATS), "cat", 3))[0][0] == 0
    assert found(bm25.search_corpus(corpus(spark, CATS), "dog", 3))[0][0] == 1


def test_unknown_terms_and_empty_corpora_give_nothing(spark):
    assert found(bm25.search_corpus(corpus(spark, [(0, "hello world")]), "zzzznotfound", 5)) == []
    assert found(bm25.search_corpus(corpus(spark, []), "hello", 5)) == []
    assert found(bm25.search_corpus(corpus(spark, CATS), "cat", 0)) == []


def test_a_repeated_term_doubles(spark):
    once, twice = (found(bm25.search_corpus(corpus(spark, CATS), q, 1))[0][1] for q in ("cat", "cat cat"))
    assert twice == pytest.approx(2 * once, abs=2e-6)


def test_batch_equals_single_queries(spark):
    asked = {1: "cat mat", 2: "the dog the", 3: "none here at all zz", 4: ""}
    got = found(bm25.search_batch(corpus(spark, CATS), spark.createDataFrame(list(asked.items()), "query_id long, query string"), 2))
    for q, words in asked.items():
        assert [(d, s) for i, _, d, s in sorted(got) if i == q] == brute(CATS, words, 2)


def test_saved_index(spark, tmp_path):
    index = bm25.Bm25Index.build(corpus(spark, CATS)).save(str(tmp_path / "i"))
    assert found(index.search("cat", 3)) == brute(CATS, "cat", 3) and len(index) == 3


VECTORS = [(0, [0.1, 0.2, 0.3]), (1, [0.4, 0.5, 0.6]), (2, [0.7, 0.8, 0.9]), (3, [0.0, 0.0, 0.0]), (4, [-1.0, -1.0, -1.0])]


def vecs(spark, rows=VECTORS):
    return spark.createDataFrame(rows, "doc_id long, embedding array<float>")


def test_cosine_order_and_zero_vector(spark):
    got = found(vectors.top_k(vecs(spark), [0.35, 0.45, 0.55], 5))
    assert [i for i, _ in got] == [1, 2, 0, 3, 4] and got[3] == (3, 0.0)


def test_vector_guards(spark):
    assert found(vectors.top_k(vecs(spark), [1.0, 2.0], 3)) == []
    assert found(vectors.top_k(vecs(spark), [0.0, 0.0, 0.0], 3)) == []
    assert found(vectors.top_k(vecs(spark), [1.0, 2.0, 3.0], 0)) == []
    assert found(vectors.top_k(vecs(spark, []), [1.0, 2.0, 3.0], 3)) == []
    assert len(found(vectors.top_k(vecs(spark), [1.0, 2.0, 3.0], 100))) == 5
    assert len(found(vectors.top_k(vecs(spark), [1.0, 2.0, 3.0], 10**9))) == 5


def test_stored_norms_change_nothing(spark):
    query = [0.3, 0.1, 0.2]
    assert found(vectors.top_k(vectors.with_norms(vecs(spark)), query, 4)) == found(vectors.top_k(vecs(spark), query, 4))


def test_vector_batch(spark):
    asked = spark.createDataFrame([(9, [0.3, 0.1, 0.2]), (8, [0.0, 0.0, 0.0])], "query_id long, query_vec array<float>")
    got = found(vectors.top_k_batch(vecs(spark), asked, 3))
    single = found(vectors.top_k(vecs(spark), [0.30000001192092896, 0.10000000149011612, 0.20000000298023224], 3))
    assert [(d, s) for _, _, d, s in sorted(got)] == single


@pytest.mark.parametrize(
    ("v", "b", "expected"),
    [
        ([("a", 1), ("b", 2)], [("a", 1)], [("a", 2 / 61), ("b", 1 / 62)]),
        ([("a", 1), ("b", 2)], [("b", 1), ("a", 2)], [("a", 1 / 61 + 1 / 62), ("b", 1 / 61 + 1 / 62)]),
        ([("a", 1)], [("c", 1)], [("a", 1 / 61), ("c", 1 / 61)]),
        ([("a", 1), ("a", 3)], [], [("a", 1 / 63)]),
    ],
)
def test_fusion(spark, v, b, expected):
    left = spark.createDataFrame(v, "doc_id string, v_rank int")
    right = spark.createDataFrame(b, "doc_id string, b_rank int")
    assert found(fusion.fuse(left, right, 5)) == [(k, round(s, 6)) for k, s in expected]


def test_hybrid_and_its_fallback(spark):
    rows = spark.createDataFrame([(i, t, VECTORS[i][1]) for i, t in CATS], "doc_id long, text string, embedding array<float>")
    query_vec = [0.35, 0.45, 0.55]
    got = found(fusion.top_k_hybrid(rows, "cat", query_vec, 3))
    assert got == [(0, round(1 / 63 + 1 / 61, 6)), (1, round(1 / 61, 6)), (2, round(1 / 62, 6))]
    assert found(fusion.top_k_hybrid(rows, " ", query_vec, 2)) == found(vectors.top_k(rows.select("doc_id", "embedding"), query_vec, 2))
    asked = spark.createDataFrame([(5, "cat", query_vec)], "query_id long, query string, query_vec array<float>")
    assert [(d, s) for _, _, d, s in sorted(found(fusion.top_k_hybrid_batch(rows, asked, 3)))] == got


NAMED = [("b", "किताब पढ़ना"), ("a", "หนังสือ ที่นี่"), ("c", "كِتَاب جديد"), ("d", "किताब किताब other")]


@pytest.mark.parametrize("query", ["किताब", "หนังสือ", "كِتَاب"])
def test_scripts_with_combining_signs_give_the_same_hits_singly_and_in_a_batch(spark, query):
    rows = spark.createDataFrame(NAMED, "doc_id string, text string")
    single = found(bm25.search_corpus(rows, query, 5))
    batch = bm25.search_batch(rows, spark.createDataFrame([(1, query)], "query_id long, query string"), 5)
    assert single and [(d, s) for _, _, d, s in sorted(found(batch))] == single
    assert found(bm25.Bm25Index.build(rows).search(query, 5)) == single


@pytest.mark.parametrize(("query", "query_vec"), [("?", [1.0, 2.0, 3.0]), ("x", [1.0, 2.0, 3.0]), ("किताब", [0.0, 0.0, 0.0]), ("?", [0.0, 0.0, 0.0])])
def test_hybrid_on_string_keys_where_one_list_is_empty(spark, query, query_vec):
    rows = spark.createDataFrame([(i, t, v) for (i, t), (_, v) in zip(NAMED, VECTORS)], "doc_id string, text string, embedding array<float>")
    got = fusion.top_k_hybrid(rows, query, query_vec, 3)
    assert got.schema["doc_id"].dataType.simpleString() == "string"
    assert len(found(got)) == (3 if any(query_vec) else 2 if query == "किताब" else 0)
    index = bm25.Bm25Index.build(rows.select("doc_id", "text"))
    assert found(fusion.top_k_hybrid(rows, query, query_vec, 3, index)) == found(got)


def test_best_is_sorted_for_every_k(spark, monkeypatch):
    rows = spark.createDataFrame([(i, float(i % 7)) for i in range(50)], "doc_id long, score double").repartition(4)
    monkeypatch.setattr(bm25, "LARGE_K", 20)
    expected = sorted(((i, float(i % 7)) for i in range(50)), key=lambda r: (-r[1], r[0]))
    for k in (5, 21, 49, 50, 10**10):
        assert found(bm25.best(rows, k)) == expected[:k]


def test_repeated_ids_are_documents_of_their_own(spark):
    rows = [(1, "cat dog"), (1, "cat"), (2, "dog dog"), (None, "cat cat")]
    single = found(bm25.search_corpus(corpus(spark, rows), "cat", 9))
    assert sorted(x[0] for x in single if x[0]) == [1, 1] and len(single) == 3
    asked = spark.createDataFrame([(7, "cat")], "query_id long, query string")
    assert sorted(s for *_, s in found(bm25.search_batch(corpus(spark, rows), asked, 9))) == sorted(s for _, s in single)


def test_documents_are_added_and_cleared(spark):
    index = bm25.Bm25Index.build(corpus(spark, CATS[:1])).added(corpus(spark, CATS[1:]))
    assert len(index) == 3 and found(index.search("the dog", 3)) == brute(CATS, "the dog", 3)
    assert len(index.cleared()) == 0 and found(index.cleared().search("dog", 3)) == []


def test_counts_in_a_row(spark):
    rows = [(1, "bb aa bb cc bb"), (2, ""), (3, None), (4, "zz")]
    got = {r.doc_id: (r.dl, [tuple(x) for x in r.counts]) for r in bm25.counted(corpus(spark, rows)).collect()}
    assert got == {1: (5, [("aa", 1), ("bb", 3), ("cc", 1)]), 2: (0, []), 3: (0, []), 4: (1, [("zz", 1)])}


def test_vector_batch_equals_single_queries_with_ties_and_odd_rows(spark, monkeypatch):
    import random

    rng = random.Random(5)
    monkeypatch.setattr(blocks, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(vectors, "QUERIES_AT_ONCE", 3)
    rows = [(f"v{i:02}", [rng.choice([0.0, 1.0, -1.0]) for _ in range(3)]) for i in range(60)]
    rows += [("odd", [1.0, 2.0]), ("none", None), ("hole", [1.0, None, 2.0]), ("empty", [])]
    asked = [(i, [rng.choice([0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(8)] + [(20, [1.0, 1.0]), (21, None), (22, [None, 1.0, 2.0])]
    table = spark.createDataFrame(rows, "doc_id string, embedding array<float>")
    got = found(vectors.top_k_batch(table, spark.createDataFrame(asked, "query_id long, query_vec array<float>"), 10))
    complete = table.where("embedding is null or not exists(embedding, x -> x is null)")
    for q, v in asked:
        expected = found(vectors.top_k(complete, v, 10)) if v and None not in v else []
        assert [(d, s) for i, _, d, s in sorted(got) if i == q] == expected
    assert found(vectors.top_k_batch(table, spark.createDataFrame(asked, "query_id long, query_vec array<float>"), 0)) == []


def test_batch_in_blocks_equals_single_queries(spark, monkeypatch):
    import random

    rng = random.Random(8)
    monkeypatch.setattr(bm25, "TERMS_AT_ONCE", 20)
    words = "aa bb cc dd ee ff gg hh ii jj".split()
    rows = [(i, " ".join(rng.choices(words, range(1, 11), k=rng.randint(0, 12)))) for i in range(80)] + [(200, None)]
    asked = {i: " ".join(rng.choices(words + ["zz"], k=rng.randint(1, 6))) for i in range(30)}
    got = found(bm25.search_batch(corpus(spark, rows), spark.createDataFrame(list(asked.items()), "query_id long, query string"), 4))
    for q, text in asked.items():
        assert [(d, s) for i, _, d, s in sorted(got) if i == q] == brute(rows, text, 4)
    assert found(bm25.search_batch(corpus(spark, []), spark.createDataFrame([(1, "aa")], "query_id long, query string"), 4)) == []


def test_best_of_a_task(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    scores = rng.integers(-1, 4, (3, 200)).astype(float)
    monkeypatch.setattr(blocks, "SLACK", 1)
    best = blocks.Best(pa.array(["x", "y", "z"]), 5)
    for at in range(0, 200, 13):
        best.add(pa.array(range(at, min(at + 13, 200))), scores[:, at : at + 13])
    got = pa.Table.from_batches(best.batches()).to_pylist()
    for i, name in enumerate("xyz"):
        expected = sorted(((-s, d) for d, s in enumerate(scores[i]) if s >= 0))[:5]
        assert [(-r["score"], r["doc_id"]) for r in got if r["query_id"] == name] == expected
