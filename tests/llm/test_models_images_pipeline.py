import zlib

import numpy as np
import pytest
from texts import prose

from tessera.llm import image_copies as ic
from tessera.llm import quality, toxicity


def labelled(spark, rng, n=900):
    rows, labels = [], []
    for i in range(n):
        text, good, toxic = prose(rng, rng.randint(20, 120)).capitalize() + ".", 1, 0
        kind = rng.random()
        if kind < 0.12:
            text, good = " ".join(w + rng.choice(["***", "%%%", "&&&"]) for w in text.split()), 0
        elif kind < 0.2:
            text, good = text.upper().replace(" ", "!! "), 0
        elif kind < 0.4:
            words = text.split()
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice("moron idiot scum trash zqrfel zqrfob zqrfin".split()))
            text, toxic = " ".join(words), 1
        rows.append((i, text))
        if rng.random() < 0.7:
            labels.append((i, good, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_chain_on_documents_it_has_not_seen(spark, rng, awkward, empty):
    documents, labels, known = labelled(spark, rng)
    chain = toxicity.train(documents, labels.where("doc_id % 3 != 0"))
    assert chain.names == ["kind_1", "kind_2", "toxic"]
    assert [len(w) - len(chain.dictionary) for w in chain.weights] == [1, 2, 3]
    got = {r.doc_id: r for r in toxicity.score(documents, chain).collect()}
    unseen = [(i, t) for i, _, t in known if i % 3 == 0]
    assert np.mean([got[i].toxic == bool(t) for i, t in unseen]) > 0.93
    assert {r.doc_id for r in toxicity.without_toxic(documents, labels).collect()} >= {i for i, _, t in known if not t}
    assert toxicity.score(awkward, chain).count() == awkward.count() and toxicity.score(empty, chain).count() == 0
    none = toxicity.train(documents, labels.limit(0))
    assert not any(r.toxic for r in toxicity.score(documents, none).collect())
    assert toxicity.train(empty, labels).dictionary == {}


def sparse(x):
    return toxicity.Sparse.of([np.flatnonzero(r) for r in x], x.shape[1])


def test_logistic_equals_plain_gradient_descent():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (300, 5)).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] - 0.5)))).astype(float)
    w = np.zeros(6)
    for _ in range(30_000):
        error = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y
        w -= 0.5 * np.append(x.T @ error / 300 + 2e-4 * w[:-1], error.mean())
    assert np.allclose(toxicity.fit_logistic(sparse(x), y, close=1e-8), w, atol=1e-3)
    assert toxicity.fit_logistic(sparse(x), np.ones(300))[-1] > 9


def test_out_of_fold_chain():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (600, 6)).astype(float)
    a = x[:, 0]
    chain = toxicity.fit_chain(sparse(x), np.column_stack([a, a * x[:, 1]]), ["a", "b"], {str(i): i for i in range(6)})
    assert [len(w) for w in chain.weights] == [7, 8]
    assert chain.weights[0][0] > 3 and chain.weights[1][1] > 3 and chain.weights[1][6] > 0.5


def test_kinds_are_found_in_the_data():
    rng = np.random.default_rng(1)
    x = np.zeros((400, 30))
    x[:, 10:] = rng.random((400, 20)) < 0.3
    kind = np.arange(400) % 4  # two of four are toxic, each with words of its own
    for i in range(400):
        if kind[i] < 2:
            x[i, 5 * kind[i] : 5 * kind[i] + 5] = rng.random(5) < 0.8
    found = toxicity.kinds_of(sparse(x), (kind < 2).astype(float))
    assert not found[kind >= 2].any() and (found[kind < 2].sum(axis=1) == 1).all()
    same = found[kind == 0, 0].mean()
    assert max(same, 1 - same) > 0.95 and abs(same - found[kind == 1, 0].mean()) > 0.9


def test_chain_over_label_columns(spark, rng):
    documents, labels, known = labelled(spark, rng, 600)
    several = labels.selectExpr("doc_id", "1 - quality as poor", "toxic")
    chain = toxicity.train(documents, several, ("poor", "toxic"))
    assert chain.names == ["poor", "toxic"]
    got = {r.doc_id: r for r in toxicity.score(documents, chain).collect()}
    assert np.mean([got[i].toxic == bool(t) for i, _, t in known]) > 0.95


def test_samples_have_their_size_at_any_total(spark):
    from tessera.llm.common import hash_limit, sampled

    for total in (10, 10**5, 10**11, 10**18):
        share = (hash_limit(12_000, total) + 2**63 + 1) / 2**64
        assert abs(share * total - min(total, 12_000)) < 1
    ids = spark.range(40_000).withColumnRenamed("id", "doc_id")
    assert abs(sampled(ids, 4_000, 40_000, 1).count() - 4_000) < 400
    assert sampled(ids, 50_000, 40_000, 1).count() == 40_000 and sampled(ids, 10, 10**15, 1).count() == 0


def test_an_empty_sample_of_labels_is_an_error(spark, rng, monkeypatch):
    documents, labels, _ = labelled(spark, rng, 40)
    for module in (toxicity, quality):
        monkeypatch.setattr(module, "sampled", lambda df, *_, **__: df.limit(0))
        with pytest.raises(ValueError):
            module.train(documents, labels)


def test_quality_on_held_out_labels(spark, rng, awkward, empty):
    documents, labels, known = labelled(spark, rng)
    model = quality.train(documents, labels)
    got = {r.doc_id: r for r in quality.score(documents, model).collect()}
    held = [(i, q) for i, q, _ in known if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in held) and sum(r.held_out for r in got.values()) < 300
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert np.mean([got[i].predicted == q for i, q in held]) > 0.95
    assert quality.score(awkward, model).count() == awkward.count() and quality.score(empty, model).count() == 0
    assert quality.train(empty, labels.limit(0)).scores(np.zeros((1, quality.N_FEATURES)))[0] == 0.5


def test_held_out_labels_change_nothing(spark, rng):
    documents, labels, _ = labelled(spark, rng, 300)
    flipped = labels.withColumn("quality", __import__("pyspark.sql.functions", fromlist=["x"]).when(quality.held_out(), 1 - labels.quality).otherwise(labels.quality))
    a, b = (quality.train(documents, x).weights for x in (labels, flipped))
    assert np.array_equal(a, b)


def test_prior_and_risk():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(1.5, 1, (4000, 2)), rng.normal(-1.5, 1, (4000, 2))
    one = lambda z: np.hstack([z, np.ones((len(z), 1))])
    positive, unlabelled = one(good[:2000]), one(np.vstack([good[2000:3400], bad[:600]]))
    prior = quality.estimate_prior(positive, unlabelled)
    assert abs(prior - 0.7) < 0.08
    w = quality.fit_risk(positive, unlabelled, prior)
    assert np.mean(one(good[3400:]) @ w > 0) > 0.9 and np.mean(one(bad[600:]) @ w < 0) > 0.9


def test_netpbm():
    grey = np.arange(12.0).reshape(3, 4)
    assert np.array_equal(ic.read_netpbm(ic.write_pgm(grey)), grey)
    assert ic.read_netpbm(b"P6 # note\n1 1 255\n\x03\x06\x09").tolist() == [[6.0]]
    for bad in (None, b"", b"P5", b"P5 9 9 255\n1", b"JPEG", b"P5 # open"):
        assert ic.read_netpbm(bad) is None


def test_image_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(i * 10, [float(x) for x in rng.normal(size=8)]) for i in range(12)]
    scenes = {i: ic.drawn(np.array(v, np.float32).tobytes()) for i, v in rows}
    images = [(i, ic.write_pgm(s)) for i, s in scenes.items()]
    images += [(i + 1 + kind, ic.write_pgm(ic.edited(scenes[i], kind, 5))) for i in (0, 10, 20) for kind in range(4)]
    images += [(500, images[0][1]), (None, images[1][1]), (600, None), (601, b"no image"), (602, None)]
    got = {r.image_id: r for r in ic.image_copies(spark.createDataFrame(images, "image_id long, image binary")).collect()}
    assert len(got) == len(images)
    linked = sum(got[i + 1 + kind].component_id == i for i in (0, 10, 20) for kind in range(4))
    assert linked >= 11
    assert all(got[i].component_id == i for i in range(30, 120, 10))
    assert got[500].class_id == 0 and got[None].class_id == 10 and got[602].class_id == 600 and got[601].component_id == 601
    assert ic.image_copies(spark.createDataFrame([], "image_id long, image binary")).count() == 0


def test_images_from_embeddings(spark):
    rows = spark.createDataFrame([(3, [1.0, 2.0]), (4, None), (None, [1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.image_id for r in ic.images_from_embeddings(rows).collect()), key=str) == [6, 7, 8, None]


def test_pipeline(spark, rng, tmp_path):
    import corpus_pipeline as pipeline

    documents, labels, known = labelled(spark, rng, 300)
    item = prose(rng, 25)
    passage = prose(rng, 60)
    extra = [(1000, prose(rng, 30) + " " + item), (1001, prose(rng, 90)), (1003, "x " + passage), (1004, passage + "\n" + prose(rng, 40)), (1005, prose(rng, 10) + "\n" + passage + "\n" + prose(rng, 10)), (1006, None), (1007, "")]
    extra.append((1002, extra[1][1]))
    rows = documents.union(spark.createDataFrame(extra, "doc_id long, text string"))
    full = rows.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars")
    full.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == full.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    toxic = {i for i, _, t in known if t}
    assert len(toxic & ids[0]) <= 2 and {i for i, _, t in known if not t} <= ids[0]
    texts = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "out1")).collect()}
    assert ids[1] == ids[0] and passage in texts[1003]
    whole = {i: len(t.split()) for i, t in extra if t}
    assert all(whole[i] - len(texts[i].split()) > 40 for i in (1004, 1005)) and len(texts[1004].split()) >= 40
    assert 1001 in ids[2] and ids[2] & {1002, 1006, 1007} == {1002}  # one of the empty ones; 1002 is a copy whose lines went
    assert 1000 in ids[2] and 1000 not in ids[3] and ids[2] - ids[3] == {1000}
    assert ids[4] == ids[3]
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == ids[4]
