import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.operators import chunking, preview, snapshots
from tessera.sources import embedders


def plan(spark, lengths):
    rows = chunking.chunk_plan(spark.createDataFrame([(n, n) for n in lengths], "doc_id long, n_tokens int")).collect()
    out = {}
    for n, _, pos, end in sorted(rows):
        out.setdefault(n, []).append((pos, end))
    return out


def test_windows(spark):
    lengths = [0, 1, 254, 255, 304, 305, 510, 1000]
    got = plan(spark, lengths)
    assert [len(got[n]) for n in lengths] == [1, 1, 1, 2, 2, 3, 7, 16]
    assert [got[n][-1] for n in (255, 304, 305, 510, 1000)] == [(50, 255), (50, 304), (100, 305), (300, 510), (750, 1000)]
    assert all(got[n] == embedders.windows(n) for n in lengths)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 3000))
def test_windows_cover_everything(n):
    found = embedders.windows(n)
    assert found[0][0] == 0 and found[-1][1] == n
    assert all(b <= a_end for (_, a_end), (b, _) in zip(found, found[1:], strict=False))


def test_pooling(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])], "g int, embedding array<float>")
    got = {g: v for g, v in chunking.mean_pooled(rows, "g").collect()}
    assert got[1] == pytest.approx([0.5**0.5, 0.5**0.5]) and got[2] == [0.0, 0.0]


def test_scores(spark):
    row = spark.range(1).select(
        scores.bucket(F.lit(0.5)), scores.bucket(F.lit(0.51)), scores.bucket(F.lit(0.3)), scores.tf_weight(F.lit(1), F.lit(0), F.lit(3.0)), scores.reciprocal_rank(F.lit(None).cast("int"))
    ).first()
    assert tuple(row) == ("middle", "high", "low", 0.0, 0.0)


def test_preview(spark):
    docs = spark.createDataFrame([(1, "The Cat\nno\nconcat"), (2, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in preview.preview_lines(docs, "CAT x").collect())
    assert got == [(1, 1, "The Cat", True), (1, 2, "no", False), (1, 3, "concat", True), (2, 1, "[error reading file]", False)]
    assert not any(r.matches for r in preview.preview_lines(docs, "c").collect())
    assert len(preview.preview_lines(docs, "cat", most=2).where("doc_id = 1").collect()) == 2


SNAPSHOT = st.dictionaries(st.sampled_from("abcdef"), st.sampled_from(["1", "2", "3"]), max_size=6)


@settings(max_examples=8, deadline=None)
@given(SNAPSHOT, SNAPSHOT)
def test_snapshot_differences(spark, disk, records):
    d, r = (spark.createDataFrame(list(x.items()), "path string, hash string") for x in (disk, records))
    paths = lambda df: {x.path for x in df.collect()}
    assert paths(snapshots.added(d, r)) == set(disk) - set(records)
    assert paths(snapshots.removed(d, r)) == set(records) - set(disk)
    assert paths(snapshots.changed(d, r)) == {p for p in disk if p in records and disk[p] != records[p]}
    fresh = snapshots.new_or_changed(d, r)
    assert paths(fresh) == {p for p in disk if records.get(p) != disk[p]}
    assert snapshots.same(d, r) == (disk == records)
    assert {x.path: x.hash for x in snapshots.upsert(d, r, fresh).collect()} == disk


def test_hashing_embedder_and_long_texts():
    e = embedders.HashingEmbedder(64)
    short, long = embedders.embed(e, "hello world"), embedders.embed(e, "hello world " * 2000)
    assert np.linalg.norm(short) == pytest.approx(1) and np.linalg.norm(long) == pytest.approx(1)
    assert not embedders.embed(e, " \n").any()
    hidden, mask = np.array([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]]), np.array([1, 1, 0])
    assert embedders.masked_mean(hidden, mask).tolist() == [2.0, 3.0]


def test_windows_of_repeated_ids_do_not_mix(spark):
    from tessera.operators.chunking import chunks

    rows = [(1, [f"a{i}" for i in range(7)]), (1, [f"b{i}" for i in range(4)]), (2, None), (3, [])]
    got = chunks(spark.createDataFrame(rows, "doc_id long, tokens array<string>"), width=4, hop=3).collect()
    assert sorted((r.doc_id, r.chunk, r.pos, r.end, "".join(r.tokens)) for r in got) == [
        (1, 0, 0, 4, "a0a1a2a3"), (1, 0, 0, 4, "b0b1b2b3"), (1, 1, 3, 7, "a3a4a5a6"), (2, 0, 0, 0, ""), (3, 0, 0, 0, ""),
    ]


def test_a_cluster_without_a_shared_folder_is_an_error():
    import pytest

    from tessera.scratch import NoSharedFolder, shared_folder

    class Session:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda key, default: None)

    with pytest.raises(NoSharedFolder):
        shared_folder(Session)
    Session.conf.get = staticmethod(lambda key, default: "hdfs://x/y/")
    assert shared_folder(Session) == "hdfs://x/y"
