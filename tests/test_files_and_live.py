import os
import sys
import time
import zipfile
import zlib

import pytest
from pyspark import cloudpickle

from tessera.sources.embedders import HashingEmbedder, embed, with_embeddings
from tessera.sources.files import ExtractionError, extract, extract_text, list_files, listed, read_files
from tessera.sources.store import NotASnapshot, SnapshotStore, UnknownFormat
from tessera.streaming.live import LiveIndex

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this folder

TREE = "a.txt _b.txt .c.txt U.TXT e.md f.tmp k.doc empty.txt sub/d.pdf .git/g.txt x.tmp/h.txt _d/i.txt"


def put(root, name, content):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())
    return path


def test_listing(spark, tmp_path):
    for name in TREE.split():
        put(tmp_path, name, "" if name == "empty.txt" else name)
    names = [os.path.relpath(p, tmp_path) for p, _ in listed(str(tmp_path))]
    assert sorted(names) == sorted(["a.txt", "_b.txt", "k.doc", "empty.txt", "sub/d.pdf", "_d/i.txt"])
    assert listed(str(tmp_path / "absent")) == []
    assert list_files(spark, str(tmp_path / "absent")).count() == 0


def docx(markup):
    from io import BytesIO

    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", markup)
    return out.getvalue()


def pdf(stream, flate=False):
    body = zlib.compress(stream) if flate else stream
    head = b"<< /Length %d %s>>" % (len(body), b"/Filter /FlateDecode " if flate else b"")
    return b"%PDF-1.4\n1 0 obj " + head + b"\nstream\n" + body + b"\nendstream endobj\n%%EOF"


def test_extraction():
    assert extract_text("a.txt", b"Hello world!") == "Hello world!"
    assert extract_text("a.docx", docx("<w:p><w:t>Hello DOCX World</w:t></w:p><w:p>&amp;x</w:p>")) == "Hello DOCX World&amp;x"
    for flate in (False, True):
        assert "Hello PDF (x)" in extract_text("a.pdf", pdf(rb"BT /F1 12 Tf (Hello PDF \(x\)) Tj ET", flate))
    assert "Hello" in extract_text("a.pdf", pdf(b"BT [(Hel) -20 (lo)] TJ ET"))
    for name, content in (("a.txt", b"\xff\xfe"), ("a.docx", b"no zip"), ("a.pdf", b"no pdf")):
        with pytest.raises(ExtractionError):
            extract_text(name, content)


def test_every_file_keeps_its_row(spark, tmp_path):
    put(tmp_path, "ok.txt", "  text \n")
    put(tmp_path, "bad.txt", b"\xff")
    put(tmp_path, "empty.txt", "")
    rows = with_embeddings(extract(read_files(list_files(spark, str(tmp_path)))), HashingEmbedder(8)).collect()
    got = {os.path.basename(r.path): r for r in rows}
    assert got["ok.txt"].text == "text" and got["ok.txt"].error is None and any(got["ok.txt"].embedding)
    assert got["bad.txt"].text == "" and got["bad.txt"].error == "not UTF-8" and not any(got["bad.txt"].embedding)
    assert got["empty.txt"].text == "" and not any(got["empty.txt"].embedding)


def test_store_checks_its_manifest(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert store.current() is None
    put(tmp_path, "s/v-1/manifest.json", '{"magic": "other"}')
    put(tmp_path, "s/v-2/manifest.json", '{"magic": "tessera-snapshot", "format": 9}')
    with pytest.raises(NotASnapshot):
        store.open(str(tmp_path / "s/v-1"))
    with pytest.raises(NotASnapshot):
        store.open(str(tmp_path / "s/v-0"))
    with pytest.raises(UnknownFormat):
        store.open(str(tmp_path / "s/v-2"))


def test_live_directory(spark, tmp_path):
    folder, e = str(tmp_path / "data"), HashingEmbedder(32)
    os.makedirs(folder)
    live = LiveIndex(spark, folder, str(tmp_path / "store"), e)
    assert len(live.snapshot()) == 0 and not live.refresh()

    path = put(folder, "hello.txt", "hello world")
    assert live.refresh() and len(live.snapshot()) == 1
    query = [float(x) for x in embed(e, "hello")]
    assert [r.doc_id for r in live.search(query, 5).collect()] == [path]
    first = live.snapshot()

    put(folder, "hello.txt", "pizza è la migliore")
    assert live.refresh()
    assert live.snapshot().records.first().text == "pizza è la migliore"
    assert [r.doc_id for r in live.search_hybrid("migliore").collect()] == [path]
    assert first.records.first().text == "hello world"  # an opened version doesn't change
    assert len(live.snapshot().vector(path)) == 32

    os.rename(path, os.path.join(folder, "moved.txt"))
    put(folder, "empty.txt", "")
    put(folder, "long.txt", "the quick brown fox jumps over it " * 5000)
    assert live.refresh() and len(live.snapshot()) == 3 and not live.refresh()
    assert any(r.doc_id.endswith("long.txt") for r in live.search_hybrid("quick fox", 5).collect())

    for name in os.listdir(folder):
        os.remove(os.path.join(folder, name))
    assert live.refresh() and len(live.snapshot()) == 0


def test_streaming_refresh(spark, tmp_path):
    folder = str(tmp_path / "data")
    os.makedirs(folder)
    live = LiveIndex(spark, folder, str(tmp_path / "store"), HashingEmbedder(16))
    live.start(str(tmp_path / "checkpoint"), 0.5)
    try:
        put(folder, "a.txt", "streamed words")
        until = time.time() + 60
        while len(live.snapshot()) != 1 and time.time() < until:
            time.sleep(0.3)
        assert len(live.snapshot()) == 1
    finally:
        live.stop()


def test_progress_each_ten_files_and_at_the_end(spark, tmp_path):
    folder, said = str(tmp_path / "data"), []
    for i in range(23):
        put(folder, f"{i}.txt", f"text {i}")
    live = LiveIndex(spark, folder, str(tmp_path / "store"), HashingEmbedder(8), on_progress=said.append)
    assert said == ["Indexing 10/23", "Indexing 20/23", "Indexing 23/23"]
    put(folder, "3.txt", "other")
    assert live.refresh() and said[3:] == ["Indexing 1/1"]


def test_old_versions_go(spark, tmp_path):
    folder = str(tmp_path / "data")
    live = LiveIndex(spark, folder, str(tmp_path / "store"), HashingEmbedder(8))
    for i in range(5):
        put(folder, "a.txt", f"words {i}")
        time.sleep(0.02)
        assert live.refresh()
    versions = [x for x in os.listdir(tmp_path / "store") if x.startswith("v-")]
    assert len(versions) == live.store.kept and live.snapshot().records.first().text == "words 4"


def test_a_failing_tick_is_passed_over(spark, tmp_path, monkeypatch):
    from pyspark.errors import PySparkException

    folder = str(tmp_path / "data")
    os.makedirs(folder)
    live, errors = LiveIndex(spark, folder, str(tmp_path / "store"), HashingEmbedder(8)), [PySparkException("lost"), OSError("gone")]
    refresh = live.refresh
    monkeypatch.setattr(live, "refresh", lambda: (_ for _ in ()).throw(errors.pop()) if errors else refresh())
    live.start(str(tmp_path / "checkpoint"), 0.2)
    try:
        put(folder, "a.txt", "after the errors")
        until = time.time() + 60
        while len(live.snapshot()) != 1 and time.time() < until:
            time.sleep(0.2)
        assert len(live.snapshot()) == 1 and not errors and live.query.isActive
    finally:
        live.stop()


class Session:
    """An encoder whose hidden states are one-hot in the id, to check the pooling."""

    class Input:
        def __init__(self, name):
            self.name = name

    def __init__(self, path):
        assert path == "model.onnx"

    def get_inputs(self):
        return [self.Input("input_ids"), self.Input("attention_mask")]

    def run(self, names, feed):
        import numpy as np

        assert names is None and set(feed) == {"input_ids", "attention_mask"}
        return [np.eye(8)[feed["input_ids"] % 8]]


def test_onnx_embedder_through_a_session(spark, tmp_path):
    import numpy as np
    from tokenizers import Tokenizer, models, pre_tokenizers

    from tessera.sources.embedders import OnnxEmbedder, windows

    tokenizer = Tokenizer(models.WordLevel({"[UNK]": 0, "one": 2, "two": 3, "three": 4}, "[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(tmp_path / "t.json"))
    e = OnnxEmbedder(str(tmp_path / "t.json"), "model.onnx", 8, make_session=Session, windows_at_once=2)
    assert e.id_to_token(3) == "two" and e.id_to_token(99) is None and e.max_tokens == 256

    def plain(ids):
        v = np.bincount(np.array([101, *ids, 102]) % 8, minlength=8).astype(float)
        return v / np.linalg.norm(v)

    texts = ["one two", "", "three", "one two three three nothing", " "]
    got = [embed(e, t) for t in texts]
    assert np.allclose(got[0], plain([2, 3])) and np.allclose(got[2], plain([4])) and not got[1].any() and not got[4].any()
    long = "one two three " * 800
    ids = e.tokenize(long)
    pooled = np.mean([plain(ids[a:b]) for a, b in windows(len(ids))], axis=0)
    assert np.allclose(embed(e, long), pooled / np.linalg.norm(pooled))
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate([*texts, long])], "i int, text string, error string")
    for r in with_embeddings(rows, e).collect():
        assert np.allclose(r.embedding, embed(e, [*texts, long][r.i]), atol=1e-6) and r.error is None


class Failing(HashingEmbedder):
    def tokenize(self, text):
        if "bad" in text:
            raise ValueError("no such text")
        return super().tokenize(text)


def test_one_failing_text_spares_its_batch(spark):
    rows = spark.createDataFrame([(0, "good words", None), (1, "bad", "earlier"), (2, None, "kept")], "i int, text string, error string")
    got = {r.i: r for r in with_embeddings(rows.coalesce(1), Failing(8)).collect()}
    assert any(got[0].embedding) and got[0].error is None
    assert not any(got[1].embedding) and got[1].error == "embedding: no such text" and got[2].error == "kept"
