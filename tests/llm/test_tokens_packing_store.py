import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from texts import prose

from tessera.llm.huffman import Coder, code_lengths
from tessera.llm.packing import Limits, pack_conversations, pack_documents, place
from tessera.llm.token_store import read_store, write_store
from tessera.llm.tokens import MemoEncoder
from tessera.llm.wordpiece import Automaton, byte_pieces, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "abreé'sS12 \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　é́Σ́H̱İ!*—日本ﬁÀ"


def library_ids(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "drops_space"), [(BYTES, False), (WORDS, True)])
def test_memo_equals_library(path, drops_space):
    rng = random.Random(4)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 15))) for _ in range(3000)]
    texts += ["".join(rng.choice(" \n\tab.ÀßéZ") for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    texts += [None, "", "x<|endoftext|>y <|endoftext|>", "it's IT'S 'tis x'st", *(prose(rng, 400) for _ in range(5)), "Word*** word. (word) " * 50]
    encoder = MemoEncoder(path, drops_space)
    for _ in range(2):  # with an empty memo and with a full one
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, encoder.dtype).tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 900), st.integers(0, 900)), max_size=25), st.integers(1, 5), st.integers(20, 300))
def test_bins_keep_every_limit(examples, segments, loss):
    limits = Limits(tokens=256, segments=segments, loss=loss)
    marks = [None if p == 0 else np.arange(n) % 1000 >= p for n, p in examples]
    pieces = place([n for n, _ in examples], marks, limits)
    bins = {}
    covered = {}
    for i, start, n, b, offset in pieces:
        assert n > 0
        used = bins.setdefault(b, [0, 0, 0])
        assert offset == used[0]  # gapless
        bins[b] = [used[0] + n, used[1] + 1, used[2] + (n if marks[i] is None else int(marks[i][start : start + n].sum()))]
        assert covered.get(i, 0) == start
        covered[i] = start + n
    assert covered == {i: n for i, (n, _) in enumerate(examples) if n}
    assert all(t <= 256 and s <= segments and x <= loss for t, s, x in bins.values())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 60)), min_size=1, max_size=7), st.integers(10, 40))
def test_few_examples_need_hardly_more_bins_than_they_must(examples, loss):
    """Against the least that any packing can have by tokens, by loss and by segments."""
    limits = Limits(tokens=64, segments=4, loss=loss)
    marks = [np.arange(n) >= p for n, p in examples]
    bins = 1 + max(b for *_, b, _ in place([n for n, _ in examples], marks, limits))
    total, bearing = sum(n for n, _ in examples), sum(int(x.sum()) for x in marks)
    least = max(-(-total // 64), -(-bearing // loss), -(-len(examples) // 4))
    assert bins <= 2 * least + 1


def test_the_vector_decides_where_limits_differ():
    # answers alone would fill the loss limit of a bin, prompts alone its tokens: both are mixed
    tokens, marks = [32] * 40, [np.ones(32, bool)] * 20 + [np.zeros(32, bool)] * 20
    pieces = place(tokens, marks, Limits(tokens=64, segments=8, loss=32))
    assert 1 + max(b for *_, b, _ in pieces) == 20


def test_conversations_are_packed_with_their_loss(spark, rng):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", prose(rng, rng.choice([2, 30, 200]))) for c in range(25) for t in range(rng.randint(1, 6))]
    rows += [(50, t, "assistant", "word") for t in range(130)] + [(60, 0, "user", "one"), (60, 0, "assistant", "two"), (None, 3, "user", None), (61, None, None, "x"), (61, None, None, "x")]
    table = spark.createDataFrame(rows + rows[:3], "conv_id long, turn long, role string, text string").withColumn("block", F.lit("clash"))
    got = pack_conversations(table, BYTES).collect()
    examples, bins = {}, {}
    for r in got:
        examples.setdefault((r.example_id, r.part), []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for of in bins.values():
        assert sum(r.length for r in of) <= 1024 and sum(r.loss for r in of) <= 512 and len(of) <= 16
        assert [r.offset for r in sorted(of, key=lambda r: r.offset)] == np.cumsum([0, *(r.length for r in sorted(of, key=lambda r: r.offset)[:-1])]).tolist()
    for c in range(25):
        pieces = sorted(examples[c, 0], key=lambda r: r.start)
        turns = [(role, [*library_ids(BYTES, text), 0]) for i, _, role, text in rows if i == c]
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist() == [x for _, ids in turns for x in ids]
        assert sum(r.loss for r in pieces) == sum(len(ids) for role, ids in turns if role == "assistant")
    assert {p for c, p in examples if c == 50} == {0, 64, 128}
    assert sum(r.start == 0 for r in got if r.example_id == 60) == 2 and sum(r.start == 0 for r in got if r.example_id == 61) == 1
    assert pack_conversations(table.limit(0), BYTES).count() == 0


def test_very_many_equal_rows_are_dealt_out(spark, rng, monkeypatch, tmp_path):
    import tessera.llm.common as common
    import tessera.llm.packing as packing
    import tessera.llm.token_store as token_store
    from tessera.llm.sharding import read_shards, write_shards

    rows = [(None, None)] * 700 + [(7, "the same words")] * 500 + [(i, prose(rng, 20)) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(common.numbered_copies, "__defaults__", (50,))
    numbered = common.numbered_copies(table)
    assert numbered.count() == len(rows)
    assert sorted(r.copy for r in numbered.where("doc_id = 7").collect() if r.text == "the same words") == list(range(500))
    monkeypatch.setattr(packing, "BLOCK_EXAMPLES", 100)
    got = pack_documents(table, BYTES).collect()
    assert sum(r.start == 0 for r in got) == len(rows)
    assert max(np.bincount([r.sequence_id >> 32 for r in got if r.example_id is None and r.start == 0])) < 150
    write_shards(table, str(tmp_path / "s"), shards=4, bucket_bytes=3_000)
    assert sorted(((r.doc_id, r.text) for r in read_shards(spark, str(tmp_path / "s")).collect()), key=str) == sorted(rows, key=str)
    monkeypatch.setattr(token_store, "PART_BYTES", 2_000)
    write_store(table, WORDS, str(tmp_path / "t"), 2, True)
    back = sorted(read_store(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.start for r in back] == np.cumsum([0, *(r.n_tokens for r in back[:-1])]).tolist() and len(back) == len(rows)
    assert [r.doc_id for r in back] == [None] * 700 + sorted(i for i, _ in rows if i is not None)
    parts = spark.read.parquet(str(tmp_path / "t/blocks")).select("part").distinct().count()
    assert parts > 3


def test_documents_are_packed_whole(spark, rng, awkward, empty):
    rows = [(i, prose(rng, rng.choice([1, 20, 300, 2500]))) for i in range(80)]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), BYTES).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.example_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in rows:
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces])
        assert ids.tolist() == [*library_ids(BYTES, text), 0]
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces[:-1])]).tolist()
        assert {r.example_tokens for r in pieces} == {len(ids)}
    fills = []
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces[:-1])]).tolist()
        fills.append(sum(r.length for r in pieces))
    assert max(fills) <= 1024 and sum(f != 1024 for f in fills) <= 1
    assert pack_documents(empty, BYTES).count() == 0
    rows = pack_documents(awkward, BYTES).collect()
    assert sum(r.length for r in rows if r.start == 0 and r.example_tokens == 1) == 3  # null, null and empty
    assert sum(r.start == 0 for r in rows) == awkward.count()


def test_package_merge_is_optimal():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(60):
        counts = rng.integers(0, 40, size=rng.integers(1, 6))
        used = counts[counts > 0]
        best = min((sum(a * b for a, b in zip(used, bits, strict=True)) for bits in itertools.product(range(1, 4), repeat=len(used)) if sum(2.0**-b for b in bits) <= 1), default=0)
        assert (counts * code_lengths(counts, 3)).sum() == best
    with pytest.raises(ValueError):
        code_lengths(np.ones(9, int), 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40) | st.integers(0, 70_000), min_size=1, max_size=700), min_size=1, max_size=6))
def test_blocks_come_back(documents):
    documents = [(i if i % 3 else None, np.array(x, np.uint32)) for i, x in enumerate(documents)]
    coder = Coder(code_lengths(np.bincount(np.concatenate([x for _, x in documents]))))
    back = coder.decode(coder.encode(documents))
    assert [(i, x.tolist()) for i, x in back] == [(i, x.tolist()) for i, x in documents]
    with pytest.raises(ValueError):
        coder.decode(b"something else")


def test_store_round_trip(spark, rng, tmp_path, awkward, empty):
    rows = [(i * 3, prose(rng, rng.choice([1, 30, 900]))) for i in range(60)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").union(awkward.select("doc_id", "text"))
    write_store(documents, WORDS, str(tmp_path / "a"), 2, True)
    got = read_store(spark, str(tmp_path / "a")).collect()
    expected = [tuple(r) for r in documents.orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text")).collect()]
    start = 0
    for r, (doc_id, text) in zip(sorted(got, key=lambda r: r.start), expected, strict=True):
        ids = [*library_ids(WORDS, text), 2]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, start, len(ids))
        assert zlib.crc32(r.ids) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    write_store(empty, WORDS, str(tmp_path / "b"), 2, True)
    assert read_store(spark, str(tmp_path / "b")).count() == 0


def greedy(word, first, later):
    n, at = 0, 0
    while at < len(word):
        pieces = first if at == 0 else later
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("ab", min_size=1, max_size=4), max_size=8), st.sets(st.text("ab", min_size=1, max_size=4), max_size=8), st.lists(st.text("abc", max_size=12), max_size=8))
def test_automaton_equals_greedy_matching(first, later, words):
    first, later = ({x.encode() for x in s} for s in (first, later))
    automaton = Automaton(first, later)
    for word in words:
        assert automaton.count(word.encode()) == greedy(word.encode(), first, later)


def test_token_counts(spark, rng, awkward, empty):
    first, later = map(set, byte_pieces(BYTES))
    rows = [(i, prose(rng, 40) + " Ünï日本 x" + "z" * 500) for i in range(5)]
    for r in token_counts(spark.createDataFrame(rows, "doc_id long, text string"), BYTES).collect():
        words = rows[r.doc_id][1].encode().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy(w, first, later) for w in words))
    got = sorted((r.n_words for r in token_counts(awkward, BYTES).collect()))
    assert got == [0, 0, 0, 0, 3, 5, 6, 6, 60_000]
    assert token_counts(empty, BYTES).count() == 0
