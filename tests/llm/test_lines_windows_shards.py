import itertools
import sys
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import functions as F
from texts import prose

from tessera.llm.decontamination import RADIUS, SIMILARITY, contaminated, without_contaminated
from tessera.llm.line_dedup import BYTES_A_WORD, WRAP_REACH, WRAP_WORDS, Lines, without_repeated_lines
from tessera.llm.sharding import read_shards, shard_of, write_shards

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this folder

# --- line dedup: the rules once more, letter by letter, with Python's numbers

FULL = 2**64 - 1
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mixed(x):
    x = (x ^ x >> 32) * ODD[0] & FULL
    x = (x ^ x >> 29) * ODD[1] & FULL
    return x ^ x >> 32


def hash_around(raw, at):
    before, after = (int.from_bytes(raw[i : i + 8].ljust(8, b"\0"), "little") for i in (at - 8, at))
    return mixed(before * ODD[2] & FULL ^ after * ODD[3] & FULL)


def plain_lines(text):
    """(start, end of content, stop) of the lines of a text."""
    raw, ends, wide = text.encode(), [], {len(text[:i].encode()): c for i, c in enumerate(text)}
    for i in range(len(raw)):
        c = raw[i : i + 1]
        if c == b"\n" or c == b" " and i and raw[i - 1 : i] in (b".", b"!", b"?") or i + 1 == len(raw):
            ends.append(i + 1)
        elif wide.get(i) in tuple("。！？"):
            ends.append(i + 3)
    out, start = [], 0
    for end in sorted(set(ends)):
        line = raw[start:end]
        places = [start + i + 1 for i in range(len(line)) if line[i : i + 1] == b" "] + [i + 3 for i, c in wide.items() if start <= i < end and c in "、，；："]
        inner = len([x for x in places if start < x < end])
        if inner >= WRAP_WORDS or len(line) > 2 * WRAP_WORDS * BYTES_A_WORD:
            if len(line) > 4 * BYTES_A_WORD * (inner + 1):
                places += [i for i in wide if start <= i < end and hash_around(b"\0" * 8 + raw + b"\0" * 8, i + 8) & 3 == 0]
            places = sorted(x for x in set(places) if x < end and x >= 8 and x + 8 <= len(raw))
            hashes = [hash_around(raw, x) for x in places]
            for i in range(WRAP_REACH, len(places) - WRAP_REACH):
                if all(hashes[i] < hashes[i + k] for k in range(-WRAP_REACH, WRAP_REACH + 1) if k):
                    out.append((start if not out or out[-1][2] < start else out[-1][2], places[i], places[i]))
        last = out[-1][2] if out and out[-1][2] > start else start
        out.append((last, end, end))
        start = end
    found = []
    for a, _, b in out:
        content = raw[a:b].rstrip(b" \n")
        if content:
            found.append([a, a + len(content), b])
        elif found:
            found[-1][2] = b
    return raw, [tuple(x) for x in found]


def plain_chunks(text):
    """The lines of a text, their contents, and (first, last) lines of its chunks."""
    raw, lines = plain_lines(text)
    contents = [raw[a:b] for a, b, _ in lines]
    hashes = [xxhash.xxh64_intdigest(x) for x in contents]
    kinds = [mixed((hashes[i] * ODD[2] + hashes[i + 1] * ODD[3]) & FULL) >> 63 for i in range(len(lines) - 1)]
    out = []
    for kind in (0, 1):
        at = [i for i, k in enumerate(kinds) if k == kind]
        for first, last in zip([0, *at], [*(i + 1 for i in at), len(lines) - 1], strict=True):
            if last - first >= 2:
                    out.append((first, last))
    return lines, contents, sorted(set(out))


def plain_dedup(rows):
    """{(doc_id, text): new text}: the first place of each chunk stays."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, HASHES[r[1]] if r[1] is not None else 0))
    seen, cuts = {}, {}
    for row in order:
        cuts[row] = set()
        lines, contents, found = plain_chunks(row[1] or "")
        padded = [b"", *contents, b""]
        own = {}
        for first, last in sorted(found):
            start, stop = lines[first][0], lines[last][2]
            before, after = padded[first], padded[last + 2]
            here = (row, start, before, after)
            # the first place in the text itself, or else in all texts
            kept = own.setdefault(tuple(contents[first : last + 1]), here)
            if kept == here:
                kept = seen.setdefault(tuple(contents[first : last + 1]), here)
            if kept[:2] != (row, start):
                start = lines[first - 1][0] if before and before == kept[2] else start
                stop = lines[last + 1][2] if after and after == kept[3] else stop
                cuts[row] |= set(range(start, stop))
    out = {}
    for row in order:
        raw = (row[1] or "").encode()
        left = bytes(b for i, b in enumerate(raw) if i not in cuts[row])
        if raw and len(raw) - 1 in cuts[row] and left[-1:] in (b" ", b"\n"):
            left = left[:-1]
        out[row] = None if row[1] is None else left.decode()
    return out


HASHES = {}


def learn_hashes(spark, rows):
    """The order of texts of one id is that of their hashes."""
    texts = list({t for _, t in rows if t is not None})
    HASHES.update(map(tuple, spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.xxhash64("text")).collect()))


def sentences(rng, n):
    out = []
    while sum(map(len, out)) < n:
        out.append(prose(rng, min(rng.randint(1, 16), n - sum(map(len, out)))).split())
    return " ".join(" ".join(x).capitalize() + rng.choice(".!?") for x in out)


def odd_text(rng):
    alphabet = "a. \n!é漢。、，字々"
    return "".join(rng.choice(alphabet) * rng.choice([1, 1, 1, 30]) for _ in range(rng.randint(0, 60)))


def test_lines_and_chunks_equal_the_plain_rules(rng):
    texts = [odd_text(rng) for _ in range(150)] + [sentences(rng, 200) for _ in range(10)] + [prose(rng, 300) for _ in range(5)]
    texts += ["".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(rng.randint(50, 400))) for _ in range(10)] + [" x. y", ". . .", " ", "", "".join(rng.choice("0123456789abcdef") for _ in range(900)), "щ" * 900]
    rng.shuffle(texts)
    raws = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raws)])
    data = np.frombuffer(b"".join(raws), np.uint8)
    lines = Lines.of(data, bounds)
    first, end, hashes = lines.chunks()
    by_content = {}
    for i, text in enumerate(texts):
        mine = lines.text == i
        assert [tuple(int(x) for x in r) for r in np.column_stack([lines.start, lines.content, lines.stop])[mine] - bounds[i]] == plain_lines(text)[1], repr(text)
        got = []
        for a, b, h in zip(first, end, hashes, strict=True):
            if lines.text[a] == i:
                contents = tuple(bytes(data[lines.start[j] : lines.content[j]]) for j in range(a, b + 1))
                got.append((int(lines.start[a] - bounds[i]), int(lines.stop[b] - bounds[i]), contents))
                assert by_content.setdefault(contents, h) == h
        of, contents, found = plain_chunks(text)
        assert sorted(got) == sorted((of[x][0], of[y][2], tuple(contents[x : y + 1])) for x, y in found)
    assert len(set(by_content.values())) == len(by_content)


def corpus_with_passages(rng):
    passages = ["\n".join(sentences(rng, rng.choice([4, 12, 60])) for _ in range(rng.randint(1, 5))) for _ in range(6)]
    rows = []
    for i in range(50):
        parts = [sentences(rng, rng.choice([3, 15, 70])) for _ in range(rng.randint(0, 4))] + rng.sample(passages, rng.randint(0, 3))
        rng.shuffle(parts)
        rows.append((i, rng.choice(" \n").join(parts)))
    rows += [(70, rows[3][1]), (71, rows[3][1]), (None, rows[4][1]), (72, None), (73, ""), (5, rows[6][1]), (None, None), (80, "again and again.\n" * 30), (81, "again and again.\n" * 3)]
    rows += [(100 + i, "\n".join(prose(rng, 3).capitalize() + "." for _ in range(n))) for i, n in enumerate((1, 2, 3, 3, 3, 3, 4, 4, 4, 4, 5, 5, 6, 6))]
    return rows + rows[7:9]


def test_line_dedup_equals_brute_force(spark, rng):
    rows = corpus_with_passages(rng)
    learn_hashes(spark, rows)
    got = without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = plain_dedup(rows)
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, expected[i, t]) for i, t in rows)
    assert sum(r.removed_passages > 0 for r in got) > 20


def test_hashes_that_say_too_much_cut_nothing(spark, rng):
    rows = corpus_with_passages(rng)
    got = without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), lambda line: len(line) % 3).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    # one pair of lines that share a hash: chunks with either stay, others go
    texts = ["one two.\nthree four.\nfive six.\nseven eight.", "left out.\nnine ten.\neleven.\ntwelve.\nthirteen."]
    rows = [(i, texts[i % 2]) for i in range(4)]
    clash = lambda line: 5 if bytes(line) in (b"one two.", b"two one.") else xxhash.xxh64_intdigest(line)
    rows += [(9, "two one.\nthree four.\nfive six.\nseven eight.")]
    got = {r.doc_id: r.text for r in without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), clash).collect()}
    assert got[3] == "" and "one two." in got[2] and "two one." in got[9]


def test_every_removed_line_stands_at_an_earlier_place_that_stays(spark, rng):
    words = [line.capitalize() + "." for line in {prose(rng, 2) for _ in range(6)}]
    rows = [(i, "\n".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(40)]
    got = {r.doc_id: r.text for r in without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = {line for t in got.values() for line in t.split("\n")}
    assert {line for _, t in rows for line in t.split("\n")} <= left | {""}
    assert sum(map(len, got.values())) < 0.8 * sum(len(t) for _, t in rows)


def test_every_line_of_a_shared_passage_goes(spark, rng):
    line = lambda: prose(rng, rng.randint(1, 12)).capitalize() + "."
    rows, passages = [], []
    for n in (4, 4, 4, 4, 5, 5, 6, 7, 9, 20) * 4:
        passage = [line() for _ in range(n)]
        passages.append(passage)
        for _ in range(2):
            rows.append((len(rows), "\n".join([line(), line(), *passage, line(), line()])))
    got = {r.doc_id: r.text for r in without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for j, passage in enumerate(passages):
        assert got[2 * j] == rows[2 * j][1]  # the first stays
        own = rows[2 * j + 1][1].split("\n")
        assert got[2 * j + 1].split("\n") == own[:2] + own[-2:]


def test_passages_of_over_fifty_words_go_wherever_they_stand(spark, rng):
    removed = []
    passages = [sentences(rng, rng.randint(51, 90)) for _ in range(30)]
    rows = [(0, sentences(rng, 40)), (1, sentences(rng, 300))]
    for passage in passages:
        for k in range(3):
            before, after = sentences(rng, 30), sentences(rng, 30)
            rows.append((len(rows), [f"{before} {passage}", f"{before}\n{passage}\n{after}", f"{before} {passage} {after}"][k]))
    got = {r.doc_id: r.text for r in without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and got[1] == rows[1][1]
    for j, passage in enumerate(passages):
        assert got[2 + 3 * j] == rows[2 + 3 * j][1]  # the first stays
        for k in (1, 2):
            at = 2 + 3 * j + k
            removed.append((len(rows[at][1].split()) - len(got[at].split())) / len(passage.split()))
    assert np.mean(removed) > 0.95 and min(removed) > 0.7 and max(removed) <= 1


def test_clean_and_awkward_rows_stay(spark, awkward, empty):
    got = without_repeated_lines(awkward)
    assert Counter(map(tuple, got.select(awkward.columns).collect())) == Counter(map(tuple, awkward.collect()))
    assert without_repeated_lines(empty).count() == 0


def test_texts_that_nothing_repeats_stay_as_they_are(spark, rng):
    rows = [(i, rng.choice("\n ").join(prose(rng, rng.randint(2, 30)).capitalize() + "." for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8] * 20)]
    got = without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text, r.removed_passages) for r in got) == sorted((*r, 0) for r in rows)


def test_filters_of_any_size_select_alike(spark, rng, monkeypatch):
    import tessera.llm.hash_filter as module

    rows = spark.createDataFrame(corpus_with_passages(rng), "doc_id long, text string")
    once = Counter(map(tuple, without_repeated_lines(rows).collect()))
    monkeypatch.setattr(module, "FILTER_BITS", 0)  # no filter
    assert Counter(map(tuple, without_repeated_lines(rows).collect())) == once


# --- decontamination


def split_words(text):
    import re

    return re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).split()


def plain_hits(spark, rows, items):
    """All windows of every document against all items, by similarity and the fingerprints' distance."""
    shingles = lambda w, k: [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]
    wanted = {}
    for item, text in items:
        words = split_words(text)
        if words:
            wanted[item] = words, min(5, len(words))
    every = sorted({s for _, t in rows for k in {k for _, k in wanted.values()} for s in shingles(split_words(t), k)} | {s for w, k in wanted.values() for s in shingles(w, k)})
    columns = lambda n: F.xxhash64(*[F.get(F.split("s", " "), i) for i in range(n)])
    table = {}
    for k in range(1, 6):
        of = [(s,) for s in every if s.count(" ") == k - 1]
        if of:
            table |= dict(map(tuple, spark.createDataFrame(of, "s string").select("s", columns(k)).collect()))

    def simhash(found):
        return sum(1 << b for b in range(64) if 2 * sum((table[s] >> b) & 1 for s in found) > len(found))

    best = {}
    for doc_id, text in rows:
        words = split_words(text)
        for item, (of_item, k) in wanted.items():
            n, target = len(of_item), Counter(shingles(of_item, k))
            for start in range(max(1, len(words) - n + 1)):
                window = shingles(words[start : start + n], k)
                common = sum((Counter(window) & target).values())
                total = len(window) + sum(target.values()) - common
                if window and common / total >= SIMILARITY and (simhash(window) ^ simhash(list(target.elements()))).bit_count() <= RADIUS:
                    best[doc_id, item] = max(best.get((doc_id, item), (0, 0)), (common / total, -start))
    return {key: (-s, round(x, 6)) for key, (x, s) in best.items()}


def test_decontamination_equals_brute_force(spark, rng):
    items = [(i, prose(rng, n).title() + ".") for i, n in enumerate([3, 5, 14, 30, 30, 60])] + [(50, ""), (51, None), (52, "...")]
    items.append((60, " ".join([items[2][1]] * 2)))
    rows = []
    for i in range(40):
        words = prose(rng, rng.randint(0, 50)).split()
        for _ in range(rng.randint(0, 2)):
            passage = (rng.choice(items)[1] or "").split()
            if passage and rng.random() < 0.5:
                passage[rng.randrange(len(passage))] = rng.choice(["x", "x y", ""])
            at = rng.randint(0, len(words))
            words[at:at] = passage
        rows.append((i, "\n".join(words)))
    rows += [(90, None), (91, ""), (92, items[5][1]), (93, " ".join(items[5][1].split()[1:]))]
    documents, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, round(r.similarity, 6)) for r in contaminated(documents, benchmark).collect()}
    expected = plain_hits(spark, rows, items)
    assert got == expected and (92, 5) in got and (93, 5) in got
    kept = {r.doc_id for r in without_contaminated(documents, benchmark).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in expected}


def test_simhash_counts_bits_of_arrays_of_any_size(spark, rng):
    from tessera.llm.decontamination import simhash

    arrays = [[rng.randrange(-(2**63), 2**63) for _ in range(n)] for n in (1, 2, 3, 50, 127, 128, 129, 400)]
    arrays += [[-1] * n for n in (1, 127, 128, 32767, 32768)] + [[-(2**63), 5, 5], [0] * 40000 + [-1] * 40001]
    got = spark.createDataFrame(list(enumerate(arrays)), "i int, h array<bigint>").select("i", simhash(F.col("h")).alias("s")).collect()
    for r in got:
        of = arrays[r.i]
        assert r.s % 2**64 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in of) > len(of)), r.i


def test_decontamination_of_long_texts_with_shuffled_joins(spark, rng, monkeypatch):
    import tessera.llm.decontamination as d

    items = [(i, prose(rng, n)) for i, n in enumerate([4, 20, 20, 300, 20])]
    texts = [prose(rng, 700) + " " + items[i % 5][1] + " " + prose(rng, 40 * i) + " " + items[(i + 1) % 5][1] for i in range(6)]
    rows = list(enumerate(texts)) + [(9, prose(rng, 800)), (10, items[3][1]), (11, " ".join(items[3][1].split()[:290]))]
    documents, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = Counter(map(tuple, contaminated(documents, benchmark).collect()))
    assert {(r[0], r[2]): (r[3], round(r[5], 6)) for r in got} == plain_hits(spark, rows, items) and len(got) == 14
    monkeypatch.setattr(d, "small", lambda df: df)
    monkeypatch.setattr(d, "STRETCH", 7)
    assert Counter(map(tuple, contaminated(documents, benchmark).collect())) == got


def test_decontamination_of_awkward_rows(spark, awkward, empty):
    benchmark = spark.createDataFrame([(1, "a b c d e f"), (2, "null id here")], "item_id long, text string")
    kept = without_contaminated(awkward, benchmark)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 3
    assert contaminated(empty, benchmark).count() == 0
    assert without_contaminated(awkward, benchmark.limit(0)).count() == awkward.count()


# --- shards


def test_shards(spark, rng, tmp_path):
    rows = [(i, prose(rng, rng.choice([1, 10, 200])) if i % 17 else None) for i in range(400)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    for name in "ab":
        write_shards(documents.repartition(3 if name == "a" else 5), str(tmp_path / name), shards=5, bucket_bytes=20_000)
    got = [sorted(map(tuple, read_shards(spark, str(tmp_path / n)).collect())) for n in "ab"]
    assert got[0] == got[1]  # whatever the order of the input
    assert [(i, t) for i, t, _, _ in got[0]] == rows
    for shard, of in itertools.groupby(sorted(got[0], key=lambda r: (r[3], r[2])), key=lambda r: r[3]):
        of = list(of)
        assert [r[2] for r in of] == list(range(len(of)))
        assert [r[0] for r in of] != sorted(r[0] for r in of)
    homes = documents.select("doc_id", shard_of("doc_id", 5).alias("five"), shard_of("doc_id", 6).alias("six")).collect()
    assert {r.doc_id: r.five for r in homes} == {r[0]: r[3] for r in got[0]}
    assert all(r.six in (r.five, 5) for r in homes) and {r.six for r in homes} == set(range(6))


def test_shards_of_several_groups_of_buckets(spark, rng, tmp_path, monkeypatch):
    import tessera.llm.sharding as sharding

    documents = spark.createDataFrame([(i, prose(rng, 30)) for i in range(300)], "doc_id long, text string")
    write_shards(documents, str(tmp_path / "a"), shards=5, bucket_bytes=2_000)
    monkeypatch.setattr(sharding, "BUCKETS_AT_ONCE", 7)
    write_shards(documents, str(tmp_path / "b"), shards=5, bucket_bytes=2_000)
    one, two = (read_shards(spark, str(tmp_path / n)).collect() for n in "ab")
    assert sorted((r.doc_id, r.text, r.shard) for r in one) == sorted((r.doc_id, r.text, r.shard) for r in two) and len(one) == 300
    # other numbers are drawn, but every place is taken once
    assert sorted((r.shard, r.slot) for r in one) == sorted((r.shard, r.slot) for r in two)
    assert 8_000_000 <= sharding.bucket_size(spark) <= 256_000_000


def test_shards_of_awkward_rows(spark, tmp_path, awkward, empty):
    write_shards(awkward, str(tmp_path / "a"), shards=3, bucket_bytes=1000)
    got = Counter((r.doc_id, zlib.crc32((r.text or "-").encode())) for r in read_shards(spark, str(tmp_path / "a")).collect())
    assert got == Counter((r.doc_id, zlib.crc32((r.text or "-").encode())) for r in awkward.collect())
    write_shards(empty, str(tmp_path / "b"), shards=3)
    assert read_shards(spark, str(tmp_path / "b")).count() == 0
