"""SimHash near-duplicate groups with covering locality-sensitive hashing.

Every pair of fingerprints within the radius agrees on the bits of some mask: each of the 64
positions is a point of a projective space of as many dimensions as the radius; any so many points
lie in a hyperplane, and the mask of that hyperplane has the positions outside of it.

``simhash_groups`` links whole-text fingerprints within two bits. Fingerprints that share a bucket
with another go on to the exact check, which never lists the pairs of a bucket: two fingerprints
differ in at most two bits if and only if some point differs from each in at most one, and a point
has at most 65 such neighbours. More fingerprints take masks over a larger field, which keep more
bits, so that few share a bucket by chance.

``near_groups`` links texts by the similarity of their five-word shingles. Of a text with a tenth
of its words changed the fingerprint differs in some ten bits, for which no masks are selective.
So the shingles are dealt by hash into classes of three to six, each class has a SimHash, and
covering masks are laid over these: of sixteen classes that two similar texts have in common, some
is the same in both. What shares a bucket is compared by the shingles themselves, with the bucket's
first and last text. A second round leaves no pair out: of n shingles a text shows the n - ceil(0.8 n)
+ 1 that are first in one order for all texts, rare ones before frequent ones, and two texts that are
similar enough have one of these in common. All pairs that share one and that no links join yet
are compared.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from tessera.llm.common import Scratch, in_parts, in_small_batches, kept, lean, sampled, small, written
from tessera.llm.components import connected_components

BITS = 64
RADIUS = 2
HASH_SEED = 42
#: Fields for the masks, smallest first, and how many buckets there are for each fingerprint.
FIELDS = (2, 3, 5, 7)
SPARE_BITS = 4

#: Near copies: words of a shingle, least similarity, shingles of a class at most, classes of a
#: text that are looked at, and differing bits of a class's fingerprint.
WIDTH = 5
SIMILARITY = 0.8
CLASS_SIZE = 6
CLASSES = 16
CLASS_RADIUS = 1
#: Texts whose shingles are counted, to tell frequent ones: the order decides on the work alone.
ORDER_ROWS = 10_000
#: While the pairs to compare are more than so many for each row that has a shared shingle, rows are
#: first compared with so many of those that share it.
FEW_PAIRS = 10
PIVOTS = (2, 12)
#: 64-bit words of the parities by which pairs are rejected as they meet; before their texts are read,
#: those of long texts are compared in more bits.
PARITY_WORDS = 8


def covering_masks(radius: int = RADIUS, seed: int = 7, field: int = 2) -> list[int]:
    """The masks as unsigned 64-bit numbers, (field^(radius+1) - 1) / (field - 1) of them; ``field``
    is a prime."""
    vectors = [v for v in product(range(field), repeat=radius + 1) if next((x for x in v if x), 0) == 1]
    points = [vectors[i % len(vectors)] for i in range(BITS)]
    random.Random(seed).shuffle(points)
    return [sum(1 << i for i, x in enumerate(points) if sum(a * b for a, b in zip(plane, x, strict=True)) % field) for plane in vectors]


def masks_for(fingerprints: int, radius: int = RADIUS) -> list[int]:
    """Masks that keep enough bits for so many fingerprints, over as small a field as that takes."""
    need = math.log2(max(1, fingerprints)) + SPARE_BITS
    every = [covering_masks(radius, field=q) for q in FIELDS]
    return next((m for m in every if min(x.bit_count() for x in m) >= need), every[-1])


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The SimHash of one UTF-8 text as a signed 64-bit number; 0 for no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles, n = [b" ".join(words)], 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)), len(words) - width + 1
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(HASH_SEED)), dtype="<u8", count=n)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row. A null text counts as an empty one: fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return in_small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def linked_fingerprints(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints within two bits that tie together all such pairs.

    ``distinct``: a written table with one row for each fingerprint ``fp``.
    """
    masks = F.array(*[F.lit(_signed(m)) for m in masks_for(distinct.count())])
    keys = distinct.select("fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("mask", "bucket"))
    crowded = written(keys.groupBy("mask", "bucket").agg(F.count("*").alias("n")).where("n > 1").select("mask", "bucket"))
    candidates = written(keys.join(crowded, ["mask", "bucket"], "left_semi").select("fp").distinct())
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS)])
    points = candidates.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    # at most 65 fingerprints stand around a point
    around = points.groupBy("point").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return around.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a != b").distinct()


def simhash_groups(documents: DataFrame) -> DataFrame:
    """(doc_id long, fp long, component_id long) for each row of ``documents`` (doc_id, text).

    component_id is the smallest doc_id that can be reached over links of at most two differing
    bits. Rows with a null doc_id keep their row and take part by their text; their component_id
    is null if no row of the group has an id. Repeated rows stay repeated; texts without words
    have fingerprint 0 and are linked like any other; an empty table gives an empty result. Other
    columns are ignored.
    """
    prints = written(fingerprints(documents))
    least = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_doc")))
    roots = written(connected_components(linked_fingerprints(least)).withColumnRenamed("node", "fp"))
    members = roots.join(least, "fp")
    ids = written(members.groupBy("root").agg(F.min("least_doc").alias("linked_doc")))
    linked = roots.join(ids, "root").select("fp", "linked_doc")
    component = written(
        least.join(linked, "fp", "left").select("fp", F.coalesce("linked_doc", "least_doc").alias("component_id"))
    )
    return prints.join(component, "fp", "left").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


# --- near copies by shingles

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
MEMO_ENTRIES = 150_000
#: Texts that are cut into shingles at once.
PART_ROWS = 200


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxh64_intdigest(word)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


_word_hashes = kept["words"] = _WordHashes()


def shingle_sets(texts: list[bytes | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The hashes of each text's different shingles, ascending in each text, with the text's number;
    and what identifies its words. Texts of fewer words have one shingle, those without none."""
    if len(_word_hashes) > MEMO_ENTRIES:
        _word_hashes.clear()
    words = [(x or b"").lower().split() for x in texts]
    names = [xxh3_128_digest(b" ".join(x)) for x in words]
    sizes = np.array([len(x) for x in words], np.int64)
    flat = np.fromiter((h for x in words for h in map(_word_hashes.__getitem__, x)), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)
    left = ends[text] - np.arange(len(flat))  # words from here to the text's end
    taken = np.minimum(width, sizes[text])
    at = np.flatnonzero(left >= taken)
    at = at[(sizes[text[at]] >= width) | (left[at] == sizes[text[at]])]
    hashes = np.zeros(len(at), np.uint64)
    for i in range(width):
        some = i < taken[at]
        hashes = np.where(some, (hashes ^ flat[np.minimum(at + i, max(0, len(flat) - 1))]) * _ODD[2] + _ODD[3], hashes) if len(at) else hashes
    hashes, text = _mixed(hashes), text[at]
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1]))[: len(hashes)]
    return hashes[new], text[new], names


def level_of(n: np.ndarray) -> np.ndarray:
    """Into how many classes, as a power of two, n shingles are dealt: ``CLASS_SIZE`` or fewer in
    each, and up to eight classes where there are few."""
    n = np.maximum(n, 1)
    return np.maximum(np.ceil(np.log2(n / CLASS_SIZE)), np.minimum(3, np.floor(np.log2(n)))).astype(np.int64)


def class_keys(hashes: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of the masked fingerprints of the texts' classes. A text has the classes for its
    number of shingles and, if these are others, for the most that a similar text can have."""
    masks = np.array(covering_masks(CLASS_RADIUS), np.uint64)
    n = np.bincount(text, minlength=texts)
    own, more = level_of(n), level_of(np.floor(n / SIMILARITY))
    keys, owners = [], []
    for level, applies in ((own, n > 0), (more, (n > 0) & (more != own))):
        some = applies[text]
        h, of = hashes[some], text[some]
        cls = ((h * _ODD[3]) >> np.uint64(1)) >> (63 - level[of]).astype(np.uint64)
        few = cls < CLASSES
        h, of, cls = h[few], of[few], cls[few].astype(np.int64)
        if not len(h):
            continue
        group = of * CLASSES + cls
        order = np.argsort(group, kind="stable")
        h, group = h[order], group[order]
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        size = np.diff(np.append(starts, len(group)))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        fp = np.packbits(2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int32) > size[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        owner = group[starts] // CLASSES
        place = (level[owner] * CLASSES + group[starts] % CLASSES).astype(np.uint64)
        for i, mask in enumerate(masks):
            keys.append(_mixed((fp & mask) * _ODD[0] + place * _ODD[1] + np.uint64(i + 1)))
            owners.append(owner)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def first_shingles(hashes: np.ndarray, text: np.ndarray, texts: int, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the shingles of which similar texts have one in common: in the order of the
    counts in ``frequent`` (hashes ascending, counts; 0 for others), then of the hash, a text's first
    n - ceil(SIMILARITY n) + 1."""
    known, counts = frequent
    count = np.zeros(len(hashes), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        count = np.where(known[at] == hashes, counts[at], 0)
    order = np.lexsort((hashes, count, text))
    n = np.bincount(text, minlength=texts)
    shown = n - np.ceil(SIMILARITY * n - 1e-9).astype(np.int64) + 1
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n)
    some = order[place < np.repeat(shown, n)]
    return hashes[some], text[some]


def parities(hashes: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """For each text ``PARITY_WORDS`` numbers: whether an odd number of its shingles fall on a bit. Two
    texts differ in no more bits than in shingles."""
    bits = 64 * PARITY_WORDS
    odd = np.bincount(text * bits + (_mixed(hashes) & np.uint64(bits - 1)).astype(np.int64), minlength=texts * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(texts, bits), axis=1).view("<i8")


def long_parities(hashes: np.ndarray, text: np.ndarray, texts: int) -> list[bytes]:
    """The same in twice as many bits as a text has shingles, or more: a power of two, at least as many
    as ``parities`` has. Half as many bits are the exclusive or of both halves."""
    n = np.bincount(text, minlength=texts)
    bits = np.maximum(64 * PARITY_WORDS, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    ends = np.cumsum(bits)
    place = (_mixed(hashes) & (bits - 1).astype(np.uint64)[text]).astype(np.int64) + (ends - bits)[text]
    odd = np.packbits((np.bincount(place, minlength=int(bits.sum())) & 1).astype(np.uint8)).tobytes()
    return [odd[(end - size) // 8 : end // 8] for end, size in zip(ends.tolist(), bits.tolist(), strict=True)]


def differing(a: bytes, b: bytes) -> int:
    """Bits that differ of two texts' ``long_parities``."""
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    while len(x) != len(y):
        x, y = sorted((x, y), key=len)
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _frequent(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the shingles that several of about ``ORDER_ROWS`` texts have."""

    @lean("words")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, PART_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(batch.column(2).to_pylist())[0].view(np.int64))], ["hash"])

    texts = _texts(documents)
    some = sampled(texts, ORDER_ROWS, documents.count(), seed=5, key="text_hash").dropDuplicates(["text_hash"])
    found = some.mapInArrow(run, "hash long").groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").toArrow()
    hashes, counts = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _lists(values: np.ndarray, owner: np.ndarray, rows: int) -> pa.ListArray:
    order = np.argsort(owner, kind="stable")
    offsets = np.append(0, np.cumsum(np.bincount(owner, minlength=rows))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[order].view(np.int64)))


def _signatures(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, words binary, n int, keys array<long>, first array<long>, odd array<long>,
    parity binary) of each row; equal words have equal ``words``; n: different shingles."""
    shared = documents.sparkSession.sparkContext.broadcast(_frequent(documents))

    @lean("words")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, PART_ROWS):
            hashes, text, names = shingle_sets(batch.column(2).to_pylist())
            keys = _lists(*class_keys(hashes, text, batch.num_rows), batch.num_rows)
            first = _lists(*first_shingles(hashes, text, batch.num_rows, shared.value), batch.num_rows)
            n = pa.array(np.bincount(text, minlength=batch.num_rows).astype(np.int32))
            odd = pa.array(parities(hashes, text, batch.num_rows).tolist(), pa.list_(pa.int64()))
            parity = pa.array(long_parities(hashes, text, batch.num_rows), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary()), n, keys, first, odd, parity], ["doc_id", "text_hash", "words", "n", "keys", "first", "odd", "parity"])

    return _texts(documents).mapInArrow(run, "doc_id long, text_hash long, words binary, n int, keys array<long>, first array<long>, odd array<long>, parity binary")


def _texts(documents: DataFrame) -> DataFrame:
    return in_small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))


def _similar(pairs: DataFrame) -> DataFrame:
    """(a, b) of ``pairs`` (a, b, text_a, text_b) whose shingles are similar."""

    @lean("words")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, PART_ROWS):
            n = batch.num_rows
            hashes, text, _ = shingle_sets(batch.column(2).to_pylist() + batch.column(3).to_pylist())
            sizes = np.bincount(text, minlength=2 * n)
            pair = text % max(n, 1)
            order = np.lexsort((hashes, pair))
            same = (hashes[order][1:] == hashes[order][:-1]) & (pair[order][1:] == pair[order][:-1])
            common = np.bincount(pair[order][1:][same], minlength=n)
            similar = common >= SIMILARITY * (sizes[:n] + sizes[n:] - common) - 1e-9
            yield batch.select([0, 1]).filter(pa.array(similar))

    return pairs.mapInArrow(run, "a long, b long")


def _compared(keys: DataFrame) -> DataFrame:
    """Pairs (a, b), each once: the members of each bucket with its first and with its last one."""
    ends = written(keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least != most"))
    met = keys.join(ends, "key")
    pairs = met.select(F.explode(F.array(F.struct(F.col("least").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("most").alias("b")))).alias("p"))
    return pairs.select("p.*").where("a != b").distinct()


def _shared_first(classes: DataFrame) -> DataFrame:
    """(key, node, n) of those first shingles of ``classes`` (node, n, first) that several have."""
    keys = classes.select("node", "n", F.explode("first").alias("key"))
    several = written(keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least != most").select("key"))
    return keys.join(small(several), "key", "left_semi")


def _apart(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """``shared`` (key, node, n) with each node's root, for the keys that nodes of several roots have."""
    rooted = shared.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("key")
    return rooted.join(several, "key", "left_semi")


def _alike(a: Column, b: Column) -> Column:
    return (a >= b * SIMILARITY - 1e-9) & (b >= a * SIMILARITY - 1e-9)


def _with_pivots(met: DataFrame, pivots: int) -> DataFrame:
    """Pairs (a, b), each once, of each key's nodes in ``met`` (key, node, n, root) with some nodes of
    the key, where size and root allow it."""
    ends = met.groupBy("key").agg(F.array(*(F.min(F.struct(F.xxhash64(F.lit(i), "node").alias("h"), "node", "n", "root")) for i in range(pivots))).alias("ends"))
    good = F.filter("ends", lambda x: (x.root != F.col("root")) & _alike(x.n, F.col("n")))
    pairs = met.join(ends, "key").select("node", F.explode(F.array_distinct(F.transform(good, lambda x: x.node))).alias("other"))
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _unlinked(met: DataFrame, classes: DataFrame) -> DataFrame:
    """All pairs (a, b), each once, of ``met`` (key, node, n, root) that share a key, differ in their
    roots and by size and parities can be similar."""
    known = met.join(classes.select("node", "odd"), "node")
    one, two = (known.select("key", *(F.col(x).alias(f"{x}_{side}") for x in ("node", "n", "root", "odd"))) for side in "ab")
    differ = sum((F.bit_count(F.col("odd_a")[i].bitwiseXOR(F.col("odd_b")[i])) for i in range(PARITY_WORDS)), F.lit(0))
    few = differ <= (F.col("n_a") + F.col("n_b")) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6
    met_twice = one.join(two, (one["key"] == two["key"]) & (F.col("root_a") < F.col("root_b")) & _alike(F.col("n_a"), F.col("n_b")) & few)
    return met_twice.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _pairs_apart(met: DataFrame) -> tuple[int, int]:
    """Rows of ``met``, and pairs of rows of a key and of different roots."""
    of_key = met.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    found = of_key.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()
    return int(found[0] or 0), int(found[1] or 0)


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``pairs`` (a, b) without those whose sizes or ``long_parities`` rule them out: a share of their
    texts' bytes is read, and of long texts that only share a passage few are left."""

    @lean("words")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            differ = np.fromiter(map(differing, batch.column(4).to_pylist(), batch.column(5).to_pylist()), np.int64, batch.num_rows)
            good = (differ <= (a + b) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6) & (np.minimum(a, b) >= np.maximum(a, b) * SIMILARITY - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(good))

    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "parity_a", "parity_b").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, classes: DataFrame, documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) of ``pairs`` of ``classes`` whose texts in ``documents`` are similar."""
    pairs = scratch.written(_possible(pairs, classes))
    wanted = scratch.written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node").select("node", F.col("place.doc_id").alias("_id"), F.col("place.text_hash").alias("_hash")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    bodies = scratch.written(_texts(documents).join(small(wanted), same).select("node", "text").dropDuplicates(["node"]))
    left = pairs.join(bodies.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return scratch.written(_similar(left.join(bodies.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")))


def near_groups(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, kept_id, kept_hash) for each different row of ``documents``
    (doc_id, text): the id and text hash of the row that stands for its group, the least of them,
    null ids last.

    Texts of the same words, case aside, are one class; classes of which ``SIMILARITY`` of the
    five-word shingles are common are linked, and a group is what links lead to. All texts without
    words are one class. Null texts count as empty. The driver gets counts, and those of the shingles
    of about ``ORDER_ROWS`` texts.
    """
    with Scratch() as scratch:
        rows = scratch.written(_signatures(documents))
        place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
        classes = rows.groupBy("words").agg(F.min(place).alias("place"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("first").alias("first"), F.first("odd").alias("odd"), F.first("parity").alias("parity"))
        classes = scratch.written(classes.withColumn("node", F.monotonically_increasing_id()))
        pairs = scratch.written(_compared(classes.select("node", F.explode("keys").alias("key"))))
        links = _linked(pairs, classes, documents, scratch)
        roots = scratch.written(connected_components(links))
        shared = scratch.written(_shared_first(classes))
        # a large group of near copies is tied by pairs with a few of it, before all others are listed
        met = scratch.written(_apart(shared, roots))
        for pivots in (*PIVOTS, None):
            if pivots:
                rows_met, apart = _pairs_apart(met)
                if apart <= FEW_PAIRS * rows_met:
                    continue
            others = scratch.written((_with_pivots(met, pivots) if pivots else _unlinked(met, classes)).join(pairs, ["a", "b"], "left_anti"))
            if not others.isEmpty():
                links = links.unionAll(_linked(others, classes, documents, scratch))
                pairs = pairs.unionAll(others)
                roots = scratch.written(connected_components(links))
                if pivots:
                    met = scratch.written(_apart(shared, roots))
        members = roots.join(classes.select("node", "place"), "node")
        least = members.groupBy("root").agg(F.min("place").alias("kept"))
        linked = roots.join(least, "root").select("node", "kept")
        kept = scratch.written(classes.join(linked, "node", "left").select("words", F.coalesce("kept", "place").alias("kept")))
        each = rows.select("doc_id", "text_hash", "words").distinct().join(kept, "words")
        return written(each.select("doc_id", "text_hash", F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_hash").alias("kept_hash")))


def keep_one_per_group(documents: DataFrame) -> DataFrame:
    """One row of each of the ``near_groups`` of ``documents``: that of the least doc_id, then text
    hash, null ids last; all columns stay. Of rows that repeat it one is kept.
    """
    groups = near_groups(documents)
    kept = written(groups.where("doc_id <=> kept_id and text_hash = kept_hash").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
    counts = documents.groupBy(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash")).agg(F.count("*").alias("_n"))
    several = written(counts.where("_n > 1").select("_id", "_hash"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    of_kept = documents.join(small(kept), same, "left_semi")
    if several.isEmpty():
        return of_kept
    once = of_kept.join(small(several), same, "left_anti")
    return once.unionByName(of_kept.join(small(several), same, "left_semi").dropDuplicates(["doc_id", "text"]))
