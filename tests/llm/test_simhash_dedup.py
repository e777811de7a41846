import itertools
import re

import xxhash
from texts import prose

from tessera.llm.components import connected_components
from tessera.llm.simhash_dedup import covering_masks, fingerprint, hex_fingerprint, keep_one_per_group, masks_for, near_groups, simhash_groups


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{index: smallest id reachable} of (doc_id, fingerprint) rows, all pairs compared."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
            parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [least.get(find(i)) for i in range(len(prints))]


def test_masks_cover_every_pair_within_the_radius():
    for radius, field in ((1, 2), (2, 2), (2, 3), (1, 5), (2, 5)):
        masks = covering_masks(radius, field=field)
        assert len(masks) == (field ** (radius + 1) - 1) // (field - 1)
        for bits in itertools.combinations(range(64), radius):
            assert any(all(not m >> b & 1 for b in bits) for m in masks)


def test_fingerprint_is_the_contract(rng):
    texts = [None, "", " \t", "One", "Two words", "THREE Words Here", "É É é ÀB cD eF", "a\x0bb\x1cc\x85d e\xa0f g", *(prose(rng, n).title() for n in (3, 4, 50, 700))]
    for text in texts:
        assert fingerprint(None if text is None else text.encode()) % 2**64 == plain_fingerprint(text)


def test_groups_equal_brute_force(spark, rng):
    rows = []
    for i in range(60):
        words = prose(rng, rng.choice([1, 2, 5, 300])).split()
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.choice([0, 0, 1, 6])):
            copy = list(words)
            if len(copy) > 10:
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy).upper()))
    rows += [(None, rows[5][1]), (len(rows), None), (len(rows) + 1, ""), (3, rows[3][1]), (None, None)]
    got = simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", hex_fingerprint().alias("h"), "component_id").collect()
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    expected = [(i, f"{fp:016x}", c) for (i, fp), c in zip(prints, plain_components(prints), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_a_chain_of_fingerprints_is_one_group(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_more_fingerprints_take_masks_that_keep_more_bits():
    sizes = [10, 10**6, 10**10, 10**11, 10**13]
    kept = [min(m.bit_count() for m in masks_for(n)) for n in sizes]
    assert kept == sorted(kept) and all(2**k > 8 * n for k, n in zip(kept, sizes, strict=True))
    assert [len(masks_for(n)) for n in sizes] == [7, 7, 13, 13, 31]


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, share):
    out = list(words)
    for _ in range(max(1, round(share * len(words)))):
        at, kind = rng.randrange(len(out)), rng.random()
        out[at : at + (kind < 0.8)] = [prose(rng, 1)] if kind > 0.2 else []
    return out


def test_near_groups_hold_what_brute_force_links(spark, rng):
    rows, texts = [], []
    for n in (8, 12, 20, 30, 50, 90, 96, 100, 150, 200, 400, 400, 1600) * 14:
        words = prose(rng, n).split()
        texts.append(words)
        texts += [edited(rng, words, rng.choice([0.004, 0.01, 0.02, 0.03])) for _ in range(rng.choice([0, 1, 2]))]
    rows = list(enumerate(map(" ".join, texts)))
    sets = [shingles(t) for _, t in rows]
    near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if jaccard(sets[i], sets[j]) >= 0.8]
    got = {r.doc_id: r.kept_id for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 60
    assert sum(got[i] == got[j] for i, j in near) >= 0.98 * len(near)
    allowed = plain_groups(len(rows), near)
    assert all(allowed[i] == allowed[k] for i, k in got.items()) and all(k <= i for i, k in got.items())


def plain_groups(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def test_near_groups_leave_no_pair_out(spark, rng):
    shared = prose(rng, 30)
    texts = []
    for n in (6, 9, 10, 12, 15, 25, 60, 200) * 50:
        words = prose(rng, n).split()
        if rng.random() < 0.4:
            words += shared.split()  # many texts meet by what they share and are not similar
        texts += [words] + [edited(rng, words, rng.choice([0.01, 0.02, 0.035])) for _ in range(rng.choice([0, 1, 2]))]
    rng.shuffle(texts)
    rows = list(enumerate(map(" ".join, texts)))
    sets = [shingles(t) for _, t in rows]
    near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if jaccard(sets[i], sets[j]) >= 0.8]
    got = {r.doc_id: r.kept_id for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 60 and [got[i] for i in range(len(rows))] == plain_groups(len(rows), near)


def test_a_large_group_of_near_copies_is_one(spark, rng):
    words = prose(rng, 150).split()
    rows = [(i, " ".join(edited(rng, words, 0.005))) for i in range(300)] + [(1000 + i, prose(rng, 80)) for i in range(50)]
    kept = {r.doc_id for r in keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0} | {1000 + i for i in range(50)}


def test_one_of_each_group_stays(spark, awkward, empty):
    kept = keep_one_per_group(awkward)
    assert kept.columns == awkward.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x or 0))
    assert ids == [1, 1, 2, 4, None]  # 2, 3 and 5 have no word, nor has one null id; both texts of id 1 stay, once
    assert keep_one_per_group(empty).count() == 0 and simhash_groups(empty).count() == 0


def test_copies_with_ids_of_their_own_and_shared_ones(spark, rng):
    x, y = prose(rng, 40), prose(rng, 40)
    rows = [(0, x), (1, y), (1, x.upper()), (2, y), (2, y), (None, x), (None, "alone"), (None, "alone")]
    kept = keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(0, x), (1, y), (None, "alone")], key=str)
