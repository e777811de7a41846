import numpy as np
from texts import prose

from tessera.llm import simhash_dedup as sd


def plain_parity(shingles, bits):
    odd = np.zeros(bits, np.uint8)
    for h in sd._mixed(np.array(shingles, np.uint64)).tolist():
        odd[h % bits] ^= 1
    return np.packbits(odd).tobytes()


def test_long_parities_differ_in_no_more_bits_than_texts_in_shingles(rng):
    words = prose(rng, 3000).split()
    texts = [None, "", "one", *(" ".join(words[:n]) for n in (4, 100, 256, 262, 300, 1000, 1200, 2900, 3000)), " ".join(words[400:])]
    hashes, text, _ = sd.shingle_sets([None if t is None else t.encode() for t in texts])
    found = sd.long_parities(hashes, text, len(texts))
    sets = [set(hashes[text == i].tolist()) for i in range(len(texts))]
    assert found == [plain_parity(sorted(s), 8 * len(x)) for s, x in zip(sets, found, strict=True)]
    assert all(8 * len(x) >= max(512, 2 * len(s)) for s, x in zip(sets, found, strict=True)) and len(set(map(len, found))) > 3
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            bits = 8 * min(len(found[i]), len(found[j]))
            plain = np.bitwise_count(np.frombuffer(plain_parity(sorted(a ^ b), bits), np.uint8)).sum()
            assert sd.differing(found[i], found[j]) == plain <= len(a ^ b)


def test_texts_of_long_pairs_that_share_a_passage_are_not_read(spark, rng, monkeypatch):
    often = [prose(rng, 600) for _ in range(6)]
    texts = []
    for i in range(24):
        passage = prose(rng, 900)
        texts += [f"{passage} {often[i % 6]}", f"{passage} {often[(i + 1) % 6]}"]
    words = prose(rng, 1500).split()
    texts += [" ".join(words), " ".join([*words[:700], "changed", *words[701:]])]
    compared, similar = [], sd._similar
    monkeypatch.setattr(sd, "_similar", lambda pairs: compared.append(pairs.count()) or similar(pairs))
    got = {r.doc_id: r.kept_id for r in sd.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(49)} | {49: 48}
    assert sum(compared) <= 2  # 25 before: the passages' pairs, too
