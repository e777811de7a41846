import sys

import numpy as np
from texts import prose
from xxhash import xxh64_intdigest

from tessera.llm import line_dedup as ld


def test_rows_differ_as_their_bytes_do():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2, 400).astype(np.uint64)
    first, other = rng.integers(0, 390, (2, 3000))
    end, other_end = first + rng.integers(0, 5, 3000), other + rng.integers(0, 5, 3000)
    plain = [hashes[a : b + 1].tobytes() != hashes[c : d + 1].tobytes() for a, b, c, d in zip(first, end, other, other_end, strict=True)]
    assert ld._rows_differ(hashes, first, end, other, other_end).tolist() == plain and 0 < sum(plain) < 3000
    assert ld._rows_differ(hashes, *[np.zeros(0, np.int64)] * 4).tolist() == []


def test_repeats_in_a_text_take_no_step_each(rng):
    passage = [f"{prose(rng, 8).capitalize()}.\n" for _ in range(30)]
    texts = ["".join(passage * 40).encode(), "".join(passage).encode()]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    steps = []
    sys.setprofile(lambda frame, event, _: steps.append(frame.f_code.co_name) if event == "call" and frame.f_code.co_filename == ld.__file__ else None)
    try:
        found = ld.Chunks.of(data, bounds, xxh64_intdigest)
    finally:
        sys.setprofile(None)
    row = lambda i: (found.lines.text[found.first[i]], found.lines.hash[found.first[i] : found.end[i] + 1].tobytes())
    seen: dict = {}
    assert [seen.setdefault(row(i), i) for i in range(len(found.first))] == found.origin.tolist()
    assert (found.origin != np.arange(len(found.origin))).sum() > 300
    assert steps.count("<lambda>") == 0  # two for each repeat, before
