"""Token ids in canonical length-limited Huffman code, in independent blocks.

A block holds whole documents. Its bytes, little-endian: 4 letters ``HTB2``; uint32 documents,
ids and checkpoint distance; for each document its id (int64) and count (uint32) and whether the
id is null (uint8); a uint64 bit offset for each checkpoint; then the codes, highest bit first,
each document from a new byte. The decoder walks all checkpoints of a block at once, one table
look-up for each id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

STRIDE = 128
MAGIC = b"HTB2"


def most_bits(ids: int) -> int:
    """A limit that costs little for so many ids and keeps the decoding table small."""
    return max(14, math.ceil(math.log2(max(2, ids))) + 2)


def code_lengths(counts: np.ndarray, max_bits: int | None = None) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` (package-merge), by default ``most_bits``; 0
    where the count is 0."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    max_bits = max_bits or most_bits(n)
    if n == 0:
        return lengths
    if n == 1:
        lengths[used] = 1
        return lengths
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids need codes of more than {max_bits} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    level, is_leaf = leaves, []
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        is_leaf.append(order < n)
    take, bits = 2 * n - 2, np.zeros(n, np.uint8)
    for leaf in reversed(is_leaf):
        chosen = int(leaf[:take].sum())
        bits[:chosen] += 1
        take = 2 * (take - chosen)
    bits[:take] += 1  # the first level has leaves alone
    lengths[used] = bits
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The codes: shorter ones first, ids in ascending order within a length."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0]:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


@dataclass
class Coder:
    lengths: np.ndarray

    def __post_init__(self) -> None:
        self.codes = canonical_codes(self.lengths)
        self._sizes = self.lengths.astype(np.int64)
        self._aligned = self.codes.astype(np.uint64) << (64 - np.maximum(self._sizes, 1)).astype(np.uint64)
        self._table: tuple[np.ndarray, int] | None = None

    def encode(self, documents: list[tuple[int | None, np.ndarray]]) -> bytes:
        """A block of (id or null, token ids) with at least one document; each has a token."""
        counts = np.array([len(x) for _, x in documents], np.int64)
        if counts.max() >= 1 << 32:
            raise ValueError("a document of 2**32 tokens or more")
        ids = np.concatenate([x for _, x in documents])
        size = self._sizes[ids]
        begin = np.cumsum(size) - size
        ends = np.cumsum(counts)
        firsts = ends - counts
        whole = (np.add.reduceat(size, firsts) + 7) // 8 * 8
        begin += np.repeat(np.cumsum(whole) - whole - begin[firsts], counts)
        total = int(whole.sum())
        words = np.zeros(total // 64 + 2, np.uint64)
        at, skip = begin >> 6, begin & 63
        code = self._aligned[ids]
        new = np.flatnonzero(np.diff(at, prepend=-1))
        words[at[new]] = np.bitwise_or.reduceat(code >> skip.astype(np.uint64), new)
        over = np.flatnonzero(skip + size > 64)
        words[at[over] + 1] |= code[over] << (64 - skip[over]).astype(np.uint64)
        marks = np.concatenate([begin[a:b:STRIDE] for a, b in zip(firsts, ends, strict=True)]).astype("<u8")
        head = np.array([len(documents), len(ids), STRIDE], "<u4").tobytes()
        names = np.array([x or 0 for x, _ in documents], "<i8").tobytes()
        nulls = np.array([x is None for x, _ in documents], np.uint8).tobytes()
        return b"".join([MAGIC, head, names, counts.astype("<u4").tobytes(), nulls, marks.tobytes(), words.astype(">u8").tobytes()[: total // 8]])

    def _tables(self) -> tuple[np.ndarray, int]:
        """For every window of as many bits as the longest code: 32 times its first id, plus that
        id's length."""
        if self._table is None:
            used = np.flatnonzero(self.lengths)
            width = int(self.lengths.max(initial=1))
            used = used[np.argsort(self._aligned[used], kind="stable")]
            spans = 1 << (width - self._sizes[used])
            pad = (1 << width) - int(spans.sum())
            entries = used.astype(np.uint32) * 32 + self.lengths[used]
            self._table = np.concatenate([np.repeat(entries, spans), np.ones(pad, np.uint32)]), width
        return self._table

    def decode(self, block: bytes) -> list[tuple[int | None, np.ndarray]]:
        if block[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        documents, total, stride = (int(x) for x in np.frombuffer(block, "<u4", 3, 4))
        at = 16
        names = np.frombuffer(block, "<i8", documents, at)
        counts = np.frombuffer(block, "<u4", documents, at + 8 * documents).astype(np.int64)
        nulls = np.frombuffer(block, np.uint8, documents, at + 12 * documents)
        lanes = (counts + stride - 1) // stride
        at += 13 * documents
        position = np.frombuffer(block, "<u8", int(lanes.sum()), at).astype(np.int64)
        data = np.frombuffer(block, np.uint8, offset=at + 8 * len(position))
        data = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        window = (data[:-4] << 24) | (data[1:-3] << 16) | (data[2:-2] << 8) | data[3:-1]
        firsts = np.cumsum(counts) - counts
        lane = np.arange(len(position)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        out_at = np.repeat(firsts, lanes) + lane * stride
        length = np.minimum(stride, np.repeat(counts, lanes) - lane * stride)
        table, width = self._tables()
        ids = np.empty(total, np.uint32)
        order = np.argsort(-length, kind="stable")
        position, out_at, length = position[order], out_at[order], length[order]
        alive = np.searchsorted(-length, -np.arange(stride), side="left")  # lanes longer than each step
        for step in range(int(length[0]) if len(length) else 0):
            n = int(alive[step])
            here = position[:n]
            entry = table[(window[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(32 - width)]
            ids[out_at[:n] + step] = entry >> 5
            here += entry & 31
        return [(None if null else int(name), x) for name, null, x in zip(names, nulls, np.split(ids, np.cumsum(counts)[:-1]), strict=True)] if documents else []
