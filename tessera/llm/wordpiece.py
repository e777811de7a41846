"""Greedy word-piece counts by a longest-match automaton, linear in the bytes of a word.

A trie over the pieces that start a word and, from a second root, over those that continue one.
Where no edge fits, a failure link leads to the node of what is left after the longest pieces were
taken off the front; how many were taken is stored with the link, so that counting needs no piece.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_small_batches

MEMO_ENTRIES = 600_000
_automata: dict[str, tuple[Automaton, dict[bytes, int]]] = {}


class Automaton:
    def __init__(self, first: Iterable[bytes], later: Iterable[bytes]) -> None:
        self.edges: dict[int, int] = {}  # node * 256 + byte -> node
        self.start, self.inner = 0, 1
        children: list[list[tuple[int, int]]] = [[], []]
        ends: set[int] = set()
        for root, pieces in ((self.start, first), (self.inner, later)):
            for piece in pieces:
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    if key not in self.edges:
                        self.edges[key] = len(children)
                        children[node].append((byte, len(children)))
                        children.append([])
                    node = self.edges[key]
                if piece:
                    ends.add(node)
        self.link = [-1] * len(children)
        self.taken = [0] * len(children)
        queue = deque([self.start, self.inner])
        while queue:
            parent = queue.popleft()
            for byte, node in children[parent]:
                queue.append(node)
                if node in ends:
                    self.link[node], self.taken[node] = self.inner, 1
                    continue
                at, n = self.link[parent], self.taken[parent]
                while at >= 0 and (at << 8 | byte) not in self.edges:
                    n += self.taken[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.taken[node] = self.edges[at << 8 | byte], n

    def count(self, word: bytes) -> int:
        """Pieces of the word; 1, the unknown piece, where no row of pieces gives the word."""
        if not word:
            return 0
        node, total = self.start, 0
        for byte in word:
            while (after := self.edges.get(node << 8 | byte)) is None:
                total += self.taken[node]
                node = self.link[node]
                if node < 0:
                    return 1
            node = after
        while node != self.inner:
            total += self.taken[node]
            node = self.link[node]
            if node < 0:
                return 1
        return total


def byte_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces that start and that continue a word, from a byte-level tokenizers file: those written
    after a space and the others. Every single byte may start a word, too."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    letters = {chr(b if b in plain else next(spare)): b for b in range(256)}
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    pieces = [bytes(letters[c] for c in piece) for piece in vocabulary if all(c in letters for c in piece)]
    first = {x[1:] for x in pieces if x[:1] == b" " and len(x) > 1} | {bytes([b]) for b in range(256)}
    later = {x for x in pieces if x[:1] != b" "} | {bytes([b]) for b in range(256)}
    return sorted(first), sorted(later)


def token_counts(documents: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row of ``documents`` (doc_id, text).

    Words are what stands between ASCII white space, whole and of any length. Null and empty texts
    have 0 of each; null ids and repeated rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _automata:
            _automata[vocabulary] = Automaton(*byte_pieces(vocabulary)), {}
        automaton, memo = _automata[vocabulary]
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                words = (text or b"").split()
                counts = list(map(memo.get, words))
                if None in counts:
                    if len(memo) > MEMO_ENTRIES:
                        memo.clear()
                    for i, x in enumerate(counts):
                        if x is None:
                            counts[i] = memo[words[i]] = automaton.count(words[i])
                n_words.append(len(words))
                n_tokens.append(sum(counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(n_words, np.int64)), pa.array(np.array(n_tokens, np.int64))], ["doc_id", "n_words", "n_tokens"])

    rows = in_small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
