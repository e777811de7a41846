"""Scores of a block of queries against batches of rows, of which a task keeps the best k a query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that are scored at once, and how many times its result a task holds before it is pruned.
ROWS_AT_ONCE = 1_000
SLACK = 8


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest scores of each row, of equal ones those further left."""
    n = scores.shape[1]
    if n <= k:
        return np.divmod(np.arange(scores.size), max(n, 1))
    least = np.partition(scores, n - k, axis=1)[:, n - k, None]
    above, equal = scores > least, scores == least
    equal &= np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | equal)


class Best:
    """The best k (query_id, doc_id, score) of each query among what was added, ties by doc_id."""

    def __init__(self, query_ids: pa.Array, k: int) -> None:
        self.query_ids, self.k = query_ids, k
        #: The k-th best score of each query when last pruned; 0 before it has so many.
        self.least = np.zeros(len(query_ids))
        self.held: list[pa.RecordBatch] = []
        self.rows = 0

    def add(self, doc_ids: pa.Array, scores: np.ndarray) -> None:
        """``scores``: a row for each query, a column for each doc_id, these ascending; negative
        ones are no hits."""
        row, column = best_of(scores, self.k)
        hit = scores[row, column] >= 0
        row, column = row[hit], column[hit]
        self.add_hits(row, doc_ids.take(pa.array(column)), scores[row, column])

    def add_hits(self, row: np.ndarray, doc_ids: pa.Array, scores: np.ndarray) -> None:
        """One document and score for each number of a query in ``row``."""
        self.held.append(pa.RecordBatch.from_arrays([pa.array(row), doc_ids, pa.array(scores)], ["query", "doc_id", "score"]))
        self.rows += len(row)
        if self.rows > SLACK * self.k * len(self.query_ids):
            self.prune()

    def prune(self) -> None:
        rows = pa.Table.from_batches(self.held).sort_by([("query", "ascending"), ("score", "descending"), ("doc_id", "ascending")]).combine_chunks()
        query = rows.column("query").to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        last = place == self.k - 1
        self.least[query[last]] = rows.column("score").to_numpy()[last]
        self.held = rows.filter(pa.array(place < self.k)).to_batches()
        self.rows = sum(x.num_rows for x in self.held)

    def batches(self) -> list[pa.RecordBatch]:
        if not self.rows:
            return []
        self.prune()
        return [pa.RecordBatch.from_arrays([self.query_ids.take(x.column(0)), x.column(1), x.column(2)], ["query_id", "doc_id", "score"]) for x in self.held]


def slices(batch: pa.RecordBatch, key: int = 0, rows: int | None = None) -> list[pa.RecordBatch]:
    """Parts of a batch, each in the order of its key column."""
    rows = rows or ROWS_AT_ONCE
    parts = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)]
    return [x.take(pc.sort_indices(x.column(key))) for x in parts]
