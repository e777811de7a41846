"""Token ids of documents on disk, in ascending doc_id order: written and read as Huffman blocks.

A store is a folder of Parquet tables, so any file system that Spark writes to can hold it:
``blocks`` (part int, start long, n_ids long, block binary: the format of ``huffman``), ``code``
(id int, bits int) and ``parts`` (part int, ids_before long). Parts are ranges of doc_id; ``start``
counts the ids before a block in its part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import in_small_batches, new_path, numbered_copies, remove, small
from tessera.llm.huffman import Coder, code_lengths

BLOCK_IDS = 1 << 18
#: Bytes of the texts of a part, which is one task's, and parts at most.
PART_BYTES = 24_000_000
MOST_PARTS = 100_000
TOKENIZED_NAMES = ["part", "start", "doc_id", "n", "ids", "counts"]


def tokenized(documents: DataFrame, tokenizer: str, end_id: int, drops_space: bool) -> DataFrame:
    """(part int, start long, doc_id long, n long, ids binary, counts binary): each part in the
    order of doc_id, then text hash; start: ids of the part before the row. Each task adds a row of
    part -1 with how often it met each id, as int64.

    Parts are ranges of (doc_id, text hash, number of the copy), so that an id or a text that very
    many rows share is in several of them.
    """
    rows = numbered_copies(in_small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MOST_PARTS, max(1, math.ceil(size / PART_BYTES)))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text"), F.col("copy")]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.tokens import encoder

        encode = encoder(tokenizer, drops_space)
        end = np.array([end_id], encode.dtype).tobytes()
        total, counts = 0, np.zeros(0, np.int64)
        for batch in batches:
            ids = [x + end for x in encode.encode(batch.column(2).to_pylist())]
            n = np.array([len(x) for x in ids], np.int64) // encode.dtype.itemsize
            start = total + np.cumsum(n) - n
            total += int(n.sum())
            more = np.bincount(np.frombuffer(b"".join(ids), encode.dtype), minlength=len(counts))
            more[: len(counts)] += counts
            counts = more
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(start), batch.column(1), pa.array(n), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())],
                TOKENIZED_NAMES,
            )
        last = [pa.array([-1], pa.int32()), pa.array([0]), pa.nulls(1, pa.int64()), pa.array([0]), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(last, TOKENIZED_NAMES)

    return ranged.mapInArrow(run, "part int, start long, doc_id long, n long, ids binary, counts binary")


def _numbers(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}")


def _counts(rows: DataFrame) -> DataFrame:
    """(id int, n long) from the rows of part -1; a task sends at most one row for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                counts = np.frombuffer(raw, np.int64)
                total = np.pad(total, (0, max(0, len(counts) - len(total))))
                total[: len(counts)] += counts
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    return rows.where("part = -1").select("counts").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _blocks(rows: DataFrame, coder: Coder) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, np.ndarray]] = []
        part, first, size = -1, 0, 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64()), pa.array([coder.encode(held)], pa.binary())],
                ["part", "start", "n_ids", "block"],
            )

        for batch in batches:
            for of, start, doc_id, n, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and (size + n > BLOCK_IDS or of != part or start != first + size):
                    yield block()
                    held, size = [], 0
                if not held:
                    part, first = of, start
                held.append((doc_id, _numbers(raw, n)))
                size += n
        if held:
            yield block()

    return rows.mapInArrow(run, "part int, start long, n_ids long, block binary")


def write_store(documents: DataFrame, tokenizer: str, path: str, end_id: int = 2, drops_space: bool = False) -> None:
    """Writes the tokens of ``documents`` (doc_id, text), each with ``end_id`` at its end.

    A null text counts as empty; rows with a null doc_id come first; rows that share a doc_id
    are ordered by text hash and all stay; an empty table gives an empty store; other columns are
    ignored. ``drops_space``: see ``MemoEncoder``. The driver gets one count for each id of the
    vocabulary, never one for each document.
    """
    spark = documents.sparkSession
    scratch = new_path(spark)
    tokenized(documents, tokenizer, end_id, drops_space).write.option("compression", "zstd").parquet(scratch)
    rows = spark.read.parquet(scratch)
    found = _counts(rows).collect()
    rows = rows.where("part >= 0").drop("counts")
    counts = np.zeros(max((x["id"] for x in found), default=0) + 1, np.int64)
    for x in found:
        counts[x["id"]] = x["n"]
    coder = Coder(code_lengths(counts))
    _blocks(rows, coder).write.option("compression", "none").parquet(f"{path}/blocks")
    code = [(int(i), int(coder.lengths[i])) for i in np.flatnonzero(coder.lengths)]
    spark.createDataFrame(code, "id int, bits int").coalesce(1).write.parquet(f"{path}/code")
    sizes = rows.groupBy("part").agg(F.sum("n").alias("n"))
    # one row for each part: MOST_PARTS at most
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    sizes.select("part", before.alias("ids_before")).write.parquet(f"{path}/parts")
    remove(spark, scratch)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id long, start long, n_tokens long, ids binary of uint32) from a store's files."""
    code = spark.read.schema("id int, bits int").parquet(f"{path}/code").collect()
    lengths = np.zeros(max((x["id"] for x in code), default=0) + 1, np.uint8)
    for x in code:
        lengths[x["id"]] = x["bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(lengths)
        for batch in batches:
            for part, start, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                documents = coder.decode(block)
                n = np.array([len(x) for _, x in documents], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(n), part, np.int32)),
                        pa.array([x for x, _ in documents], pa.int64()),
                        pa.array(start + np.cumsum(n) - n),
                        pa.array(n),
                        pa.array([x.astype("<u4").tobytes() for _, x in documents], pa.binary()),
                    ],
                    ["part", "doc_id", "in_part", "n_tokens", "ids"],
                )

    blocks = in_small_batches(spark.read.schema("part int, start long, n_ids long, block binary").parquet(f"{path}/blocks"))
    parts = spark.read.schema("part int, ids_before long").parquet(f"{path}/parts")
    documents = blocks.select("part", "start", "block").mapInArrow(run, "part int, doc_id long, in_part long, n_tokens long, ids binary")
    return documents.join(small(parts), "part").select("doc_id", (F.col("ids_before") + F.col("in_part")).alias("start"), "n_tokens", "ids")
