"""What the operators share: tables, Arrow batches, bounded samples, and copies that are told apart."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, MutableMapping
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.scratch import Scratch, in_few_files, new_path, remove, small, written, written_at

__all__ = ["Scratch", "in_few_files", "in_parts", "in_small_batches", "kept", "lean", "new_path", "numbered_copies", "remove", "sampled", "small", "spare", "table", "written", "written_at"]

#: Rows of an Arrow batch.
ARROW_ROWS = 1_000
#: Equal rows that may stay together; of more, each gets a number by which they can be dealt out.
COPIES_TOGETHER = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, after telling its session to hand Python few rows at once: texts are long, and both
    sides hold a whole batch."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df


#: What a Python worker keeps from one task to the next, by the name of what it is for.
kept: dict[str, MutableMapping] = {}


@contextmanager
def spare(keeps: str = "") -> Iterator[None]:
    """For a task of a Python worker that has other stages' memory still: what is ``kept`` for
    another purpose is forgotten, and free memory goes back to the system before and after."""
    for name, x in kept.items():
        if name != keeps:
            x.clear()
    _give_back()
    try:
        yield
    finally:
        _give_back()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def lean(keeps: str = "") -> Callable:
    """A function of batches for ``mapInArrow``, run within ``spare``."""

    def of(run: Callable) -> Callable:
        @wraps(run)
        def leanly(batches: Iterator) -> Iterator:
            with spare(keeps):
                yield from run(batches)

        return leanly

    return of


def in_parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def hash_limit(rows: int, total: int) -> int:
    """The greatest of the signed 64-bit hashes that are chosen, so that of ``total`` ids about
    ``rows`` are, whatever the total; all of them where there are no more."""
    return (min(rows, total) << 64) // max(1, total) - 2**63 - 1


def sampled(df: DataFrame, rows: int, total: int, seed: int, key: str = "doc_id") -> DataFrame:
    """About ``rows`` of the ``total`` rows of ``df``, chosen by a hash of ``key``."""
    limit = hash_limit(rows, total)
    return df.where(F.xxhash64(F.lit(seed), F.col(key)) <= F.lit(max(limit, -(2**63))).cast("long"))


def _as_many(rows: DataFrame, together: int) -> DataFrame:
    """Each row of ``rows`` (doc_id, text, n) n times, with ``copy`` from 0; the copies of one row
    are made by many tasks."""
    parts = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / together))).alias("part"))
    dealt = parts.repartition("doc_id", "part")
    first = F.col("part") * together
    return dealt.select("doc_id", "text", F.explode(F.sequence(first, F.least(first + together, F.col("n")) - 1)).alias("copy"))


def numbered_copies(rows: DataFrame, together: int = COPIES_TOGETHER) -> DataFrame:
    """``rows`` (doc_id, text) with ``copy`` (long): 0, but 0, 1, 2, ... for rows of which more than
    ``together`` are equal, so that a hash that takes it deals them out.

    Only a number and a hash of each row are shuffled, and what is equal collapses first.
    """
    key = rows.select("doc_id", F.xxhash64("text").alias("_hash"))
    often = written(key.groupBy("doc_id", "_hash").agg(F.count("*").alias("_n")).where(F.col("_n") > together).select(F.col("doc_id").alias("_id"), "_hash"))
    if often.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    same: Column = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    seldom = rows.join(small(often), same, "left_anti").withColumn("copy", F.lit(0).cast("long"))
    many = rows.join(small(often), same, "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    return seldom.unionByName(_as_many(many, together))
