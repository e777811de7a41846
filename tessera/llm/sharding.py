"""Shards in random order by a two-pass external shuffle, in DataFrame operations alone.

First pass: each row is scattered by seeded hashes, over the shards (by rendezvous: the shard
whose hash with the doc_id is highest) and over buckets of a shard that a task can hold. Second
pass: each bucket is put in order, Fisher-Yates-shuffled by ``shuffle`` and written.

A bucket's size follows the memory of an executor's core. Where there are more buckets than one
scatter should have, rows are first written in groups of buckets, and each group is scattered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, numbered_copies, small

#: A bucket's bytes at least and at most; in between, this share of the memory of a core.
LEAST_BUCKET, MOST_BUCKET, MEMORY_SHARE = 8_000_000, 256_000_000, 1 / 32
#: Cores of an executor where the session doesn't say.
CORES = 8
#: Buckets of one scatter.
BUCKETS_AT_ONCE = 20_000
SHARDS = 24
SEED = 20


def row_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text, none for null, plus the 8 of the id."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def shard_of(doc_id: str, shards: int, seed: int = SEED) -> Column:
    """The rendezvous shard: one shard more takes rows only into itself. Null ids share a shard."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.struct(F.xxhash64(F.lit(seed), F.col(doc_id), j).alias("draw"), j.alias("shard")))
    return F.array_max(draws)["shard"]


def bucket_size(spark: SparkSession) -> int:
    conf = spark.sparkContext.getConf()
    local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    memory = conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g")
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(memory)
    cores = spark.sparkContext.defaultParallelism if local else int(conf.get("spark.executor.cores", str(CORES)))
    return int(min(MOST_BUCKET, max(LEAST_BUCKET, size / max(1, cores) * MEMORY_SHARE)))


def _write_buckets(dealt: DataFrame, buckets: int, first: int, base: DataFrame, path: str, seed: int) -> None:
    """Shuffles and writes buckets ``first`` to ``first + buckets - 1``, each in a task of its own."""
    number = (F.col("bucket") - first).cast("int")
    rows = dealt.withColumn("number", number).repartitionById(buckets, "number").groupBy("number").agg(
        F.first("bucket").alias("bucket"), F.shuffle(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), seed).alias("rows")
    )
    slots = rows.join(small(base), "bucket").select("shard", "first_slot", F.posexplode("rows").alias("at", "row"))
    placed = slots.select("row.doc_id", "row.text", (F.col("first_slot") + F.col("at")).cast("long").alias("slot"), "shard")
    placed.sortWithinPartitions("shard", "slot").write.mode("append").partitionBy("shard").option("compression", "zstd").parquet(path)


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS, bucket_bytes: int | None = None, seed: int = SEED) -> None:
    """Writes (doc_id, text, slot) of ``documents`` into folders shard=0, 1, ... under ``path``.

    Slots count from 0 in each shard. doc_id and the number of shards decide a row's shard; rows
    that share a doc_id, or have none, share a shard, and of very many equal ones each goes to a
    bucket of its own draw. Null texts stay null, and other columns are left out; an empty table
    writes no shard. ``bucket_bytes``: by default what the session's executors can hold.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.sum(row_size())).first()[0] or 0
    per_shard = max(1, math.ceil(total / shards / (bucket_bytes or bucket_size(spark))))
    within = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text", "copy"), F.lit(per_shard)).cast("int")
    dealt = numbered_copies(rows).select((shard_of("doc_id", shards, seed) * per_shard + within).cast("int").alias("bucket"), "doc_id", "text")
    counts = dealt.groupBy("bucket").agg(F.count("*").alias("n"))
    shard = F.floor(F.col("bucket") / per_shard).cast("int")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    buckets = shards * per_shard
    groups = math.ceil(buckets / BUCKETS_AT_ONCE)
    width = math.ceil(buckets / groups)
    with Scratch() as scratch:
        base = scratch.written(counts.withColumn("shard", shard).select("bucket", "shard", before.alias("first_slot")))
        if groups == 1:
            _write_buckets(dealt, buckets, 0, base, path, seed)
            return
        staged = scratch.written(dealt.withColumn("group", F.floor(F.col("bucket") / width).cast("int")), partition_by="group")
        for group in range(groups):
            of_group = F.col("bucket").between(group * width, (group + 1) * width - 1)
            _write_buckets(staged.where(F.col("group") == group).drop("group"), width, group * width, base.where(of_group), path, seed)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, slot, shard) of what ``write_shards`` wrote."""
    return spark.read.schema("doc_id long, text string, slot long, shard int").parquet(path)
