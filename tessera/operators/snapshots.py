"""Differences between snapshots (path, hash) and the records they describe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def added(disk: DataFrame, records: DataFrame) -> DataFrame:
    return disk.join(records.select("path"), "path", "left_anti")


def removed(disk: DataFrame, records: DataFrame) -> DataFrame:
    return records.join(disk.select("path"), "path", "left_anti")


def kept(disk: DataFrame, records: DataFrame) -> DataFrame:
    """Records whose file is still there, changed or not."""
    return records.join(disk.select("path"), "path", "left_semi")


def new_or_changed(disk: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of ``disk`` without a record of that path and hash."""
    old = records.select("path", F.col("hash").alias("_old_hash"))
    return disk.join(old, "path", "left").where("_old_hash is null or _old_hash != hash").drop("_old_hash")


def changed(disk: DataFrame, records: DataFrame) -> DataFrame:
    old = records.select("path", F.col("hash").alias("_old_hash"))
    return disk.join(old, "path").where("not (_old_hash <=> hash)").drop("_old_hash")


def same(disk: DataFrame, records: DataFrame) -> bool:
    """Whether both name the same paths with the same hashes."""
    a = disk.select("path", F.col("hash").alias("h1"), F.lit(True).alias("in1"))
    b = records.select("path", F.col("hash").alias("h2"), F.lit(True).alias("in2"))
    return a.join(b, "path", "full_outer").where("in1 is null or in2 is null or not (h1 <=> h2)").isEmpty()


def upsert(disk: DataFrame, records: DataFrame, fresh: DataFrame) -> DataFrame:
    """Records after a change: those that stay as they are, and ``fresh`` for new or changed paths."""
    unchanged = kept(disk, records).join(fresh.select("path"), "path", "left_anti")
    return reduce(DataFrame.unionByName, [unchanged, fresh])
