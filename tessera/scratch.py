"""Intermediate tables in the cluster's shared folder, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}

#: Rows, and bytes as the planner estimates them, that a broadcast may hold; beyond either the
#: join is shuffled.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 24_000_000


#: Files of a table of short rows, for each core.
FILES_A_CORE = 4


class NoSharedFolder(RuntimeError):
    """A cluster's session names no folder that the driver and all executors see."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where there is one
    machine and the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise NoSharedFolder(f"set spark.checkpoint.dir to a folder that all of {master} sees")
    return _own_folder.setdefault("path", "file://" + tempfile.mkdtemp(prefix="tessera-"))


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def written_at(df: DataFrame, compression: str = "snappy", partition_by: str | None = None) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_path(spark)
    writer = df.write.option("compression", compression)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts lineage, survives the loss of
    executors, and gives the planner real sizes."""
    return written_at(df)[0]


def in_few_files(df: DataFrame) -> DataFrame:
    """``df``, the end of a shuffle of rows of a few numbers, for a table of a few files a core.

    Without Hadoop's native library each file that is written starts several processes (chmod),
    which share the executor's memory until they run.
    """
    return df.coalesce(FILES_A_CORE * df.sparkSession.sparkContext.defaultParallelism)


class Scratch:
    """Tables that are written on the way to a result and removed with the ``with`` block. The
    result itself is written by ``written`` and stays."""

    def __init__(self) -> None:
        self._paths: list[tuple[SparkSession, str]] = []

    def written(self, df: DataFrame, compression: str = "snappy", partition_by: str | None = None) -> DataFrame:
        out, path = written_at(df, compression, partition_by)
        self._paths.append((df.sparkSession, path))
        return out

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        while self._paths:
            remove(*self._paths.pop())


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a written table, with a broadcast hint if it has few rows in small files; otherwise
    as it is, so that the join is shuffled."""
    on_disk = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if on_disk <= size and df.count() <= rows else df
