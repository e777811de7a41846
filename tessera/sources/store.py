"""Versioned snapshots of records, vectors and the lexical index, behind one pointer.

A version is a folder that is never changed. Readers resolve the pointer once for each query, so
that texts, vectors and postings they see belong together; a failed build leaves the pointer.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.bm25 import Bm25Index
from tessera.operators.vectors import with_norms

MAGIC = "tessera-snapshot"
FORMAT = 1
RECORDS = "path string, mtime timestamp, hash string, text string, error string, embedding array<float>"


class NotASnapshot(ValueError):
    """The folder's manifest is missing or is another program's."""


class UnknownFormat(ValueError):
    """The manifest's format is not this one."""


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _read_text(spark: SparkSession, path: str) -> str | None:
    files, at = _file_system(spark, path)
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside, then renamed over the old file in one step."""
    files, at = _file_system(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = files.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = rename
    context.rename(beside, at, options)


@dataclass
class Snapshot:
    """One opened version."""

    spark: SparkSession
    path: str
    dimension: int
    size: int

    @property
    def records(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/records")

    @property
    def vectors(self) -> DataFrame:
        """(doc_id, embedding, norm); doc_id is the path."""
        return self.spark.read.parquet(f"{self.path}/vectors")

    @property
    def index(self) -> Bm25Index:
        return Bm25Index.load(self.spark, f"{self.path}/index")

    def vector(self, path: str) -> list[float] | None:
        row = self.vectors.where(F.col("doc_id") == path).select("embedding").first()
        return row and list(row[0])

    def __len__(self) -> int:
        return self.size


@dataclass
class SnapshotStore:
    """``kept``: how many of the newest versions stay. Readers of an older one, such as a query
    that runs longer than it takes to publish as many, lose their files."""

    spark: SparkSession
    root: str
    kept: int = 3

    def publish(self, records: DataFrame) -> Snapshot:
        """Writes ``RECORDS`` and what is derived from them, then moves the pointer to them."""
        version = f"{self.root}/v-{uuid.uuid4().hex}"
        records.select(*(F.col(n) for n in ("path", "mtime", "hash", "text", "error", "embedding"))).write.parquet(f"{version}/records")
        written = self.spark.read.parquet(f"{version}/records")
        with_norms(written.select(F.col("path").alias("doc_id"), "embedding")).write.parquet(f"{version}/vectors")
        Bm25Index.build(written.select(F.col("path").alias("doc_id"), "text")).save(f"{version}/index")
        first = written.select(F.size("embedding").alias("n")).first()
        manifest = {"magic": MAGIC, "format": FORMAT, "dimension": first["n"] if first else 0, "size": written.count()}
        _write_text(self.spark, f"{version}/manifest.json", json.dumps(manifest))
        _write_text(self.spark, f"{self.root}/current", version)
        self._forget()
        return self.open(version)

    def _forget(self) -> None:
        """Removes the versions that were completed before the newest ``kept``; those without a
        manifest may be in the making and stay."""
        files, at = _file_system(self.spark, self.root)
        manifest = lambda folder: self.spark._jvm.org.apache.hadoop.fs.Path(folder, "manifest.json")
        folders = [x.getPath() for x in files.listStatus(at) if x.getPath().getName().startswith("v-")]
        complete = [(files.getFileStatus(m).getModificationTime(), str(f.getName()), f) for f in folders if files.exists(m := manifest(f))]
        now = (_read_text(self.spark, f"{self.root}/current") or "").strip().rsplit("/", 1)[-1]
        for _, name, folder in sorted(complete, key=lambda x: x[:2])[: -self.kept]:
            if name != now:
                files.delete(folder, True)

    def open(self, version: str) -> Snapshot:
        text = _read_text(self.spark, f"{version}/manifest.json")
        try:
            manifest = json.loads(text or "")
        except ValueError:
            manifest = {}
        if not isinstance(manifest, dict) or manifest.get("magic") != MAGIC:
            raise NotASnapshot(version)
        if manifest.get("format") != FORMAT:
            raise UnknownFormat(f"{version}: format {manifest.get('format')}")
        return Snapshot(self.spark, version, manifest["dimension"], manifest["size"])

    def current(self) -> Snapshot | None:
        version = _read_text(self.spark, f"{self.root}/current")
        return self.open(version.strip()) if version else None
