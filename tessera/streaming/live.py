"""A directory kept searchable: a trigger each second, snapshot differences, one version pointer."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import fusion, snapshots, vectors
from tessera.scratch import remove, written_at
from tessera.sources.embedders import Embedder, embed, with_embeddings
from tessera.sources.files import extract, list_files, read_files
from tessera.sources.store import Snapshot, SnapshotStore

log = logging.getLogger(__name__)

#: Seconds between scans, and files between reports of progress.
INTERVAL_S = 1
PROGRESS_EVERY = 10


class LiveIndex:
    """Searches a directory's newest published version while a streaming query refreshes it.

    File streams don't see changed and deleted files; so each micro-batch of a clock lists the
    directory, compares content hashes with the published records, extracts and embeds only what
    is new or changed, and publishes all tables as one version.
    """

    def __init__(self, spark: SparkSession, folder: str, store: str, embedder: Embedder, on_progress: Callable[[str], None] = log.info) -> None:
        self.spark, self.folder, self.embedder, self.on_progress = spark, folder, embedder, on_progress
        self.store = SnapshotStore(spark, store)
        self.query: StreamingQuery | None = None
        if self.store.current() is None:
            found = list_files(spark, folder)
            records, path = self._made(read_files(found), found.count())
            self._publish(records)
            remove(spark, path)

    def _publish(self, records: DataFrame) -> None:
        self.store.publish(records)

    def _made(self, files: DataFrame, n: int) -> tuple[DataFrame, str]:
        """The records of ``n`` files, written once. Each tenth of them and the last are reported
        as tasks complete."""
        done = self.spark.sparkContext.accumulator(0)
        stop = threading.Event()
        said = 0

        def report(final: bool = False) -> None:
            nonlocal said
            count = n if final else min(int(done.value), n)
            for i in range(said + 1, count + 1):
                if i % PROGRESS_EVERY == 0 or i == n:
                    self.on_progress(f"Indexing {i}/{n}")
            said = max(said, count)

        def watch() -> None:
            while not stop.wait(0.05):
                report()

        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            made = written_at(with_embeddings(extract(files), self.embedder, done))
        finally:
            stop.set()
            watcher.join()
        report(final=True)
        return made

    def snapshot(self) -> Snapshot:
        found = self.store.current()
        assert found is not None  # published at the start
        return found

    def refresh(self) -> bool:
        """One tick; whether a new version was published. Files that can't be read count as gone.

        The directory's hashes are taken once, into a table; then only new and changed files are
        read again. A file that changes in between gets the hash of what its text was taken from.
        """
        listing = list_files(self.spark, self.folder)
        disk, scanned = written_at(read_files(listing, tolerant=True).select("path", "mtime", F.sha2("content", 256).alias("hash")))
        try:
            records = self.snapshot().records
            if snapshots.same(disk.select("path", "hash"), records):
                return False
            wanted = snapshots.new_or_changed(disk, records).select("path", "mtime")
            fresh, made = self._made(read_files(wanted, tolerant=True), wanted.count())
            self._publish(snapshots.upsert(disk, records, fresh))
            remove(self.spark, made)
            return True
        finally:
            remove(self.spark, scanned)

    def start(self, checkpoint: str, interval_s: float = INTERVAL_S) -> StreamingQuery:
        def tick(_: DataFrame, batch: int) -> None:
            try:
                if self.refresh():
                    log.info("batch %d published %s", batch, self.snapshot().path)
            except (OSError, PySparkException, Py4JError) as e:  # such as a directory that can't be listed, or a lost task; the next tick tries again
                log.warning("batch %d passed over: %s", batch, e)

        clock = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        writer = clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
        self.query = writer.trigger(processingTime=f"{interval_s} seconds").start()
        return self.query

    def stop(self) -> None:
        if self.query:
            self.query.stop()

    def search(self, query_vec: Sequence[float], k: int) -> DataFrame:
        """(doc_id, score) by cosine; doc_id is the path."""
        return vectors.top_k(self.snapshot().vectors, query_vec, k)

    def search_hybrid(self, query: str, k: int = 10) -> DataFrame:
        """(doc_id, score) by fused ranks, both lists from one version."""
        now = self.snapshot()
        query_vec = [float(x) for x in embed(self.embedder, query)]
        corpus = now.vectors.join(now.records.select(F.col("path").alias("doc_id"), "text"), "doc_id")
        return fusion.top_k_hybrid(corpus, query, query_vec, k, now.index)
