"""python -m tessera FOLDER STORE QUERY [K]: index a folder, keep it current, answer a query.
python -m tessera --demo: a small directory is created, changed and searched."""

from __future__ import annotations

import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

from tessera.functions.scores import formatted, status_line
from tessera.session import local_session
from tessera.sources.embedders import HashingEmbedder
from tessera.streaming.live import LiveIndex

#: Fixed value: results that a query shows.
SHOWN = 10


def show(live: LiveIndex, query: str, k: int = SHOWN) -> None:
    began = time.perf_counter()
    hits = live.search_hybrid(query, k).collect()
    print(status_line(len(hits), time.perf_counter() - began))
    if hits:
        rows = live.spark.createDataFrame([(i + 1, h.doc_id, h.score) for i, h in enumerate(hits)], "rank int, path string, score double")
        for line in rows.orderBy("rank").select(formatted(F.col("rank"), F.col("score"), F.col("path"))).collect():
            print(line[0])


def demo() -> None:
    spark = local_session(partitions=4)
    spark.sparkContext.setLogLevel("ERROR")
    with tempfile.TemporaryDirectory() as top:
        folder = os.path.join(top, "data")
        os.makedirs(folder)
        live = LiveIndex(spark, folder, os.path.join(top, "store"), HashingEmbedder(), on_progress=print)
        for name, text in (("a.txt", "hello world"), ("a.txt", "pizza è la migliore 🍕"), ("b.txt", ""), ("c.txt", "the quick brown fox")):
            with open(os.path.join(folder, name), "w", encoding="utf-8") as file:
                file.write(text)
            live.refresh()
            show(live, "pizza fox hello")
    spark.stop()


def main(args: list[str]) -> int:
    if args[:1] == ["--demo"]:
        demo()
        return 0
    if len(args) < 3:
        print(__doc__)
        return 2
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    live = LiveIndex(spark, args[0], args[1], HashingEmbedder(), on_progress=print)
    live.refresh()
    show(live, args[2], int(args[3]) if len(args) > 3 else SHOWN)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
