"""Connected components by alternating large-star and small-star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_few_files, remove, written_at


def _star(pairs: DataFrame, larger_only: bool) -> tuple[DataFrame, list[str]]:
    """Each node's neighbours in ``pairs`` (node, other) are tied to the least of them and it.

    The minima are written first, so that the join has plain exchanges on both sides: the planner
    broadcasts a small side and splits the partitions of a node with very many neighbours.
    """
    least, path = written_at(in_few_files(pairs.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))))
    tied = pairs.join(least, "node")
    if larger_only:
        tied = tied.where("other > node").select(F.col("other").alias("a"), F.col("least").alias("b"))
    else:
        tied = tied.select(F.explode(F.array("node", "other")).alias("a"), F.col("least").alias("b"))
    edges, out = written_at(in_few_files(tied.where("a != b").distinct()))
    remove(pairs.sparkSession, path)
    return edges, out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node long, root long) for every node of ``edges`` (a long, b long); root: the least node
    that can be reached. Self-loops and rows with nulls tie nothing. Only counts reach the driver.
    """
    spark = edges.sparkSession
    edges, path = written_at(
        in_few_files(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    )
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("x")).select("x.*")
        large, large_path = _star(both, larger_only=True)
        remove(spark, path)
        # every edge of the large star points from the larger node to the smaller one
        edges, path = _star(large.select(F.col("a").alias("node"), F.col("b").alias("other")), larger_only=False)
        remove(spark, large_path)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
