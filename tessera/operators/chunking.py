"""Token windows of long texts, and pooling of their vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scores import l2_normalized

#: Tokens of a window and between the starts of windows.
WIDTH = 254
HOP = 50


def _starts(n_tokens: Column, width: int, hop: int) -> Column:
    last = F.lit(hop) * F.greatest(F.lit(0), F.ceil((n_tokens - width) / F.lit(hop))).cast("int")
    return F.sequence(F.lit(0), last, F.lit(hop))


def chunk_plan(lengths: DataFrame, width: int = WIDTH, hop: int = HOP) -> DataFrame:
    """(doc_id, chunk, pos, end) for each row of ``lengths`` (doc_id, n_tokens), repeated ids
    included; the last window ends at the text's end, and a text of at most ``width`` tokens is
    one window."""
    starts = lengths.select("doc_id", "n_tokens", F.posexplode(_starts(F.col("n_tokens"), width, hop)).alias("chunk", "pos"))
    return starts.select("doc_id", "chunk", "pos", F.least(F.col("pos") + width, F.col("n_tokens")).cast("int").alias("end"))


def chunks(documents: DataFrame, width: int = WIDTH, hop: int = HOP) -> DataFrame:
    """(doc_id, chunk, pos, end, tokens) of each row of ``documents`` (doc_id, tokens).

    The windows are cut in the row that holds the tokens, so repeated ids don't mix. Null tokens
    count as none: one empty window.
    """
    rows = documents.select("doc_id", F.coalesce("tokens", F.array().cast(documents.schema["tokens"].dataType)).alias("tokens"))
    n = F.size("tokens")
    window = lambda pos: F.struct(pos.alias("pos"), F.least(pos + width, n).cast("int").alias("end"), F.slice("tokens", pos + 1, F.lit(width)).alias("tokens"))
    each = rows.select("doc_id", F.posexplode(F.transform(_starts(n, width, hop), window)).alias("chunk", "window"))
    return each.select("doc_id", "chunk", "window.*")


def mean_pooled(vectors: DataFrame, by: str) -> DataFrame:
    """(by, embedding): the element-wise mean of each group's vectors, scaled to length 1."""
    each = vectors.select(by, F.posexplode("embedding").alias("pos", "value"))
    means = each.groupBy(by, "pos").agg(F.avg(F.col("value").cast("double")).alias("value"))
    rows = means.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("all"))  # one entry for each dimension
    return rows.select(by, l2_normalized(F.transform("all", lambda x: x["value"])).alias("embedding"))
