"""Previews of a text with the lines that hold a query's words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
MOST_LINES = 500
LINE_BYTES = 80
UNREADABLE = "[error reading file]"


def matches(line: Column, query: str) -> Column:
    """Whether the lower-cased line contains a word of the lower-cased query; words are what
    stands between white space, and a query of one byte matches nothing."""
    if len(query.encode()) <= 1:
        return F.lit(False)
    words = query.lower().split()
    if not words:
        return F.lit(False)
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(line), w))


def preview_lines(documents: DataFrame, query: str, most: int = MOST_LINES) -> DataFrame:
    """(doc_id, line_no, line, matches): the first ``most`` lines of each text, 1-based."""
    lines = F.slice(F.split(F.coalesce(F.col("text"), F.lit(UNREADABLE)), "\n"), 1, most)
    each = documents.select("doc_id", F.posexplode(lines).alias("at", "line"))
    return each.select("doc_id", (F.col("at") + 1).alias("line_no"), "line", matches(F.col("line"), query).alias("matches"))


def is_cut(text: Column, most: int = MOST_LINES) -> Column:
    """Whether the preview says that there is more than it shows."""
    return F.octet_length(text) > most * LINE_BYTES
