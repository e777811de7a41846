"""Text expressions: tokens, trimming, tag stripping, path parts. All run in the JVM."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token characters, the bytes a token has at least, and the accepted extensions.
TOKEN_PATTERN = r"[\p{IsAlphabetic}\p{N}_-]+"
LEAST_TOKEN_BYTES = 2
EXTENSIONS = ("txt", "pdf", "docx", "doc")
HEAD_TOKENS = 16


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Runs of letters, digits, '-' and '_' of two UTF-8 bytes or more, lower-cased; repeats stay.

    Null counts as empty.
    """
    runs = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.transform(F.filter(runs, lambda t: F.octet_length(t) >= LEAST_TOKEN_BYTES), F.lower)


_runs = regex.compile(TOKEN_PATTERN.replace("IsAlphabetic", "Alphabetic")).findall


def token_list(text: str) -> list[str]:
    """``tokens`` of a query string, in plain Python, where no session is at hand."""
    return [run.lower() for run in _runs(text) if len(run.encode()) >= LEAST_TOKEN_BYTES]


def head(items: Column | str, most: int = HEAD_TOKENS) -> Column:
    """The first entries of an array."""
    return F.slice(_col(items), 1, most)


def unicode_trim(text: Column | str) -> Column:
    """Without Unicode white space at either end (``F.trim`` takes spaces alone)."""
    return F.regexp_replace(_col(text), r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def is_blank(text: Column | str) -> Column:
    return unicode_trim(F.coalesce(_col(text), F.lit(""))) == ""


def strip_tags(markup: Column | str) -> Column:
    """What stands outside of <...>; a lone '>' is dropped and an open '<' takes the rest."""
    return F.regexp_replace(_col(markup), r"<[^>]*>?|>", "")


def needs_chunks(text: Column | str, most_bytes: int = 10_000) -> Column:
    """Whether a text has more than ``most_bytes`` UTF-8 bytes."""
    return F.octet_length(_col(text)) > most_bytes


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def extension(path: Column | str) -> Column:
    """What follows the last dot of the file name; empty for none or for a leading dot alone."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def has_known_extension(path: Column | str) -> Column:
    return extension(path).isin(*EXTENSIONS)


def content_hash(content: Column | str) -> Column:
    return F.sha2(_col(content), 256)


def count_id(ids: Column | str, wanted: int = 100) -> Column:
    """How many of an array of token ids are ``wanted``, such as the unknown token."""
    return F.size(F.filter(_col(ids), lambda x: x == wanted))
