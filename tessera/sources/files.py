"""Files of a directory as rows: listing rules, reading and text extraction."""

from __future__ import annotations

import os
import re
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import EXTENSIONS

#: Names that are passed over, files and whole directories alike.
HIDDEN_PREFIX = "."
PASSING_SUFFIXES = (".tmp", ".swp")

LISTED = "path string, mtime timestamp"
FILES = "path string, mtime timestamp, content binary"
EXTRACTED = "path string, mtime timestamp, hash string, text string, error string"


def is_skipped(name: str) -> bool:
    return name.startswith(HIDDEN_PREFIX) or name.endswith(PASSING_SUFFIXES)


def listed(root: str) -> list[tuple[str, datetime]]:
    """(path, mtime) of the files below ``root`` whose extension is known, case counting; nothing
    if ``root`` is no directory. A directory that can't be read raises."""
    found: list[tuple[str, datetime]] = []
    pending = [root] if os.path.isdir(root) else []
    while pending:
        with os.scandir(pending.pop()) as entries:
            for entry in entries:
                if is_skipped(entry.name):
                    continue
                if entry.is_dir():
                    pending.append(entry.path)
                elif os.path.splitext(entry.name)[1][1:] in EXTENSIONS:
                    found.append((entry.path, datetime.fromtimestamp(entry.stat().st_mtime, timezone.utc)))
    return sorted(found)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``LISTED`` of a directory that driver and executors share. Spark's own file source would
    drop empty files and '_' names, and read what lies in skipped directories."""
    return spark.createDataFrame(listed(root), LISTED)


#: Bytes of files that a task hands over at once.
READ_BYTES = 8_000_000


def read_files(paths: DataFrame, tolerant: bool = False) -> DataFrame:
    """``FILES`` for ``paths``; an unreadable file raises or, with ``tolerant``, is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for path, mtime in zip(batch["path"], batch["mtime"], strict=True):
                try:
                    with open(path, "rb") as file:
                        content = file.read()
                except OSError:
                    if not tolerant:
                        raise
                    continue
                held.append((path, mtime, content))
                size += len(content)
                if size >= READ_BYTES:
                    yield pd.DataFrame(held, columns=["path", "mtime", "content"])
                    held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["path", "mtime", "content"])

    return paths.select("path", "mtime").repartition("path").mapInPandas(run, FILES)


class ExtractionError(ValueError):
    """A file's text can't be had."""


def text_of_plain(content: bytes) -> str:
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError as e:
        raise ExtractionError("not UTF-8") from e


def text_of_docx(content: bytes) -> str:
    """The main part's text without tags, entities as they stand, paragraphs run together."""
    try:
        with zipfile.ZipFile(BytesIO(content)) as archive:
            markup = archive.read("word/document.xml").decode("utf-8")
    except (zipfile.BadZipFile, KeyError, UnicodeDecodeError) as e:
        raise ExtractionError(f"no readable word/document.xml: {e}") from e
    return re.sub(r"<[^>]*>?|>", "", markup)


_STREAM = re.compile(rb"(<<(?:[^<>]|<[^<]|>[^>]|<<[^<>]*>>)*>>)\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^()\\])*\)\s*(?:Tj|'|\")|\[(?:\((?:\\.|[^()\\])*\)|[^\]()])*\]\s*TJ|T\*|ET", re.S)
_LITERAL = re.compile(rb"\(((?:\\.|[^()\\])*)\)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _unescaped(literal: bytes) -> bytes:
    def one(m: re.Match[bytes]) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|.)", one, literal, flags=re.S)


def text_of_pdf(content: bytes) -> str:
    """Text of simple PDFs: literal strings shown by plain or Flate streams in single-byte fonts.

    A subset: encrypted files, object streams and fonts with their own codes give what their
    streams show as bytes, or nothing.
    """
    if not content.lstrip().startswith(b"%PDF"):
        raise ExtractionError("no PDF header")
    out = []
    for head, body in _STREAM.findall(content):
        if b"FlateDecode" in head:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        for shown in _SHOWN.findall(body):
            if shown in (b"T*", b"ET"):
                out.append("\n")
            else:
                out.append(b"".join(map(_unescaped, _LITERAL.findall(shown))).decode("latin-1"))
    return "".join(out)


def extract_text(path: str, content: bytes) -> str:
    kind = os.path.splitext(path)[1][1:]
    return {"pdf": text_of_pdf, "docx": text_of_docx}.get(kind, text_of_plain)(content)


def extract(files: DataFrame) -> DataFrame:
    """``EXTRACTED`` for ``files``: text trimmed of Unicode white space, empty with an ``error``
    where it can't be had; every file keeps its row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    texts.append(extract_text(path, content).strip())
                    errors.append(None)
                except ExtractionError as e:
                    texts.append("")
                    errors.append(str(e))
            yield batch[["path", "mtime", "hash"]].assign(text=texts, error=errors)

    return files.withColumn("hash", F.sha2("content", 256)).mapInPandas(run, EXTRACTED)
