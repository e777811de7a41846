"""Text embedding: a protocol, a hashing embedder for tests and an ONNX one, run by the batch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType

from tessera.functions.text import token_list
from tessera.operators.chunking import HOP, WIDTH

#: Fixed value: texts of more UTF-8 bytes are embedded window by window.
MOST_BYTES = 10_000
DIMENSION = 384


class Embedder(Protocol):
    dimension: int

    def tokenize(self, text: str) -> list[int]: ...

    def embed_windows(self, rows: list[list[int]]) -> np.ndarray:
        """The vectors of some windows of ids, each of length 1."""
        ...


def windows(n: int, width: int = WIDTH, hop: int = HOP) -> list[tuple[int, int]]:
    out, start = [], 0
    while True:
        end = min(start + width, n)
        out.append((start, end))
        if end == n:
            return out
        start += hop


def normalized(v: np.ndarray) -> np.ndarray:
    size = float(np.linalg.norm(v))
    return v / size if size else v


def masked_mean(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of the rows of ``hidden`` whose mask is set."""
    return (hidden * mask[:, None]).sum(axis=0) / max(1, mask.sum())


def embed_all(embedder: Embedder, texts: list[str]) -> np.ndarray:
    """A vector for each text, all windows in one call of the embedder; zeros for a text without
    tokens or with nothing but white space."""
    out = np.zeros((len(texts), embedder.dimension))
    rows: list[list[int]] = []
    owners: list[int] = []
    for i, text in enumerate(texts):
        ids = embedder.tokenize(text) if text.strip() else []
        if ids:
            cuts = windows(len(ids)) if len(text.encode()) > MOST_BYTES else [(0, len(ids))]
            rows += [ids[a:b] for a, b in cuts]
            owners += [i] * len(cuts)
    if rows:
        of = np.array(owners)
        vectors = embedder.embed_windows(rows)
        for i in np.unique(of):
            mine = vectors[of == i]
            out[i] = mine[0] if len(mine) == 1 else normalized(mine.mean(axis=0))
    return out


def embed(embedder: Embedder, text: str) -> np.ndarray:
    return embed_all(embedder, [text])[0]


@dataclass
class HashingEmbedder:
    """Signed hashing of tokens: deterministic, without meaning beyond shared words."""

    dimension: int = DIMENSION

    def tokenize(self, text: str) -> list[int]:
        return [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=7).digest(), "little") for t in token_list(text)]

    def embed_windows(self, rows: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(rows), self.dimension))
        for v, ids in zip(out, rows, strict=True):
            of = np.array(ids, np.int64)
            np.add.at(v, of % self.dimension, np.where(of >> 50 & 1, 1.0, -1.0))
            v[:] = normalized(v)
        return out


def onnx_session(model_path: str):
    import onnxruntime

    return onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"])


@dataclass
class OnnxEmbedder:
    """A tokenizers file and an ONNX encoder: special ids around each window, masked mean, length 1.

    Loaded once in each Python worker. Windows of about one length go through the model together,
    filled up with ``pad_id`` that the mask leaves out. No model comes with the environment; tests
    put a session of their own in ``make_session``.
    """

    tokenizer_path: str
    model_path: str
    dimension: int = DIMENSION
    first_id: int = 101
    last_id: int = 102
    pad_id: int = 0
    windows_at_once: int = 32
    make_session: Callable[[str], Any] = onnx_session

    @property
    def max_tokens(self) -> int:
        """Ids of the longest window, special ones included."""
        return WIDTH + 2

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _loaded_tokenizer(self):
        if not hasattr(self, "_tokenizer"):
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.tokenizer_path)
        return self._tokenizer

    def tokenize(self, text: str) -> list[int]:
        return self._loaded_tokenizer().encode(text, add_special_tokens=False).ids

    def id_to_token(self, token_id: int) -> str | None:
        return self._loaded_tokenizer().id_to_token(token_id)

    def embed_windows(self, rows: list[list[int]]) -> np.ndarray:
        if not hasattr(self, "_session"):
            self._session = self.make_session(self.model_path)
        names = {x.name for x in self._session.get_inputs()}
        out = np.zeros((len(rows), self.dimension))
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        for at in range(0, len(order), self.windows_at_once):
            some = order[at : at + self.windows_at_once]
            ids = np.full((len(some), len(rows[some[-1]]) + 2), self.pad_id, np.int64)
            mask = np.zeros_like(ids)
            for line, i in enumerate(some):
                n = len(rows[i]) + 2
                ids[line, :n] = [self.first_id, *rows[i], self.last_id]
                mask[line, :n] = 1
            feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
            hidden = self._session.run(None, {k: v for k, v in feed.items() if k in names})[0]
            for line, i in enumerate(some):
                out[i] = normalized(masked_mean(hidden[line], mask[line]))
        return out


def with_embeddings(records: DataFrame, embedder: Embedder, done: Accumulator | None = None) -> DataFrame:
    """``records`` with an ``embedding`` of their ``text``; an error in embedding gives zeros and
    stands in ``error``, so that no row is lost. ``done`` counts the rows."""
    schema = records.drop("embedding").schema.add("embedding", ArrayType(FloatType()))
    has_error = "error" in records.columns

    def one(text: str) -> tuple[np.ndarray, str | None]:
        try:
            return embed(embedder, text), None
        except Exception as e:  # any model's failure; it is reported in the row
            return np.zeros(embedder.dimension), f"embedding: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [x or "" for x in batch["text"]]
            try:
                found = [(v, None) for v in embed_all(embedder, texts)]
            except Exception:  # some row's text; each for itself tells which
                found = [one(x) for x in texts]
            out = batch.assign(embedding=[v.astype(np.float32) for v, _ in found])
            if has_error:
                out["error"] = [new or old for (_, new), old in zip(found, batch["error"], strict=True)]
            if done is not None:
                done.add(len(batch))
            yield out

    return records.drop("embedding").mapInPandas(run, schema)
