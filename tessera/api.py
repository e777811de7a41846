"""The engine's public names in one place."""

from tessera.functions.text import token_list as tokenize
from tessera.functions.text import tokens
from tessera.operators.bm25 import Bm25Index, search_batch, search_corpus
from tessera.operators.chunking import chunk_plan, chunks, mean_pooled
from tessera.operators.fusion import fuse, top_k_hybrid, top_k_hybrid_batch
from tessera.operators.preview import preview_lines
from tessera.operators.snapshots import added, changed, kept, new_or_changed, removed, same, upsert
from tessera.operators.vectors import top_k, top_k_batch, with_norms
from tessera.session import local_session
from tessera.sources.embedders import Embedder, HashingEmbedder, OnnxEmbedder, embed, with_embeddings
from tessera.sources.files import extract, extract_text, list_files, read_files
from tessera.sources.store import NotASnapshot, Snapshot, SnapshotStore, UnknownFormat
from tessera.streaming.live import LiveIndex

__all__ = [
    "Bm25Index", "Embedder", "HashingEmbedder", "LiveIndex", "NotASnapshot", "OnnxEmbedder", "Snapshot", "SnapshotStore",
    "UnknownFormat", "added", "changed", "chunk_plan", "chunks", "embed", "extract", "extract_text", "fuse", "kept",
    "list_files", "local_session", "mean_pooled", "new_or_changed", "preview_lines", "read_files", "removed", "same",
    "search_batch", "search_corpus", "tokenize", "tokens", "top_k", "top_k_batch", "top_k_hybrid", "top_k_hybrid_batch",
    "upsert", "with_embeddings", "with_norms",
]
