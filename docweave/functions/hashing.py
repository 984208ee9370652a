"""Fingerprints and deterministic ids (F1, F2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column | str) -> Column:
    """SHA-256 of the bytes as lowercase hex; a document whose digest is the recorded one is not processed again."""
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def parent_key(doc_id: Column | str) -> Column:
    """sha1 hex of the document id; also the state row id."""
    return F.sha1(F.col(doc_id) if isinstance(doc_id, str) else doc_id)


state_id = parent_key


def chunk_id(doc_id: Column | str, chunk_index: Column | str) -> Column:
    """``<sha1(doc_id)>-<i>``: stable across runs, so re-ingesting overwrites in place."""
    idx = F.col(chunk_index) if isinstance(chunk_index, str) else chunk_index
    return F.concat_ws("-", parent_key(doc_id), idx.cast("string"))


def chunk_id_range(doc_id: Column | str, n_chunks: Column | str) -> Column:
    """The array of chunk ids ``0..n-1`` of one document."""
    n = F.col(n_chunks) if isinstance(n_chunks, str) else n_chunks
    key = parent_key(doc_id)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat_ws("-", key, i.cast("string")))) \
        .otherwise(F.array().cast("array<string>"))
