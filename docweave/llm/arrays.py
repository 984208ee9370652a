"""numpy helpers over Arrow text columns, used inside Spark tasks.

A word is a run of bytes other than the six ASCII white-space bytes, so the words of a
UTF-8 text can be found on its bytes. All helpers take whole columns; ``slices`` cuts a
batch into row ranges of bounded bytes so that the working arrays stay small whatever the
batch holds (a single longer text forms a range of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column with nulls as empty strings and 64-bit offsets."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col.cast(pa.large_string()), "")


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (rebased to 0) of a large_string column without nulls."""
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + n + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[lo:hi] if raw is not None and hi > lo else np.zeros(0, np.uint8)
    return data, offsets - lo


def slices(col: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``max_bytes`` of text (one row at least)."""
    _, offsets = utf8(col)
    lo, n = 0, len(col)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and per row the number of words before it (n+1 long)."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)  # a row starts here
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as one binary column (bytes are gathered, spans must ascend without overlap)."""
    lengths = ends - starts
    out = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    index = np.repeat(starts - out[:-1], lengths) + np.arange(out[-1])
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(out), pa.py_buffer(np.ascontiguousarray(data[index]))])


def dictionary(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Exact ids of equal values, and the distinct values."""
    if len(values) == 0:
        return np.zeros(0, np.int64), values
    enc = pc.dictionary_encode(values)
    return enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), enc.dictionary


def code_points(data: np.ndarray) -> np.ndarray:
    """1 for each byte that starts a code point."""
    return (data & 0xC0) != 0x80


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finalizer: spreads small ids over 64 bits."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))
