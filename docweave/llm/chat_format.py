"""Chat formatting by columnar byte assembly (operator 1).

A turn is written as ``<|im_start|>ROLE\n`` TEXT ``<|im_end|>\n``. Control strings inside a
role or text get one backslash after their first character (and one more where such
backslashes stand already), which is undone exactly on reading.

A batch of sorted turns is assembled at once: segment lengths per turn, cumulative offsets,
scatter indices in numpy, headers and contents copied into one preallocated buffer that
becomes the Arrow column. A conversation is written as fragments of bounded size, so a
conversation with a third of all rows is formatted by many tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.arrays import code_points, slices, text_column, utf8
from docweave.llm.storage import staged, tasks

HEAD, MID, TAIL = b"<|im_start|>", b"\n", b"<|im_end|>\n"
# control strings that a text may not contain as they are
_ANGLE = r"\|im_start\|>|\|im_end\|>|/?s>"
_SQUARE = r"/?INST\]"
_TURN = re.compile(re.escape(HEAD) + rb"([^\n]*)\n(.*?)" + re.escape(TAIL), re.S)
_UNANGLE = re.compile(rf"(<\\*)\\({_ANGLE})")
_UNSQUARE = re.compile(rf"(\[\\*)\\({_SQUARE})")


def escaped(col: pa.Array) -> pa.Array:
    """Control strings of a string column made harmless."""
    col = pc.replace_substring_regex(col, rf"(<\\*)({_ANGLE})", r"\1\\\2")
    return pc.replace_substring_regex(col, rf"(\[\\*)({_SQUARE})", r"\1\\\2")


def unescaped(text: str) -> str:
    return _UNSQUARE.sub(r"\1\2", _UNANGLE.sub(r"\1\2", text))


def escaped_role(col: pa.Array) -> pa.Array:
    """A role has to stay on its line: backslashes and line breaks are written as backslash sequences first."""
    col = pc.replace_substring(pc.replace_substring(col, "\\", "\\\\"), "\n", "\\n")
    return escaped(col)


def unescaped_role(text: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescaped(text))


def _place(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy row i of (data, offsets) to out[at[i]:]."""
    lengths = np.diff(offsets)
    out[np.repeat(at - offsets[:-1], lengths) + np.arange(len(data))] = data


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, turn offsets (n+1), start and length of each turn's escaped text in the buffer)."""
    r, r_off = utf8(escaped_role(role))
    t, t_off = utf8(escaped(text))
    r_len, t_len = np.diff(r_off), np.diff(t_off)
    turns = np.zeros(len(role) + 1, np.int64)
    np.cumsum(len(HEAD) + r_len + len(MID) + t_len + len(TAIL), out=turns[1:])
    out = np.empty(turns[-1], np.uint8)
    for constant, at in ((HEAD, turns[:-1]), (MID, turns[:-1] + len(HEAD) + r_len), (TAIL, turns[1:] - len(TAIL))):
        out[at[:, None] + np.arange(len(constant))] = np.frombuffer(constant, np.uint8)
    text_at = turns[:-1] + len(HEAD) + r_len + len(MID)
    _place(out, turns[:-1] + len(HEAD), r, r_off)
    _place(out, text_at, t, t_off)
    return out, turns, text_at, t_len


_FRAGMENT = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("n_turns", pa.int64()),
    ("formatted", pa.large_string()), ("loss_start", pa.list_(pa.int64())), ("loss_length", pa.list_(pa.int64()))])


def _fragments(batch: pa.RecordBatch, seq: int, loss_role: str, fragment_bytes: int) -> pa.RecordBatch:
    """Consecutive turns of one conversation joined, up to ``fragment_bytes`` (one turn at least)."""
    role, text = text_column(batch, "role"), text_column(batch, "text")
    out, turns, text_at, text_len = assemble(role, text)
    conv = batch.column(batch.schema.get_field_index("conv_id"))
    missing = conv.is_null().to_numpy(zero_copy_only=False)
    key = pc.fill_null(conv, 0).to_numpy(zero_copy_only=False)
    n = batch.num_rows
    begins = np.concatenate([[True], (key[1:] != key[:-1]) | (missing[1:] != missing[:-1])])
    block = turns[:-1] // fragment_bytes
    begins[1:] |= block[1:] != block[:-1]
    first = np.flatnonzero(begins)
    last = np.append(first[1:], n)
    bounds = np.append(turns[first], turns[-1])
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.ascontiguousarray(bounds)), pa.py_buffer(out))
    masked = pc.equal(role, loss_role).to_numpy(zero_copy_only=False)
    masked_before = np.concatenate([[0], np.cumsum(masked)])
    loss_offsets = pa.array(np.append(masked_before[first], masked_before[-1]).astype(np.int32))
    inside = (text_at - np.repeat(turns[first], last - first))[masked]
    return pa.RecordBatch.from_arrays([
        conv.take(pa.array(first)), batch.column(batch.schema.get_field_index("part")).take(pa.array(first)),
        pa.array(seq + np.arange(len(first))), pa.array(last - first), formatted,
        pa.ListArray.from_arrays(loss_offsets, pa.array(inside)),
        pa.ListArray.from_arrays(loss_offsets, pa.array(text_len[masked]))], schema=_FRAGMENT)


def format_conversations(turns: DataFrame, loss_role: str = "assistant", fragment_bytes: int = 1 << 20) -> DataFrame:
    """Formatted fragments: (conv_id, part, seq, n_turns, formatted, loss_start, loss_length).

    A conversation is its fragments in order of (part, seq), put end to end. Turns go by
    turn (null first), then role, then a hash of the text. ``loss_start`` and
    ``loss_length`` give, in bytes of the fragment, the (escaped) texts under the loss mask:
    those of ``loss_role``. A null text or role is written as empty; a null conv_id is a
    conversation of its own; repeated rows are turns like any other; no rows give none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            for lo, hi in slices(text_column(batch, "text")):
                out = _fragments(batch.slice(lo, hi - lo), seq, loss_role, fragment_bytes)
                seq += out.num_rows
                yield out

    n = tasks(turns.sparkSession)
    slim = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text",
                        F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "role", "tie", "row"]
    ordered = slim.repartitionByRange(n, *order).sortWithinPartitions(*order).select(
        "conv_id", "role", "text", F.spark_partition_id().cast("long").alias("part"))
    schema = "conv_id long, part long, seq long, n_turns long, formatted string, loss_start array<long>, loss_length array<long>"
    return ordered.mapInArrow(run, schema)


class _Digest:
    """What reading a conversation back yields, fragment by fragment, in constant memory."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: bytes, starts, lengths) -> None:
        for m in _TURN.finditer(formatted):
            self.n += 1
            role, text = unescaped_role(m[1].decode()), unescaped(m[2].decode())
            self.turns.update(f"{role}\n{text}\n".encode())
        for a, k in zip(starts, lengths):
            text = unescaped(formatted[a:a + k].decode())
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.chars += int(code_points(np.frombuffer(formatted, np.uint8)).sum())

    def row(self, conv) -> dict:
        return {"conv_id": conv, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars,
                "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                         ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation; rows come sorted by conversation, part and seq."""
    current, digest = None, None
    for batch in batches:
        out = []
        cols = [batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "formatted", "loss_start", "loss_length")]
        for i in range(batch.num_rows):
            conv = cols[0][i].as_py()
            if digest is None or conv != current:
                if digest is not None:
                    out.append(digest.row(current))
                current, digest = conv, _Digest()
            digest.add(cols[1][i].as_py().encode(), cols[2][i].as_py(), cols[3][i].as_py())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_READ_ARROW)
    if digest is not None:
        yield pa.RecordBatch.from_pylist([digest.row(current)], schema=_READ_ARROW)


def read_back(fragments: DataFrame) -> DataFrame:
    """Per conversation, parsed from the formatted text alone and the loss spans: digests and counts.

    Conversations that lie in one fragment (all but the very long and those at the border
    of two tasks) are read where they are stored. The others' fragments are brought
    together by conversation and read in order, in constant memory: SHA-256 has to see a
    conversation's bytes in one sequence.
    """
    n = tasks(fragments.sparkSession)
    several = staged(fragments.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select(
        F.col("conv_id").alias("_c")), "several")
    one = fragments.join(several, F.col("conv_id").eqNullSafe(F.col("_c")), "left_anti").select(
        "conv_id", "formatted", "loss_start", "loss_length")
    more = fragments.join(several, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi").repartition(n, "conv_id") \
        .sortWithinPartitions("conv_id", "part", "seq").select("conv_id", "formatted", "loss_start", "loss_length")
    # in ``one`` every row is a conversation, so any order of rows will do
    return one.mapInArrow(_digests, _READ).union(more.mapInArrow(_digests, _READ))
