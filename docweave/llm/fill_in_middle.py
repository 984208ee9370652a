"""Fill-in-middle transformation by in-place block rotation (operator 13).

A text is cut at two code points into prefix, middle and suffix. The cuts are scanned in the
UTF-8 bytes, three sentinels are inserted into one bytearray, and neighbouring segments change
places by rotations of three reversals each, in place. Undoing the rotations and taking the
sentinels out again restores the text exactly. Everything is local to a row: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.arrays import code_points, slices, text_column, utf8

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_STEP = 1 << 16  # bytes looked at or moved at a time


def reverse(buf: bytearray, lo: int, hi: int) -> None:
    """Reverse ``buf[lo:hi]`` in place, from both ends inwards."""
    while hi - lo > 1:
        k = min(_STEP, (hi - lo) // 2)
        head, tail = buf[lo:lo + k], buf[hi - k:hi]
        head.reverse()
        tail.reverse()
        buf[lo:lo + k], buf[hi - k:hi] = tail, head
        lo, hi = lo + k, hi - k


def rotate(buf: bytearray, lo: int, mid: int, hi: int) -> None:
    """Exchange the neighbours ``buf[lo:mid]`` and ``buf[mid:hi]`` in place."""
    reverse(buf, lo, mid)
    reverse(buf, mid, hi)
    reverse(buf, lo, hi)


def byte_at(data: np.ndarray, point: int) -> int:
    """Byte offset of the code point number ``point`` of UTF-8 ``data`` (its length, if there are no more)."""
    passed = 0
    for lo in range(0, len(data), _STEP):
        starts = code_points(data[lo:lo + _STEP])
        count = int(np.count_nonzero(starts))
        if passed + count > point:
            return lo + int(np.flatnonzero(starts)[point - passed])
        passed += count
    return len(data)


def arranged(data: np.ndarray, prefix: int, middle: int, form: str) -> bytearray:
    """The output for a text whose first segments have ``prefix`` and ``middle`` code points."""
    buf = bytearray(data)
    if form == "plain":
        return buf
    first = byte_at(data, prefix)
    second = first + byte_at(data[first:], middle)
    for at, sentinel in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):  # from the right, so that cuts stay where they are
        buf[at:at] = sentinel
    first, second = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    if form == "psm":
        rotate(buf, first, second, len(buf))  # <M>middle <S>suffix -> <S>suffix <M>middle
    else:
        rotate(buf, 0, second, len(buf))  # <P>prefix <M>middle <S>suffix -> <S>suffix <P>prefix <M>middle
    return buf


def restored(output: bytes | np.ndarray, form: str) -> bytearray:
    """The text that ``arranged`` was given, from its output and form alone.

    No text in psm or spm form holds a sentinel, and a sentinel shares no beginning with its
    end, so the first of each kind in the output is the one that was inserted.
    """
    buf = bytearray(output)
    if form == "plain":
        return buf
    middle, other = buf.find(MIDDLE), buf.find(SUFFIX if form == "psm" else PREFIX)
    if form == "psm":
        rotate(buf, other, middle, len(buf))  # the rotation's inverse: the two blocks change back
        first, second = other, other + (len(buf) - middle)
    else:
        rotate(buf, 0, other, len(buf))
        first, second = middle - other, len(buf) - other
    for at, sentinel in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        del buf[at:at + len(sentinel)]
    return buf


def _texts(values: list[bytearray]) -> pa.Array:
    return pa.array(values, pa.large_binary()).view(pa.large_string())


def _group(h: Column, i: int) -> Column:
    return F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long")


def fim_transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_pct: int = 10,
                  spm_pct: int = 20) -> DataFrame:
    """Per row: ``id_col``, n, form (plain, psm or spm), prefix_chars, middle_chars, output.

    Cuts and form follow from the sha256 of ``seed:id``, so reruns agree and repeated rows
    come out alike. A text that is empty or holds a sentinel stays plain, as do ``plain_pct``
    of 100 others; of the rest ``spm_pct`` of 100 take the suffix first. A null text is
    empty, a null id is hashed as an empty string; no rows give none. Other columns are left
    out, so none of theirs can clash.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumns({
        "n": F.length("text").cast("long"),
        "_h": F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)})
    one, two = _group(F.col("_h"), 0) % (F.col("n") + 1), _group(F.col("_h"), 1) % (F.col("n") + 1)
    holds = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        holds = holds | F.contains(F.col("text"), F.lit(sentinel.decode()))
    plain = (F.col("n") == 0) | holds | (_group(F.col("_h"), 2) % 100 >= 100 - plain_pct)
    form = F.when(plain, "plain").when(_group(F.col("_h"), 3) % 100 < spm_pct, "spm").otherwise("psm")
    rows = rows.withColumns({"form": form, "_one": F.least(one, two), "_two": F.greatest(one, two)})
    cut = F.col("form") != "plain"
    rows = rows.select("_id", "n", "form", F.when(cut, F.col("_one")).alias("prefix_chars"),
                       F.when(cut, F.col("_two") - F.col("_one")).alias("middle_chars"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(text_column(batch, "text")):
                part = batch.slice(lo, hi - lo)
                data, offsets = utf8(text_column(part, "text"))
                cuts = zip(*(part.column(i).to_pylist() for i in (3, 4, 2)))
                out = [arranged(data[offsets[i]:offsets[i + 1]], *c) for i, c in enumerate(cuts)]
                yield pa.RecordBatch.from_arrays([*part.columns[:5], _texts(out)], names)

    names = ["_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("_id", id_col)


def fim_restore(rows: DataFrame) -> DataFrame:
    """``rows`` with ``restored``: the text rebuilt from ``output`` and ``form`` by the inverse rotations."""
    names = [*rows.columns, "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(text_column(batch, "output")):
                part = batch.slice(lo, hi - lo)
                data, offsets = utf8(text_column(part, "output"))
                forms = part.column(part.schema.get_field_index("form")).to_pylist()
                out = [restored(data[offsets[i]:offsets[i + 1]], f) for i, f in enumerate(forms)]
                yield pa.RecordBatch.from_arrays([*part.columns, _texts(out)], names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("restored", T.StringType())]))
