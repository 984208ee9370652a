"""Repetition coverage and basic quality rules (operator 7).

Words of a batch get exact ids (Arrow dictionary), n-gram windows get rolling 64-bit
hashes over those ids in numpy, and windows of one document that meet again mark the
characters they cover. All rules are row-local: no shuffle, whole texts, bounded slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.arrays import code_points, dictionary, mix64, packed, slices, text_column, utf8, word_spans
from docweave.session import spread

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """A document is rejected when a share lies above its limit.

    ``top`` limits the share of word characters covered by the single most frequent n-gram
    (where it occurs at least ``top_min`` times, so that a short text's chance pair does not
    count); ``duplicate`` the share covered by n-grams that repeat an earlier one of the
    text; ``line_chars`` the share of the lines' characters in lines that do.
    """
    min_words: int = 10
    window: int = 5
    window_percent: int = 20
    top_min: int = 3
    top: dict[int, float] = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    duplicate: dict[int, float] = field(
        default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    line_chars: float = 0.20


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]], also for empty ranges."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every item: how often its key occurs, and the position of the key's first occurrence."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(key)
    k = key[order]
    begins = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.append(begins, len(k)))
    count, first = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
    count[order] = np.repeat(size, size)
    first[order] = np.repeat(np.minimum.reduceat(order, begins), size)
    return count, first


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Positions that lie in a window of n that begins at one of ``starts``."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    return np.cumsum(step)[:size] > 0


def measure(texts: pa.Array, limits: Limits) -> dict[str, np.ndarray]:
    """The measures of every text of a large_string column without nulls."""
    data, offsets = utf8(texts)
    n = len(texts)
    starts, ends, bounds = word_spans(data, offsets)
    row = np.repeat(np.arange(n), np.diff(bounds))
    points = np.concatenate([[0], np.cumsum(code_points(data), dtype=np.int64)])
    chars = points[ends] - points[starts]
    ids = mix64(dictionary(packed(data, starts, ends))[0])
    word_chars = _sums(chars, bounds)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    out = {"n_words": np.diff(bounds), "word_chars": word_chars, "n_symbols": _sums(symbol[data], offsets)}

    # \n-split lines with a word, in order; equal lines by exact id. A line that starts where
    # several rows do (empty rows, or a final \n) has no words unless it is the last of them.
    line_start = np.sort(np.concatenate([offsets[:-1], np.flatnonzero(data == 0x0A) + 1]))
    of_row = np.minimum(np.searchsorted(offsets, line_start, "right") - 1, n - 1)
    line_end = np.append(line_start[1:], len(data))
    ended = line_end > line_start
    line_end[ended] -= data[line_end[ended] - 1] == 0x0A
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, of_row = line_start[worded], line_end[worded], of_row[worded]
    in_row = mix64(np.arange(n)) * np.uint64(0x9E3779B97F4A7C15)  # keeps equal lines and n-grams of two texts apart
    _, earliest = _groups(mix64(dictionary(packed(data, line_start, line_end))[0]) ^ in_row[of_row])
    first = earliest == np.arange(len(of_row))
    line_chars = points[line_end] - points[line_start]
    out["n_lines"] = np.bincount(of_row, minlength=n)
    out["n_dup_lines"] = np.bincount(of_row[~first], minlength=n)
    out["line_chars"] = np.bincount(of_row, line_chars, minlength=n).astype(np.int64)
    out["dup_line_chars"] = np.bincount(of_row[~first], line_chars[~first], minlength=n).astype(np.int64)

    # A longer n-gram can only repeat where each shorter one at its start does, so each length looks at fewer places.
    total = np.concatenate([[0], np.cumsum(chars)])
    at = np.arange(len(row))
    for k in range(min(limits.top), max(limits.duplicate) + 1):
        at = at[at + k <= len(row)]
        at = at[row[at] == row[at + k - 1]]
        h = np.zeros(len(at), np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C55) + ids[at + j]
        count, earliest = _groups(mix64(h) ^ in_row[row[at]])
        again = count >= 2
        at, count, later = at[again], count[again], earliest[again] != np.flatnonzero(again)
        if k == limits.window:
            out["n_repeat_words"] = np.bincount(row[_covered(at, k, len(row))], minlength=n)
        if k in limits.duplicate:
            hit = _covered(at[later], k, len(row))
            out[f"dup_{k}_chars"] = np.bincount(row[hit], chars[hit], minlength=n).astype(np.int64)
        if k in limits.top:
            # the most frequent n-gram of each text; of equally frequent ones the one that covers most
            cover = (total[at + k] - total[at]) * np.where(count >= limits.top_min, count, 0)
            best, most = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.maximum.at(most, row[at], count)
            top = count == most[row[at]]
            np.maximum.at(best, row[at][top], cover[top])
            out[f"top_{k}_chars"] = np.minimum(best, word_chars)
    return out


def _verdict(m: dict[str, np.ndarray], limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < limits.min_words) | (100 * m["n_repeat_words"] > limits.window_percent * m["n_words"])
    bad = m["dup_line_chars"] > limits.line_chars * m["line_chars"]
    for k, most in limits.top.items():
        bad |= m[f"top_{k}_chars"] > most * m["word_chars"]
    for k, most in limits.duplicate.items():
        bad |= m[f"dup_{k}_chars"] > most * m["word_chars"]
    return failed, ~failed & ~bad


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     limits: Limits | None = None) -> DataFrame:
    """Per row: the base measures, the repetition measures, ``base_failed`` and ``kept``.

    A null or empty text has no words and fails the base rule. Repeated rows each give a
    row; an empty table gives none; other columns are not read, so their names cannot clash.
    """
    lim = limits or Limits()
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = ["n_lines", "line_chars", "dup_line_chars", *[f"top_{k}_chars" for k in lim.top], *[f"dup_{k}_chars" for k in lim.duplicate]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, "text")
            for lo, hi in slices(texts, 1 << 20):
                m = measure(texts.slice(lo, hi - lo), lim)
                failed, kept = _verdict(m, lim)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *[pa.array(m[c].astype(np.int64)) for c in longs],
                     pa.array(failed), pa.array(kept), *[pa.array(m[c].astype(np.int64)) for c in more]],
                    ["id", *longs, "base_failed", "kept", *more])

    slim = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = slim.schema["id"].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *[f"{c} long" for c in longs], "base_failed boolean", "kept boolean",
                        *[f"{c} long" for c in more]])
    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)
