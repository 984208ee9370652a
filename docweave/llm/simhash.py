"""SimHash near-duplicate detection with pigeonring candidate pruning (operator 6).

Fingerprints: 64 bits, majority of the XXH64 bits of a text's word shingles. Two
fingerprints link at ``max_bits`` or fewer differing bits.

Candidates: the fingerprint is cut into four segments of 16 bits on a ring. If two
fingerprints differ in at most tau = 3 bits, some segment starts a chain whose running
differences stay within proportional budgets: 0 bits after one segment (3/4), 1 after two
(6/4), 2 after three (9/4), 3 after four. So the pairs are found by joining on two
consecutive segments (32 bits), one side with the second segment as it is, the other with
each of its 17 variants of at most one flipped bit; the longer chains and then the full
distance are checked on what meets. Every pair within 3 bits has such a chain, so no link
is lost; a join on the first segment alone would meet 65,536 times as many pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.arrays import slices, text_column
from docweave.llm.components import connected_components, local_forest
from docweave.llm.storage import staged, tasks
from docweave.session import spread

SEGMENTS, WIDTH, MAX_BITS = 4, 16, 3
HOT_KEY = 4096  # index rows of one key above which its probes are split over tasks
PAIR_BLOCK = 1 << 20  # pairs compared at once

WORD_BLOCK = 1 << 21  # bytes of a text whose shingles are hashed at once
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.uint8)
# Bits of a byte spread over eight byte lanes of a 64-bit number, so that up to 255 bytes add up without overflow.
_LANES = np.ascontiguousarray(_BYTE_BITS).view(np.uint64).reshape(256)


def _bit_counts(digests: np.ndarray) -> np.ndarray:
    """Set bits per position over (n, 8) digest bytes."""
    out = np.zeros((8, 8), np.int64)
    for lo in range(0, len(digests), 255 * 256):
        part = _LANES[digests[lo:lo + 255 * 256]]
        sums = np.add.reduceat(part, np.arange(0, len(part), 255), axis=0)
        out += np.ascontiguousarray(sums).view(np.uint8).reshape(len(sums), 8, 8).sum(axis=0, dtype=np.int64)
    return out.reshape(64)


def _word_blocks(text: bytes, size: int) -> Iterator[list[bytes]]:
    """Lower-cased words of a text, about ``size`` bytes at a time."""
    lo = 0
    while lo < len(text):
        end = _WHITE.search(text, lo + size) if lo + size < len(text) else None
        hi = end.start() if end else len(text)
        yield text[lo:hi].translate(_LOWER).split()  # splits at the six ASCII white-space bytes
        lo = hi


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42, block: int = WORD_BLOCK) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text; no words: 0, fewer words than a shingle: the whole sequence. A text is
    read ``block`` bytes at a time, so its shingles are never held all at once."""
    counts, n, words, digest = np.zeros(64, np.int64), 0, [], xxhash.xxh64_digest
    for more in _word_blocks(text, block):
        words = words + more if words else more
        if len(words) < shingle:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        last = len(words) - shingle + 1
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[:last].tolist(), ends[shingle - 1:].tolist())])
        counts += _bit_counts(np.frombuffer(hashes, np.uint8).reshape(last, 8))
        n, words = n + last, words[last:]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(words), seed) if words else 0
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long): one row per row of ``docs``; a null text counts as empty. The bits of ``fp`` are those of
    the unsigned fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, "text")
            for lo, hi in slices(texts):
                fps = [fingerprint(t.as_buffer().to_pybytes() if t.as_buffer() else b"", shingle)
                       for t in texts.slice(lo, hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    slim = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return slim.mapInArrow(run, "id long, fp long").select(F.col("id").alias(id_col), "fp")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _links(index_fp: np.ndarray, probe_fp: np.ndarray, lo: np.ndarray, n: np.ndarray, ring: np.ndarray,
           max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between probe j and index rows lo[j] .. lo[j]+n[j], by chains and then the full distance, as a forest."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.cumsum(n)
    done = 0
    at = 0
    while at < len(n):  # blocks of whole probes up to PAIR_BLOCK pairs; one large probe is cut by _wide
        to = max(at + 1, int(np.searchsorted(total, done + PAIR_BLOCK, "right")))
        count = n[at:to]
        j = np.repeat(np.arange(at, to), count)
        i = np.arange(len(j)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[at:to], count)
        x, y = probe_fp[j], index_fp[i]
        diff = (x ^ y).view(np.uint64)
        shift = (ring[j] * WIDTH).astype(np.uint64)
        turned = np.where(shift == 0, diff, (diff << shift) | (diff >> ((np.uint64(64) - shift) & np.uint64(63))))
        keep = (diff != 0) & (_popcount(turned >> np.uint64(16)) <= 2) & (_popcount(diff) <= max_bits)
        if keep.any():
            a, b = np.concatenate([a, x[keep]]), np.concatenate([b, y[keep]])
            if len(a) > PAIR_BLOCK:
                a, b = local_forest(a, b)
        done = int(total[to - 1])
        at = to
    return local_forest(a, b) if len(a) else (a, b)


def _matched(max_bits: int):
    """Tasks hold rows (key, salt, role, fp) sorted by key, salt and role (index rows first); emits links."""
    def process(rows: np.ndarray, n_rows: int):
        key, role, fp = rows["key"][:n_rows], rows["role"][:n_rows], rows["fp"][:n_rows]
        group = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (rows["salt"][1:n_rows] != rows["salt"][:n_rows - 1])) + 1])
        size = np.diff(np.append(group, n_rows))
        n_index = np.add.reduceat((role == 0).astype(np.int64), group)
        probes = np.flatnonzero(role == 1)
        of = np.repeat(np.arange(len(group)), size)[probes]
        mate = n_index[of] > 0
        probes, of = probes[mate], of[mate]
        return _links(fp, fp[probes], group[of], n_index[of], key[probes] >> 32, max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([("key", np.int64), ("salt", np.int64), ("role", np.int64), ("fp", np.int64)])

        def load(batch):
            out = np.empty(batch.num_rows, kind)
            for name in kind.names:
                out[name] = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            return out

        def emit(links):
            a, b = links
            for lo in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[lo:lo + 50_000]), pa.array(b[lo:lo + 50_000])], ["a", "b"])

        held: list[np.ndarray] = []
        for batch in batches:
            held.append(load(batch))
            if sum(map(len, held)) < 200_000:
                continue
            rows = np.concatenate(held)
            last = (rows["key"] == rows["key"][-1]) & (rows["salt"] == rows["salt"][-1])
            cut = int(np.argmax(last))  # rows of the last group wait for the next batch
            if cut:
                yield from emit(process(rows, cut))
                rows = rows[cut:]
            else:  # one group larger than the buffer: compare what is here, keep its index rows
                yield from emit(process(rows, len(rows)))
                rows = rows[rows["role"] == 0]
            held = [rows]
        if held and sum(map(len, held)):
            rows = np.concatenate(held)
            yield from emit(process(rows, len(rows)))

    return run


def link_fingerprints(distinct: DataFrame, max_bits: int = MAX_BITS, hot_key: int = HOT_KEY) -> DataFrame:
    """(a, b): links that connect all fingerprints within ``max_bits`` (3 at most) of one another.

    ``distinct`` holds each fingerprint once (column fp). Within a key's rows the links are
    reduced to a forest before they leave the task: same components, one link a
    fingerprint at most, so a group of near copies never turns into all its pairs. A key
    with more than ``hot_key`` index rows has its probes dealt over several tasks.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("chains of four segments serve 0 to 3 bits")
    # ring turn i brings segments i, i+1 into the upper 32 bits
    def turned(i):
        return f"(shiftleft(fp, {WIDTH * i}) | shiftrightunsigned(fp, {64 - WIDTH * i}))" if i else "fp"

    keys = [f"({i}L << 32) | shiftrightunsigned({turned(i)}, 32)".replace(f"{i}L << 32", f"{i << 32}L") for i in range(SEGMENTS)]
    near = ", ".join(["0L"] + [f"{1 << bit}L" for bit in range(WIDTH)])
    index = distinct.select("fp", F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"))
    probe = index.select("fp", F.explode(F.expr(f"transform(array({near}), x -> key ^ x)")).alias("key"))
    hot = staged(index.groupBy("key").count().where(F.col("count") > hot_key)
                 .select(F.col("key").alias("hot"), F.ceil(F.col("count") / hot_key).cast("long").alias("ways")), "hot-keys")
    if hot.isEmpty():
        rows = index.select("key", F.lit(0).cast("long").alias("salt"), F.lit(0).cast("long").alias("role"), "fp").union(
            probe.select("key", F.lit(0).cast("long"), F.lit(1).cast("long"), "fp"))
    else:
        wide = index.join(hot, F.col("key") == F.col("hot"), "left")
        dealt = probe.join(hot, F.col("key") == F.col("hot"), "left")
        rows = wide.select("key", F.explode(F.expr("sequence(0L, coalesce(ways, 1L) - 1L)")).alias("salt"),
                           F.lit(0).cast("long").alias("role"), "fp").union(
            dealt.select("key", F.expr("pmod(xxhash64(fp), coalesce(ways, 1L))"), F.lit(1).cast("long"), "fp"))
    n = tasks(distinct.sparkSession)
    return rows.repartition(n, "key", "salt").sortWithinPartitions("key", "salt", "role").mapInArrow(
        _matched(max_bits), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       max_bits: int = MAX_BITS, hot_key: int = HOT_KEY) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint``: 16 lowercase hex digits; ``component_id``: the smallest doc_id reachable
    over links, the row's own included (null ids count only where a component has no other).
    Null and empty texts have fingerprint zero and link like any other; repeated rows each
    give a row; an empty table gives none; other columns are not read.
    """
    rows = staged(fingerprints(docs, id_col, text_col, shingle).select(F.col(id_col).alias("doc_id"), "fp"), "fingerprints")
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected_components(link_fingerprints(classes.select("fp"), max_bits, hot_key))
    n = tasks(docs.sparkSession)
    rooted = classes.join(roots.repartition(n), F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = staged(rooted, "rooted")
    least = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id")).repartition(n)
    named = staged(rooted.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("class_fp"), "component_id"), "named")
    return rows.join(named, F.col("fp") == F.col("class_fp")).select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
