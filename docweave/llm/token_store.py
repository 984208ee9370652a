"""Token-ID output compressed by Re-Pair grammars (operator 2).

Shards are runs of whole documents in ascending doc_id order. In a shard, frequent pairs of
neighbouring symbols are replaced by new nonterminals, again and again; pairs never cross a
document's end, so every document keeps a symbol range of its own. The shard stores the
rules, every symbol's expansion length and the documents' symbol and token counts: a
document, or a token range of it, is decoded without the rest.

Shard file format (little-endian), held as one binary value per row of a Parquet table, so
that Spark's writer commits it whatever store the folder is in: magic ``RPR1``; uint32
first nonterminal, symbol width in bytes; uint64 documents, rules, symbols, tokens; then
doc ids int64, null-id flags uint8, symbol counts uint32, token counts uint32; rules (left
uint32, right uint32, expansion length uint32); symbols of the given width.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.arrays import slices, text_column
from docweave.llm.storage import discard, staged, staged_folders, tasks
from docweave.llm.tokens import encoder
from docweave.session import spread

MAGIC = b"RPR1"
_HEADER = struct.Struct("<4sIIQQQQ")


_BUCKETS = 1 << 20


def _bucket(key: np.ndarray) -> np.ndarray:
    return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def repair(ids: np.ndarray, last: np.ndarray, first_rule: int, passes: int, min_count: int, max_rules: int):
    """(symbols, last-of-document flags, left, right) after up to ``passes`` rounds of replacing pairs seen ``min_count`` times.

    A round counts all pairs, takes the most frequent ones and replaces their occurrences
    from left to right where they do not overlap.
    """
    sym, left, right = ids.astype(np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _ in range(passes):
        if len(sym) < 2 or len(left) >= max_rules:
            break
        key = sym[:-1] * (1 << 32) | sym[1:]
        key[last[:-1]] = -1
        # rough counts first: only pairs whose hash bucket is frequent are sorted and counted exactly
        bucket = _bucket(key)
        rough = np.bincount(bucket, minlength=_BUCKETS)
        often = np.flatnonzero((rough[bucket] >= min_count) & (key >= 0))
        if not len(often):
            break
        ordered = np.sort(key[often])
        begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(np.append(begins, len(ordered)))
        top = np.flatnonzero(count >= min_count)
        if not len(top):
            break
        top = top[np.argsort(-count[top], kind="stable")][:max_rules - len(left)]
        pair = ordered[begins[top]]
        # one rule a bucket, the more frequent pair's; the other waits for the next round
        rule = np.full(_BUCKETS, -1, np.int64)
        rule[_bucket(pair)[::-1]] = np.arange(len(pair))[::-1]
        pair = pair[rule[_bucket(pair)] == np.arange(len(pair))]
        rule[_bucket(pair)] = np.arange(len(pair))
        found = rule[bucket[often]]
        hit = (found >= 0) & (pair[found] == key[often])
        at, found = often[hit], found[hit] + first_rule + len(left)
        # of overlapping occurrences in a run every second one goes, from the left
        starts = np.concatenate([[True], at[1:] != at[:-1] + 1])
        run_start = at[np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))]
        go = (at - run_start) % 2 == 0
        at, found = at[go], found[go]
        sym[at] = found
        last = last.copy()
        last[at] |= last[at + 1]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, last = sym[keep], last[keep]
        left, right = np.concatenate([left, pair >> 32]), np.concatenate([right, pair & 0xFFFFFFFF])
    return sym, last, left, right


def pack_shard(doc_ids: list, counts: np.ndarray, ids: np.ndarray, vocabulary: int, passes: int, min_count: int) -> bytes:
    """A shard's bytes from its documents' ids (``counts[i]`` each, at least one)."""
    ends = np.cumsum(counts)
    last = np.zeros(len(ids), bool)
    last[ends - 1] = True
    width = 2 if vocabulary < 60_000 else 4
    sym, last, left, right = repair(ids, last, vocabulary, passes, min_count, (1 << 16) - vocabulary if width == 2 else 1 << 20)
    length = np.ones(vocabulary + len(left), np.int64)
    for i in range(len(left)):  # a rule's parts come before it
        length[vocabulary + i] = length[left[i]] + length[right[i]]
    per_doc = np.diff(np.concatenate([[0], np.flatnonzero(last) + 1]))
    missing = np.array([d is None for d in doc_ids], np.uint8)
    plain = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join([
        _HEADER.pack(MAGIC, vocabulary, width, len(doc_ids), len(left), len(sym), len(ids)), plain.tobytes(), missing.tobytes(),
        per_doc.astype("<u4").tobytes(), np.asarray(counts).astype("<u4").tobytes(),
        left.astype("<u4").tobytes(), right.astype("<u4").tobytes(), length[vocabulary:].astype("<u4").tobytes(),
        sym.astype(f"<u{width}").tobytes()])


class Shard:
    """Random access to a shard's documents."""

    def __init__(self, blob: bytes) -> None:
        magic, self.first_rule, width, n_docs, n_rules, n_symbols, self.n_tokens = _HEADER.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = _HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        ids, missing = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if m else int(d) for d, m in zip(ids, missing)]
        self.symbol_at = np.concatenate([[0], np.cumsum(take("<u4", n_docs), dtype=np.int64)])
        self.counts = take("<u4", n_docs).astype(np.int64)
        self.left, self.right, self.length = (take("<u4", n_rules) for _ in range(3))
        self.symbols = take(f"<u{width}", n_symbols)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for: all rules opened level by level."""
        out = symbols.astype(np.int64)
        while True:
            rule = out >= self.first_rule
            if not rule.any():
                return out.astype("<u4")
            at = np.cumsum(1 + rule) - (1 + rule)
            wide = np.empty(int(len(out) + rule.sum()), np.int64)
            wide[at[~rule]] = out[~rule]
            wide[at[rule]] = self.left[out[rule] - self.first_rule]
            wide[at[rule] + 1] = self.right[out[rule] - self.first_rule]
            out = wide

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.symbol_at[i]:self.symbol_at[i + 1]])

    def tokens(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of document i: the stored lengths find the symbols that hold them."""
        symbols = self.symbols[self.symbol_at[i]:self.symbol_at[i + 1]].astype(np.int64)
        rule = symbols >= self.first_rule
        length = np.ones(len(symbols), np.int64)
        length[rule] = self.length[symbols[rule] - self.first_rule]
        ends = np.cumsum(length)
        lo, hi = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[lo - 1]) if lo else 0
        return self.expand(symbols[lo:hi])[start - before:stop - before]


def id_type(vocabulary: int) -> str:
    """Ids on their way to the shards: two bytes where they suffice."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary): little-endian ids of ``id_type`` with the end id, per row."""
    kind = np.dtype(id_type(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            texts = text_column(batch, "text")
            for lo, hi in slices(texts, 4 << 20):  # more text at once repeats fewer pieces
                ids, offsets = enc.encode(texts.slice(lo, hi - lo))
                n = hi - lo
                out = np.full(len(ids) + n, end_id, kind)
                doc = np.repeat(np.arange(n), np.diff(offsets))
                out[np.arange(len(ids)) + doc] = ids
                bounds = (offsets + np.arange(n + 1)) * kind.itemsize
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.BinaryArray.from_buffers(
                    pa.binary(), n, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out)])], ["id", "ids"])

    slim = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return slim.mapInArrow(run, "id long, ids binary").select(F.col("id").alias("doc_id"), "ids")


def write_shards(encoded: DataFrame, path: str, vocabulary: int, shard_tokens: int = 1 << 19, passes: int = 6, min_count: int = 16) -> None:
    """Write (doc_id, ids) as shards in ascending doc_id order (null first; equal ids by content) to a Parquet table."""
    kind = np.dtype(id_type(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts, total, n = [], [], 0, 0

        def flush():
            counts = np.array([len(p) // kind.itemsize for p in parts], np.int64)
            ids = np.frombuffer(b"".join(parts), kind)
            blob = pack_shard(names, counts, ids, vocabulary, passes, min_count)
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([n]), pa.array([total]), pa.array([blob], pa.binary())], ["part", "shard", "n_tokens", "content"])

        part = None
        for batch in batches:
            for i in range(batch.num_rows):
                if part is None:
                    part = batch.column(2)[i].as_py()
                ids = batch.column(1)[i].as_py()
                if parts and total + len(ids) // kind.itemsize > shard_tokens:
                    yield flush()
                    names, parts, total, n = [], [], 0, n + 1
                names.append(batch.column(0)[i].as_py())
                parts.append(ids)
                total += len(ids) // kind.itemsize
        if parts:
            yield flush()

    order = ["doc_id", "tie", "row"]
    rows = staged(encoded.withColumn("tie", F.xxhash64("ids")).withColumn("row", F.monotonically_increasing_id()), "token-ids", "zstd")
    ranged = rows.repartitionByRange(tasks(encoded.sparkSession), *order).sortWithinPartitions(*order)
    ranged.select("doc_id", "ids", F.spark_partition_id().cast("long").alias("part")).mapInArrow(
        run, "part long, shard long, n_tokens long, content binary").write.option("compression", "zstd").parquet(path)
    discard(encoded.sparkSession, len(staged_folders()) - 1)  # the ids are in the shards now


def read_shards(spark, path: str) -> DataFrame:
    """Per document, decoded from the written shards: (doc_id, start, n_tokens, ids_crc32, part, shard).

    ``start`` counts the ids of all documents before it. Running counts need the shards'
    totals alone; the one window without a partition key sees a row for each written file.
    """
    shards = spark.read.schema("part long, shard long, n_tokens long, content binary").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.column(2)[i].as_py())
                n = len(shard.counts)
                crc = [zlib.crc32(shard.document(k).tobytes()) for k in range(n)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, batch.column(0)[i].as_py())), pa.array(np.full(n, batch.column(1)[i].as_py())),
                    pa.array(shard.doc_ids, pa.int64()), pa.array(np.cumsum(shard.counts) - shard.counts), pa.array(shard.counts),
                    pa.array(crc, pa.int64())], ["part", "shard", "doc_id", "within", "n_tokens", "ids_crc32"])

    docs = shards.select("part", "shard", "content").mapInArrow(
        run, "part long, shard long, doc_id long, within long, n_tokens long, ids_crc32 long")
    totals = shards.select("part", "shard", "n_tokens")
    zero = F.lit(0).cast("long")
    files = totals.groupBy("part").agg(F.sum("n_tokens").alias("t")).select(
        F.col("part").alias("p"), F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("file_start"))
    inside = totals.select("part", "shard", F.coalesce(F.sum("n_tokens").over(
        Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("shard_start"))
    starts = inside.join(files, F.col("part") == F.col("p")).select(
        F.col("part").alias("_part"), F.col("shard").alias("_shard"), (F.col("file_start") + F.col("shard_start")).alias("before"))
    return docs.join(starts, (F.col("part") == F.col("_part")) & (F.col("shard") == F.col("_shard"))).select(
        "doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "part", "shard")


def token_output(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, vocabulary: int = 49_408,
                 id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Encode, write and read back all documents.

    A null text is encoded as empty (its end id alone); a null id sorts first; repeated rows
    are documents of their own; an empty table writes no shard. ``path`` must be a new
    folder that all executors share.
    """
    write_shards(encode_documents(docs, tokenizer, end_id, vocabulary, id_col, text_col), path, vocabulary, **options)
    return read_shards(docs.sparkSession, path)
