"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment (operator 10).

The benchmark is a stated query set held in blocks of bounded size; the corpus is scanned
once per eight blocks for document frequencies and once for matches, without a shuffle of texts.

1. Every word n-gram of the items is looked up in all documents: its document frequency.
2. An item's seeds are the rarest share of its own n-grams, by documents times items that hold
   them. The share is relative to the item, so an item that half the corpus quotes keeps its
   seeds like any other; a template that thousands of items share comes last in all of them.
3. Where a seed of an item meets a document, hits on nearby diagonals form a window. Windows
   that do not reach the score alone are tried as one over the words inserted between them.
4. Words of item and window are aligned locally (match +2, mismatch -1, gap -1). The score
   is the alignment's over the best possible (2 for each word of the item).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.arrays import dictionary, packed, slices, text_column, utf8, word_spans
from docweave.session import spread

BLOCK_BYTES = 4 << 20  # benchmark text of a block
BLOCKS_A_SCAN = 8  # blocks looked for in one scan of the corpus
HITS = 1_000_000  # (hit, item) pairs held at once
PUNCTUATION = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»“”„‘’…–—¡¿"
MATCH, MISMATCH, GAP = 2, -1, -1
_BASE = np.uint64(0x9E3779B97F4A7C55)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code per word, word number within its text, words before each text (n+1)).

    Words are lower-cased and lose punctuation at both ends; those of punctuation alone are left out.
    """
    data, offsets = utf8(texts)
    starts, ends, bounds = word_spans(data, offsets)
    index, distinct = dictionary(packed(data, starts, ends))
    plain = pc.utf8_trim(pc.utf8_lower(distinct.cast(pa.large_string())), PUNCTUATION)
    code = np.array([xxhash.xxh64_intdigest(w) if w else 0 for w in plain.to_pylist()], np.uint64)[index] if len(index) else np.zeros(0, np.uint64)
    keep = code != 0
    number = np.arange(len(code)) - np.repeat(bounds[:-1], np.diff(bounds))
    return code[keep], number[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of every run of n codes (runs may cross texts)."""
    h = np.full(max(len(codes) - n + 1, 0), n, np.uint64)
    for k in range(n):
        h = h * _BASE + codes[k:k + len(h)]
    return h ^ (h >> np.uint64(31))


class Grams:
    """Sorted gram hashes with a bit table in front, so that most lookups end after one read."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.sorted = np.unique(hashes)
        self.front = np.zeros(1 << 22, bool)
        self.front[(self.sorted >> np.uint64(42)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, gram numbers) of the hashes that are here."""
        at = np.flatnonzero(self.front[(h >> np.uint64(42)).astype(np.int64)])
        number = np.searchsorted(self.sorted, h[at])
        number[number == len(self.sorted)] = 0
        hit = self.sorted[number] == h[at] if len(self.sorted) else np.zeros(len(at), bool)
        return at[hit], number[hit]


class Items:
    """Benchmark items of one block, those of equal words as one class, and the grams that stand for them."""

    def __init__(self, texts: list[str], n: int) -> None:
        codes, _, bounds = word_codes(pa.array(texts, pa.large_string()))
        classes: dict[bytes, int] = {}
        of = np.array([classes.setdefault(codes[a:b].tobytes(), len(classes)) for a, b in zip(bounds[:-1], bounds[1:])], np.int64)
        self.codes = [np.frombuffer(key, np.uint64) for key in classes]
        self.member = np.argsort(of, kind="stable")  # rows of the block by class
        self.first = np.searchsorted(of[self.member], np.arange(len(classes) + 1))
        self.size = np.array([len(c) for c in self.codes], np.int64)
        flat, start = np.concatenate([*self.codes, np.zeros(0, np.uint64)]), np.cumsum(self.size) - self.size
        length, hashes, item, position = [], [], [], []
        for k in range(1, n + 1):  # an item shorter than n words is one gram
            mine = np.flatnonzero(self.size >= n if k == n else self.size == k)
            which, at = _ranges(start[mine], self.size[mine] - k + 1)
            length.append(np.full(len(at), k))
            hashes.append(grams(flat, k)[at] if len(at) else np.zeros(0, np.uint64))
            item.append(mine[which])
            position.append(at - start[mine[which]])
        self.length, self.hash, self.item, self.position = (np.concatenate(x) for x in (length, hashes, item, position))

    def lookup(self, keep: np.ndarray) -> list[tuple[int, Grams, np.ndarray, np.ndarray]]:
        """Per gram length: its table, and (gram number * items + item, position) of the grams kept, sorted."""
        out = []
        for k in np.unique(self.length[keep]).tolist():
            mine = np.flatnonzero(keep & (self.length == k))
            table = Grams(self.hash[mine])
            key = np.searchsorted(table.sorted, self.hash[mine]) * len(self.codes) + self.item[mine]
            order = np.argsort(key, kind="stable")
            out.append((k, table, key[order], self.position[mine][order]))
        return out


def _ranges(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, position) of every position of the ranges ``begin .. begin + count``."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)


def _hits(codes: np.ndarray, bounds: np.ndarray, tables) -> Iterator[tuple]:
    """(gram length, table, keys, positions, word, gram number, text) of the grams of ``codes`` that ``tables`` hold."""
    row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for k, table, key, position in tables:
        if len(codes) < k:
            continue
        at, number = table.find(grams(codes, k))
        inside = row_of[at] == row_of[at + k - 1]
        yield k, table, key, position, at[inside], number[inside], row_of[at[inside]]


def align(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair of rows, and the column (exclusive) where it ends.

    x (pairs, m) and y (pairs, w) are codes; pad x with 0 and y with 1, which match nothing.
    """
    n, w = y.shape
    h = np.zeros((n, w + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    slope = np.arange(w, dtype=np.int32) * -GAP
    for i in range(x.shape[1]):
        t = np.where(x[:, i, None] == y, MATCH, MISMATCH).astype(np.int32)
        t += h[:, :-1]
        np.maximum(t, h[:, 1:] + GAP, out=t)
        np.maximum(t, 0, out=t)
        t += slope  # gaps along y: a running maximum over what a gap still costs
        np.maximum.accumulate(t, axis=1, out=t)
        t -= slope
        h[:, 1:] = t
        top = t.argmax(axis=1)
        value = t[np.arange(n), top]
        better = value > best
        best[better], end[better] = value[better], top[better] + 1
    return best, end


def _align_windows(items: Items, codes: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: float):
    """(score, start, end) of each window codes[lo:hi] against its item; score 0 where it can't reach ``least``."""
    score, start, end = np.zeros(len(item)), lo.copy(), lo.copy()
    m = items.size[item]
    order = np.lexsort((hi - lo, m))
    at = 0
    while at < len(order):  # blocks of windows of similar shape, padded to the largest
        to, cells = at, 0
        while to < len(order) and (to == at or cells < 400_000):
            to += 1
            part = order[at:to]
            cells = len(part) * int((hi - lo)[part].max())
        part = order[at:to]
        at = to
        x = np.zeros((len(part), int(m[part].max())), np.uint64)
        y = np.ones((len(part), int((hi - lo)[part].max())), np.uint64)
        for r, j in enumerate(part):
            x[r, :m[j]] = items.codes[item[j]]
            y[r, :hi[j] - lo[j]] = codes[lo[j]:hi[j]]
        best, stop = align(x, y)
        value = best / (MATCH * m[part])
        good = np.flatnonzero(value >= least)
        if len(good):  # the same alignment backwards gives its first word
            bx, by = np.zeros_like(x[good]), np.ones_like(y[good])
            for r, g in enumerate(good):
                j = part[g]
                bx[r, :m[j]] = x[g, :m[j]][::-1]
                by[r, :stop[g]] = y[g, :stop[g]][::-1]
            _, back = align(bx, by)
            start[part[good]] = lo[part[good]] + stop[good] - back
            end[part[good]] = lo[part[good]] + stop[good]
            score[part[good]] = value[good]
    return score, start, end


def _pieces(items: Items, hits: list[tuple], bounds: np.ndarray, min_score: float, found: np.ndarray) -> Iterator[tuple]:
    """Windows of all items, a range of items at a time, so that about ``HITS`` (hit, item) pairs are held at once.
    Texts marked in ``found`` by then are passed over."""
    todo = [(0, len(items.codes))]
    while todo:
        lo, hi = todo.pop()
        spans = []
        for _, _, key, position, at, number, row in hits:
            live = ~found[row]
            at, number, row = at[live], number[live], row[live]
            begin = np.searchsorted(key, number * len(items.codes) + lo)
            spans.append((key, position, at, row, begin, np.searchsorted(key, number * len(items.codes) + hi) - begin))
        if sum(int(count.sum()) for *_, count in spans) > HITS and hi - lo > 1:
            todo += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]
        else:
            yield _windows(items, spans, bounds, min_score)


def _windows(items: Items, spans: list[tuple], bounds: np.ndarray, min_score: float):
    """(row, item, lo, hi, run) of windows around the hits of each (text, item), by nearby diagonals. Windows of a run
    lie so near that one alignment over words inserted between them can still reach ``min_score``."""
    rows, its, diagonals = [], [], []
    for key, position, at, row, begin, count in spans:
        which, pick = _ranges(begin, count)
        rows.append(row[which])
        its.append(key[pick] % len(items.codes))
        diagonals.append(at[which] - position[pick])
    if not rows or not sum(map(len, rows)):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    row, item, diagonal = (np.concatenate(x) for x in (rows, its, diagonals))
    order = np.lexsort((diagonal, item, row))
    row, item, diagonal = row[order], item[order], diagonal[order]
    m = items.size[item]
    slack = m // 2 + 4
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    lo = np.maximum(diagonal[first] - slack[first], bounds[row[first]])
    hi = np.minimum(diagonal[last] + m[first] + slack[first], bounds[row[first] + 1])
    reach = np.ceil(MATCH * m * (1 - min_score) / -GAP).astype(np.int64)
    far = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > reach[1:])])
    return row[first], item[first], lo, hi, np.cumsum(far)[first]


def _joined(items: Items, codes: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, run: np.ndarray, score: np.ndarray,
            min_score: float):
    """(first window, lo, hi) of the runs of several windows none of which reaches ``min_score``, and which hold enough of
    the item's words to reach it together."""
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    last = np.append(first[1:], len(run)) - 1
    open_ = (last > first) & (np.maximum.reduceat(score, first) < min_score)
    first, last = first[open_], last[open_]
    enough = np.array([np.isin(items.codes[item[f]], codes[lo[f]:hi[g]]).sum() >= min_score * len(items.codes[item[f]])
                       for f, g in zip(first, last)], bool)
    return first[enough], lo[first[enough]], hi[last[enough]]


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", n: int = 3, seed_share: float = 0.75,
                       min_score: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word, n_windows): documents that hold a benchmark item, whole or edited.

    One row for each row of ``docs`` and of ``benchmark`` that match with ``min_score`` or
    more: the best window, in words of the text (end exclusive), and the number of windows
    that reach the score. Null texts count as empty and match nothing, nor do items without
    words; null ids are carried; equal rows match alike; empty tables give no rows.
    """
    slim = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    bench = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    schema = (f"doc_id {slim.schema['id'].dataType.simpleString()}, item_id {bench.schema['item'].dataType.simpleString()}, "
              "score double, start_word long, end_word long, n_windows long")
    out = None
    for parts in _scans(bench, block_bytes):
        found = slim.mapInArrow(_report(_seeds(slim, parts, n, seed_share), min_score), schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"doc_id": id_col, "item_id": item_col})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                      n: int = 3, seed_share: float = 0.75, min_score: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with all its columns, without the rows that hold a benchmark item as ``find_contamination`` finds it."""
    docs = spread(docs)
    slim = docs.select(F.col(text_col).alias("text"))
    bench = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    for parts in _scans(bench, block_bytes):
        docs = docs.mapInArrow(_clean(_seeds(slim, parts, n, seed_share), min_score, text_col), docs.schema)
    return docs


def _scans(bench: DataFrame, block_bytes: int) -> Iterator[list[pa.Table]]:
    """The benchmark (item, text) in blocks of about ``block_bytes`` of text, ``BLOCKS_A_SCAN`` at a time; their number grows
    with the benchmark alone."""
    bench = bench.withColumn("text", F.coalesce("text", F.lit("")))
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    for first in range(0, blocks, BLOCKS_A_SCAN):
        yield [bench.where(F.pmod(F.xxhash64("text", "item"), F.lit(blocks)) == b).orderBy("item", "text").toArrow()
               for b in range(first, min(first + BLOCKS_A_SCAN, blocks))]


def _seeds(slim: DataFrame, parts: list[pa.Table], n: int, seed_share: float):
    """Broadcast [(items, lookup of their rare grams, item ids)] of blocks, after one count of document frequencies in ``slim``."""
    spark = slim.sparkSession
    blocks = [Items(part.column("text").to_pylist(), n) for part in parts]
    names = [part.column("item").combine_chunks() for part in parts]
    length, hashes = (np.concatenate([getattr(items, x) for items in blocks]) for x in ("length", "hash"))
    everything = [(k, Grams(hashes[length == k])) for k in np.unique(length).tolist()]
    held = spark.sparkContext.broadcast(everything)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [(k, table, None, None) for k, table in held.value]
        counts = {k: np.zeros(len(table.sorted), np.int64) for k, table, *_ in tables}
        for batch in batches:
            col = text_column(batch, "text")
            for lo, hi in slices(col):
                codes, _, bounds = word_codes(col.slice(lo, hi - lo))
                for k, table, _, _, _, number, row in _hits(codes, bounds, tables):
                    once = np.unique(row * len(table.sorted) + number) % len(table.sorted)
                    counts[k] += np.bincount(once, minlength=len(table.sorted))
        for k, c in counts.items():
            seen = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), k)), pa.array(seen), pa.array(c[seen])], ["k", "gram", "df"])

    weight = {}
    if everything:
        got = slim.select("text").mapInArrow(frequencies, "k long, gram long, df long").groupBy("k", "gram").agg(F.sum("df").alias("df")).toPandas()
        for k, table in everything:
            df, holders = np.zeros(len(table.sorted), np.int64), np.zeros(len(table.sorted), np.int64)
            mine = got[got["k"] == k]
            df[mine["gram"].to_numpy()] = mine["df"].to_numpy()
            for items in blocks:
                of = items.length == k
                pair = np.unique(np.searchsorted(table.sorted, items.hash[of]) * max(1, len(items.codes)) + items.item[of])
                holders += np.bincount(pair // max(1, len(items.codes)), minlength=len(table.sorted))
            weight[k] = table.sorted, df * holders
    return spark.sparkContext.broadcast([(items, items.lookup(_rare(items, weight, seed_share)), name) for items, name in zip(blocks, names)])


def _rare(items: Items, weight: dict[int, tuple[np.ndarray, np.ndarray]], seed_share: float) -> np.ndarray:
    """Which grams are seeds: of each item, the share with the least weight, ties at the border included. A gram's weight is the
    number of documents times the number of items that hold it: the (text, item) pairs that it would bring together."""
    cost = np.zeros(len(items.hash), np.int64)
    for k, (hashes, value) in weight.items():
        of = items.length == k
        cost[of] = value[np.searchsorted(hashes, items.hash[of])]
    order = np.lexsort((cost, items.item))
    item, number = np.unique(items.item, return_counts=True)
    begin = np.cumsum(number) - number
    border = np.zeros(len(items.codes), np.int64)
    border[item] = cost[order][begin + np.maximum(0, np.ceil(seed_share * number).astype(np.int64) - 1)]
    return cost <= border[items.item]


def _scored(col: pa.Array, blocks: list[tuple], min_score: float, once: bool = False) -> Iterator[tuple]:
    """Per piece: (first row, last row, block, row, item, score, start word, end word) of the windows at ``min_score`` or more.
    With ``once`` a text that has been named need not be named again."""
    for lo, hi in slices(col):
        codes, number, bounds = word_codes(col.slice(lo, hi - lo))
        found = np.zeros(hi - lo, bool)
        for block, (items, tables, _) in enumerate(blocks):
            hits = list(_hits(codes, bounds, tables))
            for row, item, a, b, run in _pieces(items, hits, bounds, min_score, found):
                if not len(row):
                    continue
                score, start, end = _align_windows(items, codes, item, a, b, min_score)
                first, a, b = _joined(items, codes, item, a, b, run, score, min_score)
                if len(first):
                    more = _align_windows(items, codes, item[first], a, b, min_score)
                    score, start, end = (np.concatenate(x) for x in zip((score, start, end), more))
                    row, item = np.concatenate([row, row[first]]), np.concatenate([item, item[first]])
                good = np.flatnonzero(score >= min_score)
                if once:
                    found[row[good]] = True
                yield lo, hi, block, row[good], item[good], score[good], number[start[good]], number[end[good] - 1] + 1


def _report(seeds, min_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = seeds.value
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, block, row, item, score, start, end in _scored(text_column(batch, "text"), blocks, min_score):
                items, _, names = blocks[block]
                order = np.lexsort((start, -score, item, row))
                key = row[order] * len(items.codes) + item[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                top, windows = order[first], np.diff(np.append(first, len(order)))
                step = 1 << 16  # a class is written out as its items, a bounded number at once
                for c in range(0, len(top), step):
                    part = top[c:c + step]
                    which, at = _ranges(items.first[item[part]], items.first[item[part] + 1] - items.first[item[part]])
                    for d in range(0, len(which), step):
                        w, t = which[d:d + step], part[which[d:d + step]]
                        yield pa.RecordBatch.from_arrays([
                            ids.slice(lo, hi - lo).take(pa.array(row[t])), names.take(pa.array(items.member[at[d:d + step]])), pa.array(score[t]),
                            pa.array(start[t]), pa.array(end[t]), pa.array(windows[c + w])],
                            ["doc_id", "item_id", "score", "start_word", "end_word", "n_windows"])

    return run


def _clean(seeds, min_score: float, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = seeds.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for lo, _, _, row, *_ in _scored(text_column(batch, text_col), blocks, min_score, once=True):
                keep[lo + row] = False
            yield batch.filter(pa.array(keep))

    return run
