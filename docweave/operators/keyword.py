"""Keyword search: BM25 top-k over the searchable text fields (V3).

The asked terms are numbered, and one pass cuts the documents' words and keeps, for each document,
its length and the numbers and counts of the asked terms it holds; no word is shuffled.
Document frequencies, the document count and the total length are counted from these numbers.

Scoring never joins postings with queries (a common term would pair every document with every
query): the queries are cut into blocks of bounded size, a block's terms are broadcast, and each
task scores its own documents against the block (``mapInArrow``) in tiles of bounded size. In a
tile most terms are summed over their postings, and the few that meet most pairs only where their
largest weights could lift the sum to the question's floor: a score that ``k`` documents are known to
have, at first from documents chosen by a hash of their id, then from what the task has seen. For a
question with many such pairs this is one matrix product in single precision, which leaves few.
What is left is scored exactly, in double precision. So bounds and floors pass over pairs
that cannot be among the best and change no result. Each task keeps a local top-k per query; a
final ``row_number() <= k`` merges the task results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docweave.session import spread, staged

# BM25 parameters and the word pattern.
K1 = 1.2
B = 0.75
WORD_PATTERN = r"[\p{L}\p{N}]+"
WEIGHT_BYTES = 16 * 1024 * 1024  # term weights of a block of queries, as the driver holds them before they are broadcast
VOCABULARY_BYTES = 32 * 1024 * 1024  # asked terms that are numbered at once
EVERY = -1  # stands for all documents among the numbered terms
FLOOR_DOCS = 8192  # documents that the first floors come from
TILE_DOCS, TILE_CELLS = 2048, 1 << 18  # documents and (document x query) cells of one tile
COMMON_TERMS, COMMON_CELLS = 64, 8_000_000  # terms not summed over their postings, at most; (query x term) cells of these
COMMON_SHARE = 1e-3  # share of all pairs that such a term has to meet
SLACK = 1e-4  # of a sum in single precision, of at most COMMON_TERMS positive terms
MANY, EACH = 0.1, 16  # share of a question's pairs from which the product is made, as seen at every 16th document
EXACT_PAIRS = 1 << 17  # pairs scored exactly at once


def words(text: Column | str) -> Column:
    """Lower-cased letter/digit runs."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(F.lower(t), F.lit(WORD_PATTERN), 0), F.array().cast("array<string>"))


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 3, *, doc_id: str = "doc_id", text: str = "text",
              qid: str = "qid", qtext: str = "qtext", k1: float = K1, b: float = B,
              max_broadcast_bytes: int = WEIGHT_BYTES) -> DataFrame:
    """``qid, doc_id, score, rank`` for the ``k`` best documents of each query.

    ``max_broadcast_bytes`` bounds the term weights of a block of queries, of which the driver
    holds one at a time; the documents' words are cut once, and their numbered terms are
    scanned once for statistics and once for each block.
    """
    spark = docs.sparkSession
    qt = staged(queries.select(qid, F.explode(F.array_distinct(words(qtext))).alias("term")), "query-terms")
    coded, numbers, n_terms = _numbered(docs, qt, doc_id, text)
    counts = coded.select("_len", "_terms").mapInArrow(_term_counts(n_terms), "term int, df long, len long")
    st = staged(counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("len").alias("len")), "term-stats")
    asked = qt.join(numbers, "term").select(qid, F.col("number").alias("term"))
    weights, avgdl, n_blocks = query_weights(asked, st, qid, EVERY, max_broadcast_bytes)
    first = _floor_docs(coded, st, doc_id)
    schema = T.StructType([T.StructField(qid, queries.schema[qid].dataType), T.StructField(doc_id, docs.schema[doc_id].dataType),
                           T.StructField("score", T.DoubleType())])
    out = None
    for block in range(n_blocks):
        pw = weight_block(weights, qid, n_blocks, block)
        if not len(pw):
            continue
        v = _Questions(pw, qid, to_arrow_type(schema[0].dataType), n_terms, avgdl, k1, b)
        held = spark.sparkContext.broadcast(v)
        floors = spark.sparkContext.broadcast(_floors(first, held, len(v), k))
        part = coded.mapInArrow(_scores(held, k, schema.fieldNames(), floors), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    w = Window.partitionBy(qid).orderBy(F.desc("score"), F.asc(doc_id))
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def query_weights(qt: DataFrame, stats: DataFrame, qid: str, every, max_bytes: int) -> tuple[DataFrame, float, int]:
    """Staged (qid, term, idf) of the known terms, the average length, and in how many blocks the weights are to be broadcast.

    ``stats`` holds (term, df, len); the term ``every`` stands for all documents and their total length.
    """
    total = stats.filter(F.col("term") == every).first()
    n_docs = int(total["df"]) if total else 0
    avgdl = float(total["len"]) / n_docs if n_docs else 0.0
    idf = F.log(F.lit(1.0) + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = staged(qt.join(stats.select("term", "df"), "term").select(qid, "term", idf.alias("idf")), "query-weights")
    each = F.octet_length("term") + 40 if isinstance(stats.schema["term"].dataType, T.StringType) else F.lit(32)
    size = weights.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0]
    return weights, avgdl, max(1, -(-size // max_bytes))


def weight_block(weights: DataFrame, qid: str, n_blocks: int, block: int):
    """One block of the weights on the driver; equal strings are held once."""
    return weights.filter(F.pmod(F.xxhash64(qid), F.lit(n_blocks)) == block).toArrow().to_pandas()


# --- numbered terms ------------------------------------------------------------------------

def _numbered(docs: DataFrame, qt: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, int]:
    """(documents as id, length, numbers and counts of the asked terms they hold; term and number of each asked term; how many).

    The asked terms go to the tasks in pieces of about ``VOCABULARY_BYTES``; where there are several, the words are cut once and kept.
    """
    spark = docs.sparkSession
    asked = staged(qt.select("term").distinct(), "asked-terms")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 8), F.lit(0))).first()[0]
    pieces = max(1, -(-size // VOCABULARY_BYTES))
    ints = T.ArrayType(T.IntegerType())
    plain = [T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("_len", T.IntegerType()), T.StructField("_terms", ints), T.StructField("_tfs", ints)]
    cut = [T.StructField("_w", T.ArrayType(T.StringType()))]
    d, numbers, n = spread(docs.select(doc_id, text)).select(doc_id, words(text).alias("_w")), None, 0
    for piece in range(pieces):
        mine = asked.filter(F.pmod(F.xxhash64("term"), F.lit(pieces)) == piece)
        terms = mine.toArrow().column("term").combine_chunks().cast(pa.string())
        held = spark.sparkContext.broadcast(terms)
        number = mine.mapInArrow(_numbers(held, n), "term string, number int")
        numbers = number if numbers is None else numbers.unionByName(number)
        schema = T.StructType(plain + (cut if piece + 1 < pieces else []))
        d = staged(d.mapInArrow(_terms_of(held, n, schema.fieldNames()), schema), "document-terms")
        n += len(terms)
    return d, staged(numbers, "asked-numbers"), n


def _numbers(held, first: int):
    def run(batches):
        for batch in batches:
            at = pc.index_in(batch.column(0).cast(pa.string()), value_set=held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.add(at, pa.scalar(first, pa.int32()))], ["term", "number"])

    return run


def _terms_of(held, first: int, columns: list[str]):
    """Numbers and counts of the terms ``held`` in each document, after those it has of earlier terms."""
    def run(batches):
        vocabulary = held.value
        for batch in batches:
            n, w = batch.num_rows, batch.column("_w")
            lens = pc.fill_null(pc.list_value_length(w), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            code = pc.index_in(pc.list_flatten(w).cast(pa.string()), value_set=vocabulary)
            keep = code.is_valid().to_numpy(zero_copy_only=False)
            key = np.repeat(np.arange(n), lens)[keep] * max(1, len(vocabulary)) + code.drop_null().to_numpy(zero_copy_only=False)
            key, tf = np.unique(key, return_counts=True)
            row, term = np.divmod(key, max(1, len(vocabulary)))
            term = term + first
            if "_terms" in batch.schema.names:
                row, term, tf = (np.concatenate(x) for x in zip(_pairs_of(batch), (row, term, tf)))
                order = np.argsort(row, kind="stable")
                row, term, tf = row[order], term[order], tf[order]
            offsets = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
            made = {"_len": pa.array(lens.astype(np.int32)), "_terms": pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))),
                    "_tfs": pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in columns], columns)

    return run


def _pairs_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of every term of the documents of a batch."""
    size = pc.list_value_length(batch.column("_terms")).to_numpy(zero_copy_only=False)
    return (np.repeat(np.arange(batch.num_rows), size), *(pc.list_flatten(batch.column(c)).to_numpy(zero_copy_only=False) for c in ("_terms", "_tfs")))


def _term_counts(n_terms: int):
    def run(batches):
        df, n, total = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(pc.list_flatten(batch.column("_terms")).to_numpy(zero_copy_only=False), minlength=n_terms)
            n, total = n + batch.num_rows, total + (pc.sum(batch.column("_len")).as_py() or 0)
        if n:
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, EVERY).astype(np.int32)), pa.array(np.append(df[some], n)),
                                              pa.array([None] * len(some) + [total], pa.int64())], ["term", "df", "len"])

    return run


# --- scoring -------------------------------------------------------------------------------

class _Questions:
    """Terms of a block of questions, on the driver and broadcast: CSR from question to term."""

    def __init__(self, weights, qid: str, qid_type: pa.DataType, n_terms: int, avgdl: float, k1: float, b: float) -> None:
        coded = pa.array(weights[qid], qid_type, from_pandas=True).dictionary_encode(null_encoding="encode")
        self.names, q = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.numbers, t = np.unique(weights["term"].to_numpy(np.int64), return_inverse=True)
        self.idf = np.zeros(len(self.numbers))
        self.idf[t] = weights["idf"].to_numpy(float)
        order = np.lexsort((t, q))
        self.q, self.t = q[order].astype(np.int32), t[order].astype(np.int32)
        self.n_terms, self.average, self.k1, self.b = n_terms, avgdl if avgdl > 0 else 1.0, k1, b

    def __len__(self) -> int:
        return len(self.names)

    def prepare(self) -> None:
        """Set the terms that meet most pairs apart from those summed over their postings."""
        met = np.bincount(self.t, minlength=len(self.idf)) / len(self) * np.exp(-self.idf)  # of the documents, exp(-idf) have the term
        most = np.argsort(-met, kind="stable")[:max(1, min(COMMON_TERMS, COMMON_CELLS // len(self)))]
        most = most[met[most] > COMMON_SHARE]
        self.place = np.full(len(self.idf), -1)
        self.place[most] = np.arange(len(most))
        self.local = np.full(self.n_terms, -1)
        self.local[self.numbers] = np.arange(len(self.numbers))
        place = self.place[self.t]
        common, rare = place >= 0, place < 0
        self.asks = np.zeros((len(self), len(most)), np.float32)
        np.add.at(self.asks, (self.q[common], place[common]), 1)
        every = np.arange(len(self) + 1)
        self.common, self.common_at = place[common], np.searchsorted(self.q[common], every)
        self.rare, self.rare_q, self.rare_at = self.t[rare], self.q[rare].astype(np.int64), np.searchsorted(self.q[rare], every)


def _positions(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Every position of the ranges ``begin .. begin + count``."""
    out = np.repeat(begin - (np.cumsum(count) - count), count)
    out += np.arange(len(out))
    return out


class _Tile:
    """Some documents' weights for the terms of a block of questions."""

    def __init__(self, v: _Questions, row: np.ndarray, term: np.ndarray, tf: np.ndarray, lens: np.ndarray) -> None:
        self.v, self.n = v, len(lens)
        t = v.local[term]
        row, t, tf = row[t >= 0], t[t >= 0], tf[t >= 0]
        weight = v.idf[t] * (tf * (v.k1 + 1) / (tf + v.k1 * (1 - v.b + v.b * lens[row] / v.average)))
        common = v.place[t] >= 0
        self.matrix = np.zeros((v.asks.shape[1], self.n))
        self.matrix[v.place[t[common]], row[common]] = weight[common]
        self.single = self.matrix.astype(np.float32)
        self.most = v.asks @ self.single.max(axis=1, initial=0) * (1 + SLACK)  # that the common terms can add for each question
        row, t, weight = row[~common], t[~common], weight[~common]
        order = np.argsort(t * self.n + row)
        self.docs, self.weights = row[order], weight[order]
        self.count = np.bincount(t, minlength=len(v.idf))
        self.begin = np.cumsum(self.count) - self.count

    def sums(self, lo: int, hi: int) -> np.ndarray:
        """Of questions lo..hi and all documents: the part of the scores that the postings give."""
        v, edges = self.v, slice(self.v.rare_at[lo], self.v.rare_at[hi])
        count = self.count[v.rare[edges]]
        some = np.flatnonzero(count)
        count, t, q = count[some], v.rare[edges][some], v.rare_q[edges][some] - lo
        at = _positions(self.begin[t], count)
        key = np.repeat(q * self.n, count)
        key += self.docs[at]
        return np.bincount(key, weights=self.weights[at], minlength=(hi - lo) * self.n).reshape(hi - lo, self.n)

    def nearly(self, q: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Scores of questions and all documents in single precision, given the postings' part."""
        out = self.v.asks[q] @ self.single
        out += part
        return out

    def exact(self, q: np.ndarray, doc: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Scores of (question, document) pairs, given their postings' part."""
        begin = self.v.common_at[q]
        count = self.v.common_at[q + 1] - begin
        which, at = np.repeat(np.arange(len(q)), count), _positions(begin, count)
        rest = np.bincount(which, weights=self.matrix[self.v.common[at], doc[which]], minlength=len(q))
        return np.round(part + rest, 9)  # rounding makes equal documents tie exactly, whatever the summation order


def _candidates(tile: _Tile, floor: np.ndarray, k: int):
    """(question, document, score) of the pairs that can be among the ``k`` best, given the floors of the questions."""
    step = max(1, TILE_CELLS // tile.n)
    for lo in range(0, len(floor), step):
        hi = min(lo + step, len(floor))
        part = tile.sums(lo, hi)
        limit = np.maximum(floor[lo:hi] * (1 - SLACK), 1e-10)
        lift = limit - tile.most[lo:hi]  # what the postings have to give
        many = np.flatnonzero((floor[lo:hi] <= 0) | ((part[:, ::EACH] >= lift[:, None]).mean(axis=1) > MANY))
        if len(many):
            about = tile.nearly(lo + many, part[many])
            if tile.n > k:  # without a floor: the tile's own k-th best
                blank = np.flatnonzero(floor[lo + many] <= 0)
                kth = np.partition(about[blank], tile.n - k, axis=1)[:, tile.n - k] if len(blank) else limit[:0]
                limit[many[blank]] = np.maximum(limit[many[blank]], kth * (1 - SLACK))
            row, col = np.divmod(np.flatnonzero(about >= limit[many].astype(np.float32)[:, None]), tile.n)
            yield from _exact(tile, lo, many[row], col, part, floor)
            lift[many] = np.inf
        yield from _exact(tile, lo, *np.divmod(np.flatnonzero(part >= lift[:, None]), tile.n), part, floor)


def _exact(tile: _Tile, lo: int, row: np.ndarray, col: np.ndarray, part: np.ndarray, floor: np.ndarray):
    for at in range(0, len(row), EXACT_PAIRS):
        q, doc = row[at:at + EXACT_PAIRS], col[at:at + EXACT_PAIRS]
        s = tile.exact(q + lo, doc, part[q, doc])
        good = (s > 0) & (s >= floor[q + lo])
        yield q[good] + lo, doc[good], s[good]


def _in_order(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of the ids, nulls first."""
    if pa.types.is_integer(ids.type) and not ids.null_count:
        return ids.to_numpy(zero_copy_only=False)
    coded = ids.dictionary_encode(null_encoding="encode")
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.array_sort_indices(coded.dictionary, null_placement="at_start").to_numpy(zero_copy_only=False)] = np.arange(len(rank))
    return rank[coded.indices.to_numpy(zero_copy_only=False)]


class _Best:
    """Running top-k of every question, and the floors that follow from it."""

    def __init__(self, floor: np.ndarray, k: int, id_type: pa.DataType) -> None:
        self.floor, self.k = floor.copy(), k
        self.q, self.s, self.ids = np.zeros(0, np.int64), np.zeros(0), pa.array([], id_type)

    def add(self, q: np.ndarray, s: np.ndarray, ids: pa.Array) -> None:
        q, s, ids = np.concatenate([self.q, q]), np.concatenate([self.s, s]), pa.concat_arrays([self.ids, ids])
        order = np.lexsort((_in_order(ids), -s, q))
        first = np.r_[True, q[order][1:] != q[order][:-1]] if len(order) else np.zeros(0, bool)
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        last = order[place == self.k - 1]
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        order = order[place < self.k]
        self.q, self.s, self.ids = q[order], s[order], ids.take(pa.array(order))


def _scores(held, k: int, columns: list[str], floors=None):
    """Task-local top-k of a block of questions: (question, document, score); without floors the question by its number."""
    def run(batches):
        v, best = held.value, None
        v.prepare()
        for batch in batches:
            ids = batch.column(0)
            if best is None:
                best = _Best(floors.value if floors is not None else np.zeros(len(v)), k, ids.type)
            lens = batch.column("_len").to_numpy(zero_copy_only=False)
            row, term, tf = _pairs_of(batch)
            cuts = np.searchsorted(row, np.arange(0, batch.num_rows + TILE_DOCS, TILE_DOCS))
            for i, (a, z) in enumerate(zip(cuts, cuts[1:])):
                lo = i * TILE_DOCS
                if a == z:
                    continue
                tile = _Tile(v, row[a:z] - lo, term[a:z], tf[a:z], lens[lo:lo + TILE_DOCS])
                found = list(_candidates(tile, best.floor, k))
                if found:
                    q, doc, s = (np.concatenate(x) for x in zip(*found))
                    best.add(q, s, ids.take(pa.array(lo + doc)))
        if best is not None:
            asked = pa.array(best.q) if floors is None else v.names.take(pa.array(best.q))
            yield pa.RecordBatch.from_arrays([asked, best.ids, pa.array(best.s)], columns)

    return run


def _floor_docs(coded: DataFrame, stats: DataFrame, doc_id: str) -> DataFrame | None:
    """About ``FLOOR_DOCS`` documents, chosen by a hash of their id; None where a task's own floors do."""
    total = stats.filter(F.col("term") == EVERY).first()
    ways = int(total["df"]) // FLOOR_DOCS if total else 0
    if ways < 4:
        return None
    some = coded.filter(F.pmod(F.xxhash64(doc_id), F.lit(ways)) == 0)
    return staged(some.repartition(coded.sparkSession.sparkContext.defaultParallelism), "floor-documents")


def _floors(first: DataFrame | None, held, n: int, k: int) -> np.ndarray:
    """A score that ``k`` documents reach, for each of the ``n`` questions of a block; 0 where none is known."""
    floor = np.zeros(n)
    if first is not None:
        schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("id", first.schema[0].dataType), T.StructField("score", T.DoubleType())])
        local = first.mapInArrow(_scores(held, k, schema.fieldNames()), schema).select("q", "score")
        order = Window.partitionBy("q").orderBy(F.desc("score"))
        known = local.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select("q", "score").toArrow()
        floor[known.column("q").to_numpy()] = known.column("score").to_numpy()
    return floor
