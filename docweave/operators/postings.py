"""Stored keyword index: postings in blocks of documents, each with its largest impact (V3).

    block, term, n, max_tf, min_len, words, docs, tfs, lens     one row for each term of a block

A document belongs to the block its id hashes to, so a changed document rewrites the buckets of
its own block only (``bucketed``) and a term with a third of all postings is many rows. A text
is tokenised when it is written and never by a question. ``max_tf`` and ``min_len``
bound what a document of the block can score for the term whatever the corpus-wide averages
are, so blocks written long ago need no upkeep when those move.

A write shuffles texts as they are, uncut, and the postings of the touched buckets packed, many terms a row; the
task that gets a bucket cuts the words and writes its rows.

A search goes through the bounds (narrow columns) twice and through the postings only
where they can matter: the best two blocks of each question are scored first, their k-th best
score is a floor, and only the asked terms' postings of blocks where a bound reaches the floor are
shuffled and scored. Questions go in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from docweave.operators.keyword import K1, WEIGHT_BYTES, B, query_weights, weight_block, words
from docweave.operators.retrieve import keep_topk
from docweave.session import spread, staged
from docweave.sources import bucketed, versioned

DOCS_A_BLOCK = 128  # at creation; blocks grow with the corpus, their number stays
BLOCKS_A_BUCKET = 8
EVERY = ""  # a term of every document, which the word pattern never gives: count and length of a block
PAIRS = 2_000_000  # (posting, question) pairs that a task holds at once
FIRST_BLOCKS = 2
OLD, GONE, TEXT = range(3)  # what a row brings to the rewriting of its block
BREAK = "\n"  # between packed terms; the word pattern never gives it
BOUNDS = ["block", "term", "n", "max_tf", "min_len", "words"]


def _schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("block", T.LongType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()),
                         T.StructField("max_tf", T.LongType()), T.StructField("min_len", T.IntegerType()), T.StructField("words", T.LongType()),
                         T.StructField("docs", T.ArrayType(id_type)), T.StructField("tfs", T.ArrayType(T.LongType())),
                         T.StructField("lens", T.ArrayType(T.IntegerType()))])


def _settings(spark: SparkSession, root: str) -> tuple[int, T.DataType] | None:
    """(number of blocks, type of ids) of an index, or None where there is none."""
    if not bucketed.exists(spark, root):
        return None
    kept = spark.read.parquet(f"{root}/settings")
    return kept.first()["n_blocks"], kept.schema["id"].dataType


def _packed(id_type: T.DataType) -> T.StructType:
    """Postings of one block on their way to the task that rewrites it: one row for many terms, which are joined by ``BREAK``."""
    ints = T.ArrayType(T.IntegerType())
    return T.StructType([T.StructField("block", T.LongType()), T.StructField("terms", T.StringType()), T.StructField("counts", ints),
                         T.StructField("docs", T.ArrayType(id_type)), T.StructField("tfs", T.ArrayType(T.LongType())), T.StructField("lens", ints)])


def _pack(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)] if len(block) else []
            rows = []
            for lo, hi in zip(cuts, cuts[1:]):
                part = batch.slice(lo, hi - lo).take(pc.sort_indices(batch.column("term").slice(lo, hi - lo)))  # like terms beside each other
                every = part.filter(pc.equal(part.column("term"), EVERY))  # the only row that has to bring lengths
                rows.append((int(block[lo]), BREAK.join(part.column("term").to_pylist()), pc.list_value_length(part.column("docs")).to_pylist(),
                             *(pc.list_flatten(x.column(c)).to_pylist() for x, c in ((part, "docs"), (part, "tfs"), (every, "lens")))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else
                                             [pa.array([], f.type) for f in schema], schema=schema)

    return run


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(block, its rows) from batches in order of their block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column("block").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)] if len(block) else []
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[0].column("block")[0].as_py() != block[lo]:
                yield held[0].column("block")[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held[0].column("block")[0].as_py(), pa.Table.from_batches(held)


def _rebuilt(schema: pa.Schema):
    """Index rows of whole blocks, from their packed rows, the ids to take out and the words of documents (in order of kind, id, text)."""
    ids_type = schema.field("docs").type.value_type

    def one(rows: pa.Table, name: str, kind: int) -> pa.Array:
        return rows.filter(pc.equal(rows.column("kind"), kind)).column(name).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _by_block(batches):
            # documents given anew: of rows with one id the last, which has the greatest text
            new, w = one(rows, "id", TEXT), one(rows, "w", TEXT)
            last = np.ones(len(new), bool)
            if len(new) > 1:
                last[:-1] = pc.not_equal(new[1:], new[:-1]).to_numpy(zero_copy_only=False)
            new, w = new.filter(pa.array(last)), w.filter(pa.array(last))
            size = pc.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int64)
            cut = pc.list_flatten(w).dictionary_encode()
            key, tf = np.unique(np.repeat(np.arange(len(new)), size) * max(1, len(cut.dictionary))
                                + cut.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            row, word = np.divmod(key, max(1, len(cut.dictionary)))

            # postings that the index has, without those of documents given anew or gone
            docs, tfs = (pc.list_flatten(one(rows, c, OLD)) for c in ("docs", "tfs"))
            terms = pa.array([t for text in one(rows, "terms", OLD).to_pylist() for t in text.split(BREAK)], pa.string())
            of = np.repeat(np.arange(len(terms)), pc.list_flatten(one(rows, "counts", OLD)).to_numpy(zero_copy_only=False))
            lens = pc.list_flatten(one(rows, "lens", OLD)).to_numpy(zero_copy_only=False)
            known = docs.filter(pa.array(np.asarray(pc.equal(terms, EVERY))[of])) if len(docs) else docs
            out = pa.concat_arrays([new, one(rows, "id", GONE)])
            stay = np.flatnonzero(~pc.is_in(docs, value_set=out).to_numpy(zero_copy_only=False))
            at = pc.index_in(docs, value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)[stay]

            # all postings: (term, id, tf, len), the new documents' after the others
            names = pa.concat_arrays([terms, cut.dictionary.cast(pa.string()), pa.array([EVERY], pa.string())]).dictionary_encode()
            number = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            t = np.concatenate([number[of[stay]], number[len(terms) + word], np.full(len(new), number[-1])])
            if not len(t):
                continue
            d = pa.concat_arrays([docs.take(pa.array(stay)), new.take(pa.array(row)), new])
            n_tf = np.concatenate([tfs.to_numpy(zero_copy_only=False)[stay], tf, np.ones(len(new), np.int64)]).astype(np.int64)
            n_len = np.concatenate([lens[at], size[row], size]).astype(np.int32)
            coded = d.dictionary_encode()
            rank = _ranks(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
            by = _ranks(names.dictionary)[t]
            order = np.lexsort((rank, by))
            begin = np.flatnonzero(np.r_[True, np.diff(by[order]) != 0])
            offsets = pa.array(np.append(begin, len(order)).astype(np.int32))
            n_tf, n_len, term = n_tf[order], n_len[order], names.dictionary.take(pa.array(t[order][begin]))
            total = np.add.reduceat(n_len.astype(np.int64), begin)
            words_in = np.where(pc.equal(term, EVERY).to_numpy(zero_copy_only=False), total, 0)  # asked of all documents only
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(begin), block)), term, pa.array(np.diff(np.append(begin, len(order)))),
                 pa.array(np.maximum.reduceat(n_tf, begin)), pa.array(np.minimum.reduceat(n_len, begin)), pa.array(words_in),
                 pa.ListArray.from_arrays(offsets, d.take(pa.array(order)).cast(ids_type)), pa.ListArray.from_arrays(offsets, pa.array(n_tf)),
                 pa.ListArray.from_arrays(offsets, pa.array(n_len))], names=schema.names)

    return run


def _ranks(values: pa.Array) -> np.ndarray:
    out = np.empty(len(values), np.int64)
    out[pc.sort_indices(values).to_numpy(zero_copy_only=False)] = np.arange(len(values))
    return out


def postings_update(spark: SparkSession, root: str, docs: DataFrame, gone: DataFrame | None = None, *, doc_id: str = "doc_id",
                    text: str = "text", docs_a_block: int = DOCS_A_BLOCK, before_commit=None) -> list[int]:
    """Write ``docs`` into the index at ``root``, created if need be, and take out the ids of ``gone``; the buckets written.

    A document that the index holds already is replaced, so a repeated call changes nothing. Null texts count as empty; rows
    without an id are left out; of several rows with one id the greatest text counts; an id both in ``docs`` and ``gone`` stays.
    """
    root, kept = root.rstrip("/"), _settings(spark, root)
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull())
    id_type = slim.schema["id"].dataType if kept is None else kept[1]
    if slim.schema["id"].dataType != id_type:
        raise ValueError(f"{root} is an index of {id_type.simpleString()} ids")
    n_blocks = kept[0] if kept else max(1, -(-slim.count() // docs_a_block))
    if kept is None:
        spark.createDataFrame([(n_blocks, None)], T.StructType([T.StructField("n_blocks", T.LongType()), T.StructField("id", id_type)])) \
            .coalesce(1).write.mode("overwrite").parquet(f"{root}/settings")
    n_buckets = bucketed.manifest(spark, root).n_buckets if kept else min(bucketed.DEFAULT_BUCKETS, -(-n_blocks // BLOCKS_A_BUCKET))
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block")
    packed = _packed(id_type)
    leave = slim.limit(0).select("id") if gone is None else gone.select(F.col(gone.columns[0]).cast(id_type).alias("id")).filter(F.col("id").isNotNull())

    def merge(old: DataFrame) -> DataFrame:
        # a task has one bucket, in order of its blocks: texts as they are, postings packed. So what it sorts does not grow with the index
        rows = spread(slim).select(block, F.lit(TEXT).alias("kind"), "id", "text")
        if kept is not None:
            rows = rows.unionByName(leave.select(block, F.lit(GONE).alias("kind"), "id"), True).unionByName(
                old.mapInArrow(_pack(to_arrow_schema(packed)), packed).withColumn("kind", F.lit(OLD)), True)
        else:
            rows = rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in packed.fields[1:]])
        bucket = versioned.bucket_expr("block", n_buckets)
        rows = rows.withColumn("bucket", bucket).repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("bucket", "block", "kind", "id", "text")
        return rows.withColumn("w", words("text")).drop("bucket", "text").mapInArrow(_rebuilt(to_arrow_schema(_schema(id_type))), _schema(id_type))

    touched = slim.select("id").unionByName(leave).select(block).distinct() if kept else spark.range(n_blocks).select(F.col("id").alias("block"))
    return bucketed.replace(spark, root, _schema(id_type), "block", merge, touched, n_buckets, before_commit, dealt=True)


class _Questions:
    """Term weights of a block of questions: CSR from term to (question, idf)."""

    def __init__(self, weights, qid: str, average: float, k1: float, b: float) -> None:
        self.ids = sorted(set(weights[qid]))
        self.terms = sorted(set(weights["term"]))
        at, term = {q: i for i, q in enumerate(self.ids)}, {t: i for i, t in enumerate(self.terms)}
        t, q = weights["term"].map(term).to_numpy(np.int64), weights[qid].map(at).to_numpy(np.int64)
        order = np.lexsort((q, t))
        self.begin = np.searchsorted(t[order], np.arange(len(self.terms) + 1))
        self.q, self.idf = q[order], weights["idf"].to_numpy(float)[order]
        self.average, self.k1, self.b = average or 1.0, k1, b

    def impact(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Grows with ``tf`` and falls with ``length``, so a block's extremes bound its documents."""
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.average))


def _ranges(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, position) of every position of the ranges ``begin .. begin + count``."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)


def _cuts(size: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``PAIRS`` in all, cut between groups only."""
    total, lo = np.cumsum(size), 0
    starts = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
    while lo < len(group):
        limit = (total[lo - 1] if lo else 0) + PAIRS
        later = starts[starts > lo]
        fits = later[total[later - 1] <= limit]
        hi = int(fits[-1] if len(fits) else later[0])
        yield lo, hi
        lo = hi


def _whole_blocks(batches: Iterator[pa.RecordBatch], v: _Questions) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, term numbers) of whole blocks, about ``PAIRS`` pairs at once, from batches in order of their block."""
    def complete() -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("block").to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(block, block[-1]))
            if held and (cut or held[-1].column("block")[0].as_py() != block[-1]):
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield pa.Table.from_batches([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield pa.Table.from_batches(held)

    vocabulary = pa.array(v.terms, pa.string())
    for table in complete():
        code = pc.index_in(table.column("term").combine_chunks(), value_set=vocabulary)
        table, code = table.filter(code.is_valid()), code.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(code):
            for lo, hi in _cuts(v.begin[code + 1] - v.begin[code], table.column("block").to_numpy()):
                yield table.slice(lo, hi - lo), code[lo:hi]


def _bounds(table: pa.Table, code: np.ndarray, v: _Questions):
    """Pairs (row, question, idf, number of its key) and the keys (block * questions + question) with their bounds."""
    which, at = _ranges(v.begin[code], v.begin[code + 1] - v.begin[code])
    most = v.impact(table.column("max_tf").to_numpy().astype(float), table.column("min_len").to_numpy().astype(float))
    key, of = np.unique(table.column("block").to_numpy()[which] * len(v.ids) + v.q[at], return_inverse=True)
    return which, v.q[at], v.idf[at], of, key, np.bincount(of, weights=most[which] * v.idf[at], minlength=len(key))


def _reach(key: np.ndarray, bound: np.ndarray, floor: np.ndarray) -> np.ndarray:
    return bound >= floor[key % len(floor)] - 1e-6  # scores are rounded to 9 places


def _first_blocks(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        q, s, block = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for table, code in _whole_blocks(batches, v):
            *_, key, bound = _bounds(table, code, v)
            q, s, block = keep_topk(np.concatenate([q, key % len(v.ids)]), np.concatenate([s, bound]),
                                    np.concatenate([block, key // len(v.ids)]), FIRST_BLOCKS)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(block), pa.array(s)], ["q", "block", "bound"])

    return run


def _needed(held, floors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        for table, code in _whole_blocks(batches, v):
            row, _, _, of, key, bound = _bounds(table, code, v)
            rows = np.unique(row[_reach(key, bound, floors.value)[of]])
            yield from table.select(["block", "term"]).take(pa.array(rows)).combine_chunks().to_batches()

    return run


def _scores(held, k: int, keys=None, floors=None):
    """Task-local top-k by exact scores: of the (block, question) pairs ``keys``, or of those whose bound reaches its floor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, id_type = held.value, None
        top_q, top_s, top_d = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        for table, code in _whole_blocks(batches, v):
            row, q, idf, of, key, bound = _bounds(table, code, v)
            wanted = np.isin(key, keys.value) if keys is not None else _reach(key, bound, floors.value)
            pick = np.flatnonzero(wanted[of])
            pick = pick[np.argsort(of[pick], kind="stable")]  # by block and question
            row, q, idf, of = row[pick], q[pick], idf[pick], of[pick]
            if not len(row):
                continue
            docs = table.column("docs").combine_chunks()
            length = pc.list_value_length(docs).to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.cumsum(length) - length
            flat = pc.list_flatten(docs).dictionary_encode()
            doc, names = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary
            tf, size = (pc.list_flatten(table.column(c).combine_chunks()).to_numpy(zero_copy_only=False).astype(float) for c in ("tfs", "lens"))
            part = v.impact(tf, size)
            for lo, hi in _cuts(length[row], of):
                which, at = _ranges(begin[row[lo:hi]], length[row[lo:hi]])
                pair, number = np.unique(q[lo:hi][which] * len(names) + doc[at], return_inverse=True)
                s = np.round(np.bincount(number, weights=part[at] * idf[lo:hi][which], minlength=len(pair)), 9)
                d = np.asarray(names.take(pa.array(pair % len(names))).to_pylist(), dtype=object)
                top_q, top_s, top_d = keep_topk(np.concatenate([top_q, pair // len(names)]), np.concatenate([top_s, s]),
                                                np.concatenate([top_d, d]), k)
            id_type = names.type
        if id_type is not None:
            yield pa.RecordBatch.from_arrays([pa.array(top_q), pa.array(list(top_d), id_type), pa.array(top_s)], ["q", "id", "score"])

    return run


def postings_topk(spark: SparkSession, root: str, queries: DataFrame, k: int = 3, *, doc_id: str = "doc_id", qid: str = "qid",
                  qtext: str = "qtext", k1: float = K1, b: float = B, max_broadcast_bytes: int = WEIGHT_BYTES) -> DataFrame:
    """``qid, doc_id, score, rank`` as ``bm25_topk`` over the indexed documents, from the stored index alone.

    Exact: a block is passed over only where its bound is below a score that ``k`` documents have. Questions
    without an id or a known word, or an index that does not exist or is empty, give no rows.
    """
    kept = _settings(spark, root)
    out = T.StructType([T.StructField(qid, queries.schema[qid].dataType), T.StructField(doc_id, kept[1] if kept else T.StringType()),
                        T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    if kept is None:
        return spark.createDataFrame([], out)
    schema = _schema(kept[1])
    table = bucketed.read(spark, root, schema)
    asked = staged(queries.filter(F.col(qid).isNotNull()).select(qid, F.explode(F.array_distinct(words(qtext))).alias("term")), "query-terms")
    terms = staged(asked.select("term").distinct().unionByName(spark.createDataFrame([(EVERY,)], "term string")), "asked-terms")
    if terms.agg(F.sum(F.octet_length("term") + 40)).first()[0] <= max_broadcast_bytes:
        terms = F.broadcast(terms)  # the index is not shuffled to find their rows
    narrow = staged(table.select(*BOUNDS).join(terms, "term", "left_semi"), "postings-bounds")
    stats = staged(narrow.groupBy("term").agg(F.sum("n").alias("df"), F.sum("words").alias("len")), "term-stats")
    weights, average, n_blocks = query_weights(asked, stats, qid, EVERY, max_broadcast_bytes)
    result = None
    for i in range(n_blocks):
        rows = weight_block(weights, qid, n_blocks, i)
        if not len(rows):
            continue
        v = _Questions(rows, qid, average, k1, b)
        part = _search(spark, root, schema, table, narrow, v, k, kept[0])
        names = spark.createDataFrame(pa.table({"q": pa.array(range(len(v.ids)), pa.int64()),
                                                qid: pa.array(v.ids, to_arrow_type(queries.schema[qid].dataType))}))
        part = part.join(F.broadcast(names), "q").select(F.col(qid), F.col("id").alias(doc_id), "score")  # the block's questions
        result = part if result is None else result.unionByName(part)
    if result is None:
        return spark.createDataFrame([], out)
    best = Window.partitionBy(qid).orderBy(F.desc("score"), F.asc(doc_id))
    return result.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _search(spark, root: str, schema: T.StructType, table: DataFrame, narrow: DataFrame, v: _Questions, k: int, all_blocks: int) -> DataFrame:
    """(q, id, score): task-local top-k of a block of questions."""
    held = spark.sparkContext.broadcast(v)
    mine = F.broadcast(spark.createDataFrame(pa.table({"term": pa.array(v.terms, pa.string())})))  # no larger than the weights
    n_buckets = bucketed.manifest(spark, root).n_buckets

    def arranged(rows: DataFrame) -> DataFrame:
        """Whole blocks in order; as many partitions as buckets, lest a task's rows grow with the index."""
        enough = n_buckets <= int(spark.conf.get("spark.sql.shuffle.partitions"))
        return (rows.repartition("block") if enough else rows.repartition(n_buckets, "block")).sortWithinPartitions("block")

    by_block = arranged(narrow)
    scored = T.StructType([T.StructField("q", T.LongType()), T.StructField("id", schema["docs"].dataType.elementType), T.StructField("score", T.DoubleType())])

    # the most promising blocks of each question: at most FIRST_BLOCKS rows a question
    promising = by_block.mapInArrow(_first_blocks(held), "q long, block long, bound double")
    order = Window.partitionBy("q").orderBy(F.desc("bound"), F.asc("block"))
    first = promising.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= FIRST_BLOCKS).select("q", "block").toPandas()
    keys = spark.sparkContext.broadcast(first["block"].to_numpy(np.int64) * len(v.ids) + first["q"].to_numpy(np.int64))
    few = spark.createDataFrame(pa.table({"block": pa.array(first["block"].unique(), pa.int64())}))
    start = arranged(table.join(mine, "term", "left_semi").join(F.broadcast(few), "block", "left_semi").select(schema.fieldNames())) \
        .mapInArrow(_scores(held, k, keys=keys), scored)
    order = Window.partitionBy("q").orderBy(F.desc("score"))
    known = start.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select("q", "score").toPandas()
    floor = np.full(len(v.ids), -np.inf)
    floor[known["q"].to_numpy(np.int64)] = known["score"].to_numpy(float)
    floors = spark.sparkContext.broadcast(floor)

    # postings that can matter: the asked terms' in the blocks that reach a floor, from the files of their buckets only
    needed = staged(by_block.mapInArrow(_needed(held, floors), "block long, term string").select("block").distinct(), "blocks-needed")
    only = [r[0] for r in needed.select(F.pmod(F.xxhash64("block"), F.lit(n_buckets)).cast("int")).distinct().collect()]
    needed = F.broadcast(needed) if all_blocks * 8 <= WEIGHT_BYTES else needed
    rows = bucketed.read(spark, root, schema, only).join(mine, "term", "left_semi").join(needed, "block", "left_semi")
    return arranged(rows.select(schema.fieldNames())).mapInArrow(_scores(held, k, floors=floors), scored)
