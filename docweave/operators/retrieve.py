"""Retrieval: exact vector top-k, IVF approximate top-k, hits.

Exact top-k never materialises question x chunk pairs as rows. The index stays where it
is: a block of questions of proven size is broadcast, and each task scores it against the
rows it holds, tile by tile (at most ``TILE_Q`` x ``TILE_I`` scores at a time), keeping
only its top-k per question; a final ``row_number() <= k`` (planned as a partial + final
``WindowGroupLimit``) picks the global top-k. Questions beyond one block take further
passes over the index, one for each block; index rows are never shuffled.

The approximate form stores the index cut by list (``ivf_write``) and reads only the lists
that the questions of a block probe.

Ties are broken by the smaller id, so results are deterministic.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.session import staged

DEFAULT_K = 3  # fixed value: retrieval depth per question
MAX_BROADCAST_BYTES = 256 * 1024 * 1024


# --- scoring kernel (runs inside tasks) --------------------------------------------------

def _matrix(vectors) -> np.ndarray:
    if len(vectors) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _prepare(mat: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine" and mat.size:
        norms = np.linalg.norm(mat, axis=1, keepdims=True)
        norms[norms == 0] = 1.0
        return mat / norms
    return mat


TILE_Q, TILE_I = 1024, 4096  # scores of one tile: 32 MiB


def keep_topk(q: np.ndarray, s: np.ndarray, d: np.ndarray, k: int):
    """Rows of the ``k`` best (score desc, id asc) candidates of every question."""
    if not len(q):
        return q, s, d
    order = np.lexsort((d, -s, q))
    q, s, d = q[order], s[order], d[order]
    first = np.r_[True, q[1:] != q[:-1]]
    group_start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    keep = (np.arange(len(q)) - group_start) < k
    return q[keep], s[keep], d[keep]


class _TopK:
    """Running top-k per question over a stream of index batches, in tiles of bounded size."""

    def __init__(self, n_questions: int, k: int):
        self.k = k
        tiles = max(1, -(-n_questions // TILE_Q))
        self.best = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, dtype=object)) for _ in range(tiles)]

    def scores(self, questions: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return questions @ rows.T

    def add(self, ids: np.ndarray, mat: np.ndarray, qmat: np.ndarray, which: np.ndarray | None = None) -> None:
        """Score index rows against the questions ``which`` (all, if left out)."""
        which = np.arange(len(qmat)) if which is None else which
        for t in range(len(self.best)):
            mine = which[(which >= t * TILE_Q) & (which < (t + 1) * TILE_Q)]
            if not len(mine):
                continue
            for lo in range(0, len(ids), TILE_I):
                part = ids[lo:lo + TILE_I]
                s = self.scores(qmat[mine], mat[lo:lo + TILE_I])
                kk = min(self.k, len(part))
                kth = np.partition(s, len(part) - kk, axis=1)[:, len(part) - kk]
                cq, ci = np.nonzero(s >= kth[:, None])
                old = self.best[t]
                self.best[t] = keep_topk(np.concatenate([old[0], mine[cq]]), np.concatenate([old[1], s[cq, ci]]),
                                         np.concatenate([old[2], part[ci]]), self.k)

    def frames(self, qids: list, columns: list[str]):
        for q, s, d in self.best:
            if len(q):
                yield pd.DataFrame({columns[0]: [qids[i] for i in q], columns[1]: list(d), columns[2]: s})


def exact_score(a: str, b: str, metric: str) -> Column:
    """Inner product, or cosine (0 for a zero vector), of two vector columns in doubles."""
    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)

    if metric == "dot":
        return dot(a, b)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(F.try_divide(dot(a, b), norms))


def _final_topk(local: DataFrame, qid: str, id_col: str, k: int) -> DataFrame:
    w = Window.partitionBy(qid).orderBy(F.desc("score"), F.asc(id_col))
    return local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# --- exact top-k (V1, J8) ------------------------------------------------------------------

def vector_topk(index: DataFrame, questions: DataFrame, k: int = DEFAULT_K, *, id_col: str = "id",
                vec_col: str = "vector", qid: str = "question_id", qvec: str = "qvec",
                metric: str = "cosine", where: Column | None = None,
                max_broadcast_bytes: int = MAX_BROADCAST_BYTES, blocks: int | None = None) -> DataFrame:
    """The ``k`` index rows nearest to each question: ``qid, id, score, rank``.

    ``where`` is an index filter applied before ranking (P6). ``blocks`` fixes the number of
    question blocks; by default it follows from the questions' size and ``max_broadcast_bytes``.
    """
    if metric not in ("cosine", "dot"):
        raise ValueError("metric must be 'cosine' or 'dot'")
    idx = (index if where is None else index.filter(where)).select(id_col, vec_col)
    local = None
    for qids, qmat in _question_blocks(questions.select(qid, qvec), qid, qvec, metric, max_broadcast_bytes, blocks):
        part = _scan(idx, qids, qmat, k, id_col, vec_col, qid, questions.schema[qid].dataType, metric)
        local = part if local is None else local.unionByName(part)
    return _final_topk(local, qid, id_col, k)


WIDEST = 4096  # vectors wider than this are split into blocks by their measured size only


def _question_blocks(qs: DataFrame, qid: str, qvec: str, metric: str, max_bytes: int, blocks: int | None):
    """(ids, matrix) of the questions, in blocks of about ``max_bytes``; the questions are evaluated once."""
    few = max(1, max_bytes // (8 * WIDEST))
    if blocks is None:
        head = qs.limit(few + 1).toPandas()
        if len(head) <= few:
            yield head[qid].tolist(), _prepare(_matrix(head[qvec].tolist()), metric)
            return
    qs = staged(qs, "questions")
    n, width = qs.agg(F.count(F.lit(1)), F.max(F.size(qvec))).first()
    n_blocks = blocks or max(1, math.ceil(n * max(width or 1, 1) * 8 / max_bytes))
    for b in range(min(n_blocks, max(n, 1))):
        part = qs.filter(F.pmod(F.xxhash64(qid), F.lit(n_blocks)) == b).toPandas()
        yield part[qid].tolist(), _prepare(_matrix(part[qvec].tolist()), metric)


def _scan(idx, qids, qmat, k, id_col, vec_col, qid, qid_type, metric, probes=None) -> DataFrame:
    """Task-local top-k of one question block. ``probes``: list id -> questions that probe it (rows carry list_id)."""
    bc = idx.sparkSession.sparkContext.broadcast((qids, qmat, probes))
    schema = T.StructType([T.StructField(qid, qid_type), T.StructField(id_col, idx.schema[id_col].dataType),
                           T.StructField("score", T.DoubleType())])

    def run(batches):
        qids, qmat, probes = bc.value
        top = _TopK(len(qids), k)
        for pdf in batches:
            if not len(pdf) or not len(qids):
                continue
            ids = np.asarray(pdf[id_col].tolist(), dtype=object)
            mat = _prepare(_matrix(pdf[vec_col].tolist()), metric)
            if probes is None:
                top.add(ids, mat, qmat)
                continue
            lists = pdf["list_id"].to_numpy()
            for one in np.unique(lists):
                rows = np.flatnonzero(lists == one)
                if one in probes:
                    top.add(ids[rows], mat[rows], qmat, probes[one])
        yield from top.frames(qids, [qid, id_col, "score"])

    return idx.mapInPandas(run, schema)


# --- approximate top-k: IVF on Spark (V2) --------------------------------------------------

TRAIN_ROWS = 20_000  # index rows that the centroids are fitted on, at most


def ivf_train(index: DataFrame, n_lists: int = 16, vec_col: str = "vector", seed: int = 7,
              max_iter: int = 10, metric: str = "cosine", train_rows: int = TRAIN_ROWS) -> list[np.ndarray]:
    """k-means centroids of the (normalised) index vectors, fitted on a bounded sample of ``train_rows`` rows.

    The sample is chosen by a hash of the vector; every row is assigned to a list afterwards.
    """
    n = index.count()
    ways = max(1, -(-n // train_rows))
    rows = index.select(vec_col).filter(F.pmod(F.xxhash64(vec_col), F.lit(ways)) == 0).toPandas()[vec_col].tolist()
    data = _prepare(_matrix(sorted(map(tuple, rows))), metric)
    if not len(data):
        raise ValueError("no vectors to train on")
    rng = np.random.default_rng(seed)
    centers = data[rng.choice(len(data), 1)]
    while len(centers) < min(n_lists, len(data)):  # far points first, so that no list starts inside another
        far = np.min(((data ** 2).sum(1)[:, None] - 2 * data @ centers.T + (centers ** 2).sum(1)), axis=1).clip(0)
        centers = np.vstack([centers, data[rng.choice(len(data), p=far / far.sum()) if far.sum() else rng.integers(len(data))]])
    for _ in range(max_iter):
        of = np.argmax(data @ centers.T - (centers ** 2).sum(1) / 2, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, of, data)
        count = np.bincount(of, minlength=len(centers))[:, None]
        centers = np.where(count > 0, sums / np.maximum(count, 1), centers)
    return list(centers)


def ivf_assign(df: DataFrame, centroids: list[np.ndarray], vec_col: str, nprobe: int = 1,
               out_col: str = "list_id", metric: str = "cosine") -> DataFrame:
    """The ``nprobe`` nearest lists of each row (``nprobe = 1`` for index rows)."""
    spark = df.sparkSession
    cmat = _prepare(np.stack(centroids), metric)
    bc = spark.sparkContext.broadcast(cmat)  # n_lists x dim, bounded by the parameter
    probe = min(nprobe, len(centroids))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def nearest(vecs: pd.Series) -> pd.Series:
        c = bc.value
        m = _prepare(_matrix(vecs.tolist()), metric)
        if m.size == 0:
            return pd.Series([[] for _ in range(len(vecs))])
        s = m @ c.T
        order = np.argsort(-s, axis=1, kind="stable")[:, :probe]
        return pd.Series([row.astype(int).tolist() for row in order])

    return df.withColumn(out_col, F.explode(nearest(F.col(vec_col))))


def ivf_write(index: DataFrame, centroids: list[np.ndarray], path: str, *, id_col: str = "id", vec_col: str = "vector",
              metric: str = "cosine", keep: tuple[str, ...] = ()) -> None:
    """Store the index cut by list: one folder ``list_id=<l>`` each, large lists in many files (rebalanced by size)."""
    rows = ivf_assign(index.select(id_col, vec_col, *keep), centroids, vec_col, 1, "list_id", metric)
    rows.hint("rebalance", F.col("list_id")).write.partitionBy("list_id").parquet(path)


def ivf_search(spark, path: str, centroids: list[np.ndarray], questions: DataFrame, k: int = DEFAULT_K, nprobe: int = 4, *,
               id_col: str = "id", vec_col: str = "vector", qid: str = "question_id", qvec: str = "qvec", metric: str = "cosine",
               max_broadcast_bytes: int = MAX_BROADCAST_BYTES, blocks: int | None = None) -> DataFrame:
    """Top-k from the stored lists: each block of questions reads the lists that it probes, re-ranking exactly inside them.

    A list that holds a third of the index is many file splits, so many tasks; index rows
    are not shuffled. At ``nprobe = n_lists`` the result equals the exact top-k.
    """
    stored = spark.read.parquet(path)
    stored = stored.select(id_col, vec_col, F.col("list_id").cast("int").alias("list_id"))
    cmat, local = _prepare(np.stack(centroids), metric), None
    for qids, qmat in _question_blocks(questions.select(qid, qvec), qid, qvec, metric, max_broadcast_bytes, blocks):
        near = np.argsort(-(qmat @ cmat.T), axis=1, kind="stable")[:, :nprobe] if len(qids) else np.zeros((0, 1), int)
        probes = {int(one): np.flatnonzero((near == one).any(axis=1)) for one in np.unique(near)}
        part = _scan(stored.filter(F.col("list_id").isin(list(probes)) if probes else F.lit(False)),  # prunes the folders
                     qids, qmat, k, id_col, vec_col, qid, questions.schema[qid].dataType, metric, probes)
        local = part if local is None else local.unionByName(part)
    return _final_topk(local, qid, id_col, k)


# --- hits (P4, P5, A13, A14, V5) -------------------------------------------------------------

HIT_FIELDS = ("title", "content", "url")


def hit_projection(topk: DataFrame, index: DataFrame, qid: str = "question_id", id_col: str = "id") -> DataFrame:
    """Join the ranked ids back to their fields; a missing field becomes ``''``."""
    fields = index.select(id_col, *[F.col(f) for f in HIT_FIELDS if f in index.columns])
    j = topk.join(fields, id_col, "left")
    return j.select(qid, "rank", "score", id_col,
                    *[F.coalesce(F.col(f), F.lit("")).alias(f) if f in fields.columns else F.lit("").alias(f)
                      for f in HIT_FIELDS])


def answer_fields(questions: DataFrame, hits: DataFrame, qid: str = "question_id") -> DataFrame:
    """Per question, in one aggregation over the hits: hit count (A13), the sources line
    (A16, ``none`` when empty) and the context block (F7); questions without hits keep 0.

    One pass keeps the (expensive) top-k plan from being evaluated once per output.
    """
    item = F.struct("rank", "title", "content")
    g = hits.groupBy(qid).agg(F.count(F.lit(1)).alias("n_hits"), F.array_sort(F.collect_list(item)).alias("_h"))
    g = g.select(qid, "n_hits",
                 F.array_join(F.transform("_h", lambda x: x["title"]), ", ").alias("sources_text"),
                 F.array_join(F.transform("_h", lambda x: F.concat(F.lit("["), x["title"], F.lit("]\n"), x["content"])),
                              "\n\n").alias("context"))
    out = questions.select(qid).join(g, qid, "left")
    return out.select(qid, F.coalesce("n_hits", F.lit(0)).cast("bigint").alias("n_hits"),
                      F.coalesce(F.nullif("sources_text", F.lit("")), F.lit("none")).alias("sources_text"),
                      F.coalesce("context", F.lit("")).alias("context"))


def empty_hits(spark, qid_type: T.DataType = T.StringType(), id_type: T.DataType = T.StringType()) -> DataFrame:
    """Hits of a missing index: no rows, the hits schema (P5)."""
    schema = T.StructType([
        T.StructField("question_id", qid_type), T.StructField("rank", T.IntegerType()),
        T.StructField("score", T.DoubleType()), T.StructField("id", id_type),
        T.StructField("title", T.StringType()), T.StructField("content", T.StringType()),
        T.StructField("url", T.StringType())])
    return spark.createDataFrame([], schema)


def hit_counts(questions: DataFrame, hits: DataFrame, qid: str = "question_id") -> DataFrame:
    """Hits per question, zero for questions without any."""
    c = hits.groupBy(qid).agg(F.count(F.lit(1)).alias("n_hits"))
    return questions.select(qid).join(c, qid, "left").select(qid, F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


def facet_counts(index: DataFrame, facet: str = "source", where: Column | None = None) -> DataFrame:
    """Rows per facet value over the (filtered) index."""
    idx = index if where is None else index.filter(where)
    return idx.groupBy(facet).agg(F.count(F.lit(1)).alias("count"))


def sort_by_updated(index: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first by ``updated_at``, ties by id (V5)."""
    out = index.orderBy(F.desc("updated_at"), "id")
    return out.limit(limit) if limit else out
