"""Exact top-k by inner product in three phases with a uniform threshold (operator 12).

A score is the sum of partial scores over ``lists`` groups of dimensions; every task holds
these lists for its rows, in tiles of bounded size.

1. Gather: from each of its lists a task takes the k greatest partial scores of each query;
   the totals of these entries leave, k at most for a query and task. The k-th greatest of
   all tasks' totals is a safe cutoff: at least k rows reach it.
2. Collect: the cutoff goes back to all tasks. A row that reaches it has a partial score of at
   least cutoff / lists in one list, so the entries at or above that uniform threshold are
   sufficient; entries whose upper bound (known part, and less than the threshold for each
   list where the row was not collected) misses the cutoff are let go.
3. Resolve: the missing partial scores of what is left are looked up in the task's lists, and
   rows at or above the cutoff leave, k at most for a query and task.

Queries go in blocks of bounded size, so what is broadcast and the totals that come back for a
block do not grow with the data; rows are not shuffled, and no pairs leave a task but those of
the gathered lists and the final candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.storage import staged

BLOCK_BYTES = 16 << 20  # integer vectors of a block of queries
TILE_ROWS, TILE_QUERIES = 4096, 512
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, ints): floor(scale * x) of every component, at the limits of a long where it would pass them; rows whose vector
    is null or holds a null, a NaN or an infinite component are left out."""
    inf = F.lit(float("inf"))
    fit = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")) \
        .where(fit).select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("ints"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as int64, cut or filled with zeros to ``width`` components."""
    column = column.cast(pa.large_list(pa.int64()))
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    row, at = np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[row[at < width], at[at < width]] = flat[at < width]
    return out


def _widest(x: np.ndarray) -> float:
    return float(np.abs(x.astype(np.float64)).max()) if x.size else 0.0


def partial_scores(queries: np.ndarray, rows: np.ndarray, lists: int) -> list[np.ndarray]:
    """Exact partial scores (queries x rows) of each group of dimensions, in the narrowest numbers that hold them all."""
    bound = _widest(queries) * _widest(rows) * max(queries.shape[1], 1)
    kind = np.float32 if bound < 2 ** 24 else np.float64 if bound < 2 ** 53 else object
    q, x = queries.astype(kind), rows.astype(kind)
    if kind is object:  # beyond 53 bits: Python integers
        return [np.array([[sum(map(int.__mul__, a, b)) for b in x[:, c].tolist()] for a in q[:, c].tolist()], object)
                .reshape(len(q), len(x)) for c in np.array_split(np.arange(q.shape[1]), lists)]
    return [q[:, c] @ x[:, c].T for c in np.array_split(np.arange(q.shape[1]), lists)]


def _least(parts: list[np.ndarray]):
    return -(1 << 200) if parts[0].dtype == object else -np.inf


def _longs(x: np.ndarray) -> np.ndarray:
    if x.dtype == object:
        return np.array([min(max(int(v), LONG_MIN), LONG_MAX) for v in x.ravel()], np.int64).reshape(x.shape)
    return x.astype(np.int64)


def _tiles(batches: Iterator[pa.RecordBatch], q_rows: np.ndarray, q_ints: np.ndarray, lists: int):
    """Per tile: first query, row numbers, ids, id is null, partial scores, and the pairs of a query with its own row."""
    order = np.argsort(q_rows)
    for batch in batches:
        row = batch.column(0).to_numpy(zero_copy_only=False)
        null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        ids = pc.fill_null(batch.column(1), 0).to_numpy(zero_copy_only=False)
        for lo in range(0, batch.num_rows, TILE_ROWS):
            cut = slice(lo, min(lo + TILE_ROWS, batch.num_rows))
            x = _matrix(batch.column(2).slice(lo, TILE_ROWS), q_ints.shape[1])
            at = np.minimum(np.searchsorted(q_rows, row[cut], sorter=order), len(order) - 1)
            own = np.flatnonzero(q_rows[order[at]] == row[cut])
            own_q = order[at[own]]
            for first in range(0, len(q_rows), TILE_QUERIES):
                mine = (own_q >= first) & (own_q < first + TILE_QUERIES)
                yield (first, row[cut], ids[cut], null[cut], partial_scores(q_ints[first:first + TILE_QUERIES], x, lists),
                       (own_q[mine] - first, own[mine]))


def gathered_totals(parts: list[np.ndarray], own, k: int) -> np.ndarray:
    """Phase 1 in a tile: totals of the rows that are among the k greatest of a query in some list (queries x up to k * lists).

    A row that several lists name counts once; places without a row hold the least value.
    """
    least, n = _least(parts), parts[0].shape[1]
    k = min(k, n)
    ranked = [p.copy() for p in parts]
    for p in ranked:
        p[own] = least
    if parts[0].dtype == object:
        picks = [np.argsort(-p, axis=1)[:, :k] for p in ranked]
    else:
        picks = [np.argpartition(p, n - k, axis=1)[:, n - k:] for p in ranked]
    out = []
    for i, pick in enumerate(picks):
        total = sum(np.take_along_axis(p, pick, 1) for p in parts)
        gone = np.take_along_axis(ranked[i], pick, 1) == least
        for earlier in picks[:i]:
            gone |= (pick[:, :, None] == earlier[:, None, :]).any(axis=2)
        total[gone] = least
        out.append(total)
    return np.concatenate(out, axis=1)


def collected(parts: list[np.ndarray], own, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3 in a tile: (query, row, total) of all rows that reach their query's cutoff (``-inf``: any row does)."""
    lists = len(parts)
    open_ = np.isneginf(cutoff.astype(np.float64))
    whole = np.where(open_, 0, cutoff)
    threshold = -((-whole) // lists)  # the least integer at or above cutoff / lists
    sent = [(p >= threshold[:, None].astype(p.dtype)) | open_[:, None] for p in parts]
    any_list = sent[0].copy()
    for s in sent[1:]:
        any_list |= s
    any_list[own] = False
    q, r = np.nonzero(any_list)
    exact = object if parts[0].dtype == object else np.int64
    known, missing = np.zeros(len(q), exact), np.zeros(len(q), np.int64)
    for p, s in zip(parts, sent):
        here = s[q, r]
        known[here] += p[q[here], r[here]].astype(exact)
        missing += ~here
    limit, step = whole.astype(exact), threshold.astype(exact)
    left = open_[q] | (known + missing * (step[q] - 1) >= limit[q])
    q, r, known = q[left], r[left], known[left]
    for p, s in zip(parts, sent):
        there = ~s[q, r]
        known[there] += p[q[there], r[there]].astype(exact)
    reach = open_[q] | (known >= limit[q])
    return q[reach], r[reach], _longs(known[reach])


def _first_k(cols: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k first rows of each query of (query, score, id, id is null, row): score descending, id (null last), row."""
    q, score, ids, null, row = cols
    order = np.lexsort((row, ids, null, ~score, q))
    q = q[order]
    begins = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q))))
    order = order[rank < k]
    return [c[order] for c in cols]


def _gather(rows: DataFrame, block, k: int, lists: int) -> DataFrame:
    """(q, total): a task's k greatest gathered totals of each query of the block."""
    def run(batches):
        q_rows, q_ints = block.value
        best = np.full((len(q_rows), k), -np.inf, object)
        for first, _, _, _, parts, own in _tiles(batches, q_rows, q_ints, lists):
            new = gathered_totals(parts, own, k)
            there = slice(first, first + len(new))
            if new.dtype != object:  # whole numbers below 2^53: sort as they are
                old = best[there].astype(np.float64)
                best[there] = np.sort(np.concatenate([old, new.astype(np.float64)], axis=1), axis=1)[:, -k:]
            else:
                new[new == _least(parts)] = -np.inf
                best[there] = np.sort(np.concatenate([best[there], new], axis=1), axis=1)[:, -k:]
        at = np.argwhere(best > -np.inf)
        totals = _longs(best[at[:, 0], at[:, 1]].reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int64()), pa.array(totals, pa.int64())], names=["q", "total"])

    return rows.mapInArrow(run, "q long, total long")


def _resolve(rows: DataFrame, block, cutoffs, k: int, lists: int) -> DataFrame:
    """(q_row, query_id, vec_id, row, score): a task's k first rows of each query among those at or above the cutoff."""
    def run(batches):
        q_rows, q_ints = block.value
        cutoff, q_ids = cutoffs.value
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]
        for first, row, ids, null, parts, own in _tiles(batches, q_rows, q_ints, lists):
            q, r, score = collected(parts, own, cutoff[first:first + TILE_QUERIES])
            new = [q + first, score, ids[r], null[r], row[r]]
            best = _first_k([np.concatenate(p) for p in zip(best, new)], k)
        q, score, ids, null, row = best
        yield pa.RecordBatch.from_arrays(
            [pa.array(q_rows[q], pa.int64()), pa.array(q_ids[q], pa.int64()), pa.array(ids, pa.int64(), mask=null), pa.array(row, pa.int64()),
             pa.array(score, pa.int64())], names=["q_row", "query_id", "vec_id", "row", "score"])

    return rows.mapInArrow(run, "q_row long, query_id long, vec_id long, row long, score long")


def threshold_topk(vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vec_col: str = "embedding",
                   scale: int = 256, lists: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of greatest integer inner product for every query, exactly.

    Vectors become floor(scale * x). Queries are the rows where ``is_query``, a condition on
    the column ``id``, holds; candidates are all rows but the query's own. Ties go to the
    smaller id (null last). Rows are told apart by a number written with them, so a repeated
    id is a query and a candidate of its own each time. Vectors that are null or hold a null
    or non-finite component take no part; of vectors of unequal length the missing
    components count as zero; a score beyond a long stays at its limit. Fewer than k
    candidates give all; no rows or no queries give none. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = staged(integer_vectors(vectors, id_col, vec_col, scale).select(
        F.monotonically_increasing_id().alias("row"), "id", "ints"), "topk-rows")
    asked = rows.where(F.coalesce(is_query, F.lit(False)))
    n, width = asked.agg(F.count("*"), F.max(F.size("ints"))).first()
    n_blocks = max(1, math.ceil(n * max(width or 1, 1) * 8 / block_bytes))
    found = None
    for b in range(n_blocks):
        part = asked.where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == b).toArrow()
        q_rows = part.column("row").to_numpy()
        q_ints = _matrix(part.column("ints").combine_chunks(), width or 0) if len(q_rows) else np.zeros((0, 0), np.int64)
        if not len(q_rows) and b < n_blocks - 1:
            continue
        if not len(q_rows):
            local = rows.select(F.col("row").alias("q_row"), F.col("id").alias("query_id"), F.col("id").alias("vec_id"), "row",
                                F.col("row").alias("score")).limit(0)
            found = local if found is None else found
            continue
        block = spark.sparkContext.broadcast((q_rows, q_ints))
        over = Window.partitionBy("q").orderBy(F.desc("total"))
        kth = _gather(rows, block, k, lists).withColumn("place", F.row_number().over(over)).where(F.col("place") <= k) \
            .groupBy("q").agg(F.count("*").alias("n"), F.min("total").alias("cutoff")).toArrow()  # a row for each query of the block
        cutoff = np.full(len(q_rows), -np.inf, object)
        for q, have, total in zip(*(kth.column(c).to_pylist() for c in ("q", "n", "cutoff"))):
            if have == k and total != LONG_MIN:
                cutoff[q] = total
        if all(c == -np.inf or abs(c) < 2 ** 53 for c in cutoff):
            cutoff = cutoff.astype(np.float64)
        local = _resolve(rows, block, spark.sparkContext.broadcast((cutoff, part.column("id").to_numpy())), k, lists)
        found = local if found is None else found.unionByName(local)
    best = Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
