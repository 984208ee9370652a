"""Incremental ingest decisions.

The diff shuffles only narrow columns: ``(id, source, content_hash)`` from the scan
and ``(doc_id, source, content_hash, chunk_ids)`` from state. Document bytes are
joined back afterwards for the (usually few) new or changed documents only; with
AQE the small side of that semi join is broadcast when its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEW, CHANGED, UNCHANGED, GONE = "new", "changed", "unchanged", "gone"


def ingest_diff(scanned: DataFrame, state: DataFrame, scope_by_source: bool = True) -> DataFrame:
    """Classify each document as new, changed, unchanged or gone.

    ``scanned``: ``id, source, content_hash``; ``state``: ``doc_id, source, content_hash, chunk_ids``.
    With ``scope_by_source`` a known document counts as gone only when its source
    was part of this scan (trap T3), so a run over one source never prunes another.
    """
    s = scanned.select(F.col("id").alias("doc_id"), F.col("source").alias("s_source"),
                       F.col("content_hash").alias("hash"))
    k = state.select("doc_id", F.col("source").alias("k_source"),
                     F.col("content_hash").alias("known_hash"), "chunk_ids", F.lit(True).alias("_known"))
    if scope_by_source:
        scanned_sources = scanned.select(F.col("source").alias("k_source")).distinct()
        k = k.join(scanned_sources, "k_source", "left_semi")
    j = s.join(k, "doc_id", "full_outer")
    status = (F.when(F.col("_known").isNull(), NEW)
              .when(F.col("hash").isNull(), GONE)
              .when(F.col("known_hash").eqNullSafe(F.col("hash")), UNCHANGED)
              .otherwise(CHANGED))
    return j.select("doc_id", F.coalesce("s_source", "k_source").alias("source"), status.alias("status"),
                    "hash", "known_hash", "chunk_ids")


def gone_docs(diff: DataFrame) -> DataFrame:
    """Known but no longer seen."""
    return diff.filter(F.col("status") == GONE).select("doc_id", "source", "chunk_ids")


def stale_chunks(diff: DataFrame, new_chunk_ids: DataFrame) -> DataFrame:
    """Old chunk ids that the new parse no longer produces, per re-ingested doc.

    ``new_chunk_ids``: ``doc_id, chunk_ids`` of the new parse.
    """
    old = diff.filter(F.col("status") == CHANGED).select("doc_id", F.col("chunk_ids").alias("old_ids"))
    j = old.join(new_chunk_ids.select("doc_id", F.col("chunk_ids").alias("new_ids")), "doc_id")
    return j.select("doc_id", F.explode(F.array_except("old_ids", "new_ids")).alias("chunk_id"))


def gone_chunks(diff: DataFrame) -> DataFrame:
    """Every chunk id of every gone document."""
    return gone_docs(diff).select("doc_id", F.explode("chunk_ids").alias("chunk_id"))


def ingest_stats(diff: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """scanned, ingested, skipped (unchanged and empty), chunks, pruned_docs.

    ``chunk_counts``: ``doc_id, n_chunks`` for the documents parsed in this run.
    """
    j = diff.join(chunk_counts, "doc_id", "left")
    todo = F.col("status").isin(NEW, CHANGED)
    has = F.coalesce(F.col("n_chunks"), F.lit(0)) > 0
    return j.agg(
        F.count_if(F.col("status") != GONE).cast("bigint").alias("scanned"),
        F.count_if(todo & has).cast("bigint").alias("ingested"),
        F.count_if((F.col("status") == UNCHANGED) | (todo & ~has)).cast("bigint").alias("skipped"),
        F.coalesce(F.sum(F.when(todo & has, F.col("n_chunks"))), F.lit(0)).cast("bigint").alias("chunks"),
        F.count_if(F.col("status") == GONE).cast("bigint").alias("pruned_docs"),
    )
