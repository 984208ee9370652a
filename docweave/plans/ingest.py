"""The incremental ingest run (E9) as one Spark job graph.

listing (optionally trusted by length/mtime) -> fingerprint -> diff against state
(narrow shuffle on doc id) -> bytes of new/changed docs only -> parse -> chunk ->
records -> embed -> staged once -> index merge (upsert, delete stale and gone; only
touched buckets by default) -> state merge -> stats.

Order of effects: index first, then state; each table switches by one manifest.
A run stopped before the index switch changes nothing; one stopped between the
two switches leaves state behind the index, so the next run repeats those
documents with the same deterministic chunk ids.
Intermediate tables go under the shared checkpoint folder (never a local temp dir),
so a lost executor only re-runs its own tasks and paid embedding calls are not
repeated by downstream stages.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.chunk import DEFAULT_LIMIT, chunk_blocks, drop_blank_chunks
from docweave.operators.diff import (CHANGED, GONE, NEW, UNCHANGED, gone_chunks, ingest_diff,
                                     ingest_stats, stale_chunks)
from docweave.operators.embed import EmbedFn, dimension_probe, embed_chunks
from docweave.operators.parse import parse_documents
from docweave.operators.postings import postings_update
from docweave.operators.records import build_records
from docweave.session import scratch_path, spread, staged
from docweave.sources import bucketed, index_store, state as state_store, versioned
from docweave.sources.corpus import with_fingerprint


@dataclass
class IngestResult:
    stats: DataFrame
    index_version: int | None
    state_version: int | None


def plan_chunks(docs: DataFrame, text_col: str = "text", fmt: str | None = None,
                limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Parse and chunk documents (``id, uri, source`` plus text) into chunk rows."""
    parsed = parse_documents(spread(docs), text_col, fmt)
    keep = [c for c in ("id", "uri", "source", "content_hash") if c in parsed.columns]
    return drop_blank_chunks(chunk_blocks(parsed.select(*keep, "blocks"), limit=limit))


def ingest_run(corpus: DataFrame, index_root: str, state_root: str, embed_fn: EmbedFn | None = None,
               fmt: str | None = None, limit: int = DEFAULT_LIMIT, as_of=None,
               empty_policy: str = "clear", scope_by_source: bool = True,
               config_fingerprint: str | None = None, index_layout: str = "buckets",
               n_buckets: int | None = None, reread=None, before_commit=None, prune: bool = True,
               keyword_root: str | None = None) -> IngestResult:
    """One incremental pass over ``corpus`` (``id, uri, source, content``).

    ``empty_policy``: ``"keep"`` leaves a known document that now parses to nothing as it
    was (the reference), ``"clear"`` removes its chunks and records the new hash (T1).
    ``scope_by_source`` prunes only documents of the scanned sources (T3); ``prune=False``
    prunes none, for a corpus that holds only what has arrived.
    ``config_fingerprint`` folds processing settings into the hash (T2).
    ``index_layout="buckets"`` rewrites only the index and state buckets this run touches,
    each table switched by one manifest (``before_commit(table)`` runs just before);
    ``n_buckets`` counts when a table is created.
    ``reread(paths) -> corpus`` enables the listing pre-filter: a file whose length and
    modification time equal those recorded in state is trusted to be unchanged and its
    bytes are not read; only the other files are read and hashed. The hash stays the rule
    for every file that is read.
    ``keyword_root`` names a stored keyword index over the chunks' searchable fields, which the run keeps in step.
    """
    if index_layout not in ("versioned", "buckets"):
        raise ValueError("index_layout must be 'versioned' or 'buckets'")
    if empty_policy not in ("clear", "keep"):
        raise ValueError("empty_policy must be 'clear' or 'keep'")
    spark = corpus.sparkSession
    corpus = spread(corpus)  # few large splits: spread before the heavy row-local steps
    run_dir = scratch_path(spark, f"ingest-{uuid.uuid4().hex}")
    stamp = as_of if as_of is not None else None

    state = state_store.load_state(spark, state_root)
    listing_cols = {"length", "modificationTime"}
    if reread is not None and listing_cols <= set(corpus.columns) and not config_fingerprint:
        fp, scanned = _prefiltered_scan(corpus, state, reread)
    else:
        fp = with_fingerprint(corpus, config_fingerprint)
        scanned = fp
    facts = listing_cols <= set(scanned.columns)
    keep = ["id", "source", "content_hash"] + (["length", "modificationTime"] if facts else [])
    scanned.select(*keep).write.parquet(f"{run_dir}/scanned")
    scanned = spark.read.parquet(f"{run_dir}/scanned")
    diff = ingest_diff(scanned, state_store.state_scan(state), scope_by_source)
    if not prune:
        diff = diff.filter(F.col("status") != GONE)
    if facts:  # listing facts ride along so state can record them
        diff = diff.join(scanned.select(F.col("id").alias("doc_id"), "length",
                                        F.col("modificationTime").alias("modified")), "doc_id", "left")
    diff.write.parquet(f"{run_dir}/diff")
    diff = spark.read.parquet(f"{run_dir}/diff")
    # Two documents with one id would overwrite each other's chunks; refuse the run
    dups = diff.groupBy("doc_id").count().filter(F.col("count") > 1).limit(5).collect()
    if dups:
        raise ValueError(f"document ids are not unique in the corpus: {[r['doc_id'] for r in dups]}")

    # Only keys meet the bytes, and of the two ways to say which documents to read the one with fewer keys: on a first
    # load nothing is unchanged and no join is left, on a usual run the few changed ids are broadcast by measured size.
    per_status = {r["status"]: r["count"] for r in diff.groupBy("status").count().collect()}
    few_known = per_status.get(UNCHANGED, 0) <= per_status.get(NEW, 0) + per_status.get(CHANGED, 0)
    named = diff.filter(F.col("status") == UNCHANGED if few_known else F.col("status").isin(NEW, CHANGED))
    docs = fp.join(named.select(F.col("doc_id").alias("id")), "id", "left_anti" if few_known else "left_semi").withColumn("text", F.decode("content", "UTF-8")).drop("content")
    chunks = plan_chunks(docs, "text", fmt, limit)
    records = embed_chunks(build_records(chunks, stamp), "content", "vector", embed_fn)
    records.write.parquet(f"{run_dir}/records")
    records = spark.read.parquet(f"{run_dir}/records")
    # Every vector must have the width the index is sized to (the probe's width)
    dims = dimension_probe(embed_fn)
    bad = index_store.index_ensure(records, dims).limit(1).collect()
    if bad:
        raise ValueError(f"embedder returned width {bad[0]['width']} for chunk {bad[0]['id']}, index width is {dims}")

    # per-document lists are bounded by the document's own size
    counts = records.groupBy(F.col("parent_id").alias("doc_id")).agg(
        F.count(F.lit(1)).cast("int").alias("n_chunks"),
        F.array_sort(F.collect_list("id")).alias("chunk_ids"))
    new_ids = counts.select("doc_id", "chunk_ids")

    # parsed docs that produced no chunk (trap T1)
    empty = diff.filter(F.col("status").isin(NEW, CHANGED)).join(counts, "doc_id", "left_anti")
    if empty_policy == "clear":
        changed_ids = new_ids.unionByName(empty.select("doc_id", F.array().cast("array<string>").alias("chunk_ids")))
        reingested = diff.filter(F.col("status").isin(NEW, CHANGED))
    else:
        changed_ids = new_ids
        reingested = diff.join(counts.select("doc_id"), "doc_id", "left_semi")

    # index: upsert records, delete stale and gone chunk ids
    doomed = stale_chunks(diff, changed_ids).select("chunk_id").unionByName(gone_chunks(diff).select("chunk_id"))
    rec = records.drop("chunk_index")
    if index_layout == "buckets":
        touched = rec.select("parent_id").unionByName(
            stale_chunks(diff, changed_ids).select(F.col("doc_id").alias("parent_id"))).unionByName(
            gone_chunks(diff).select(F.col("doc_id").alias("parent_id")))
        index_store.bucket_merge(spark, index_root, rec, doomed, touched, n_buckets,
                                 before_commit and (lambda: before_commit("index")))
        index_version = None
    else:
        old_index = index_store.load_index(spark, index_root)
        if old_index is None:
            old_index = spark.createDataFrame([], index_store.INDEX_SCHEMA)
        new_index = index_store.index_upsert(index_store.index_delete(old_index, doomed), rec)
        index_version = index_store.write_index(new_index, index_root)

    if keyword_root is not None:  # before state, so that a run stopped here repeats its documents
        postings_update(spark, keyword_root, rec.select("id", F.concat_ws("\n", *index_store.SEARCHABLE).alias("text")), doomed,
                        doc_id="id", before_commit=before_commit and (lambda: before_commit("keywords")))

    # state: record re-ingested docs, forget gone ones
    fact_cols = ["length", "modified"] if "length" in diff.columns else []
    fresh = reingested.drop("chunk_ids").join(changed_ids, "doc_id").select(
        "doc_id", "source", F.col("hash").alias("content_hash"), "chunk_ids", *fact_cols)
    if fact_cols:
        # unchanged bytes under new listing facts: keep chunks, refresh the facts so the
        # next run trusts the listing again instead of re-reading the file
        touched = diff.filter((F.col("status") == UNCHANGED) & F.col("length").isNotNull()).join(
            state.select("doc_id", F.col("length").alias("_l"), F.col("modified").alias("_m")), "doc_id") \
            .filter(~(F.col("_l").eqNullSafe(F.col("length")) & F.col("_m").eqNullSafe(F.col("modified"))))
        fresh = fresh.unionByName(touched.select(
            "doc_id", "source", F.col("hash").alias("content_hash"), "chunk_ids", *fact_cols))
    gone = diff.filter(F.col("status") == GONE).select("doc_id")
    rows = state_store.state_rows(fresh, stamp)
    if index_layout == "buckets":  # state follows the same layout: touched buckets only
        bucketed.replace(
            spark, state_root, state_store.STATE_SCHEMA, "doc_id",
            lambda old: state_store.state_upsert(state_store.state_forget(old, gone), rows),
            gone.unionByName(rows.select("doc_id")), n_buckets, before_commit and (lambda: before_commit("state")))
        state_version = None
    else:
        new_state = state_store.state_upsert(state_store.state_forget(state, gone), rows)
        state_version = versioned.write_next(new_state.repartition("doc_id"), state_root)

    stats_counts = counts.select("doc_id", "n_chunks")
    stats = ingest_stats(diff, stats_counts)
    stats = spark.createDataFrame(stats.collect(), stats.schema)  # one row; the run's folder is not needed any more
    versioned.delete_folder(spark, run_dir)
    return IngestResult(stats, index_version, state_version)


def _prefiltered_scan(corpus: DataFrame, state: DataFrame, reread):
    """``(fp, scanned)``: bytes and hashes of the files the listing cannot vouch for, plus
    the trusted files with the hash recorded in state (their bytes are never read)."""
    listing = corpus.select("id", "source", "length", "modificationTime", "path")  # content pruned
    known = state.select(F.col("doc_id").alias("id"), F.col("content_hash").alias("_h"),
                         F.col("length").alias("_l"), F.col("modified").alias("_m"))
    j = listing.join(known, "id", "left")
    same = F.coalesce((F.col("_l") == F.col("length")) & (F.col("_m") == F.col("modificationTime")), F.lit(False))
    trusted = j.filter(same).select("id", "source", F.col("_h").alias("content_hash"), "length", "modificationTime")
    cand = j.filter(~same).select("id", "path")
    # a part of the listing, all of which Spark's file index already holds on the driver
    fresh = reread([r["path"] for r in cand.select("path").toLocalIterator()])
    fp = with_fingerprint(fresh)
    scanned = trusted.unionByName(fp.select("id", "source", "content_hash", "length", "modificationTime"))
    return fp, scanned


def ingest_files(spark, root: str, index_root: str, state_root: str, source: str = "blob",
                 container: str | None = None, trust_listing: bool = True, **kw) -> IngestResult:
    """``ingest_run`` over a folder of files, with the listing pre-filter on by default."""
    from docweave.sources.corpus import corpus_from_files, reread_files

    corpus = corpus_from_files(spark, root, source, container)
    rr = (lambda paths: reread_files(spark, root, paths, source, container)) if trust_listing else None
    return ingest_run(corpus, index_root, state_root, reread=rr, **kw)


def ingest_on_events(events: DataFrame, corpus_fn, index_root: str, state_root: str, checkpoint: str,
                     counts_path: str | None = None, available_now: bool = True, **run_kw):
    """Trigger events drive incremental passes.

    Every micro-batch of created-blob events under the documents container (W2, W4 for
    late/duplicate deliveries when ``events`` is a stream) leads to exactly one
    ``ingest_run`` over ``corpus_fn()`` (the event content is not needed: the diff finds
    what changed). The stream's checkpoint commits after the pass, so an interrupted
    pass is replayed and, with deterministic ids, rewrites the same rows.
    """
    from docweave.streaming.arrivals import coalesce_events, event_expiry, event_filter

    ev = event_filter(events)
    if events.isStreaming:
        ev = event_expiry(ev)
    results = []

    def run(subjects: DataFrame, batch_id: int) -> None:
        if subjects.limit(1).count():
            results.append((batch_id, ingest_run(corpus_fn(), index_root, state_root, **run_kw).stats.first()))

    q = coalesce_events(ev, run, checkpoint, counts_path, available_now)
    if available_now:
        q.awaitTermination()
    return q, results


def ingest_arrivals(changes: DataFrame, index_root: str, state_root: str, checkpoint: str, counts_path: str | None = None, **run_kw) -> list[tuple]:
    """Streamed corpus rows with change numbers (``connector_stream``) into index and state, until no more are listed.

    Each trigger is one ``ingest_run`` over its own documents, a document's newest change
    only; nothing is pruned. A trigger's rows are written once and fetched once. The
    checkpoint commits after the pass, so an interrupted one is replayed and, with
    deterministic ids and the diff against state, adds nothing twice; its count is
    written to a folder of its own. Returns (trigger, counters) of the passes.
    """
    results, n_cols = [], ["id", "uri", "source", "content"]

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = staged(batch, "arrivals")
        drained = held.count()
        if drained:
            newest = held.groupBy("id").agg(F.max("seq").alias("seq"))
            corpus = held.join(newest, ["id", "seq"], "left_semi").select(*n_cols)
            results.append((batch_id, ingest_run(corpus, index_root, state_root, prune=False, **run_kw).stats.first()))
            if counts_path:
                spark.createDataFrame([(drained,)], "drained long").write.mode("overwrite").parquet(f"{counts_path.rstrip('/')}/batch_id={batch_id}")

    q = changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return results
