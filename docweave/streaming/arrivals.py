"""File arrivals and trigger events.

A dropped file or a blob-created event starts an incremental ingest. On Spark the
event stream is a Structured Streaming source; every micro-batch is handled by
``foreachBatch``: events are de-duplicated by subject, counted (A17) and one
``ingest_run`` covers them all (W3). The checkpoint commits only after the batch
function returns (trap T4: events are never lost before the work is done), and the
ingest writes are keyed, so a replayed batch rewrites the same rows (W5).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweave.operators.telemetry import _as_datetime, _ts_literal

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"

# The subscription filter and the delivery lifetime.
CREATED_EVENT = "Microsoft.Storage.BlobCreated"
DOCUMENTS_CONTAINER = "documents"
EVENT_TTL = "7 days"
POLL_INTERVAL = "30 seconds"


def arrival_stream(spark: SparkSession, root: str, source: str = "blob", glob: str | None = None) -> DataFrame:
    """New files under ``root`` as a stream of corpus rows (``id, uri, source, content``)."""
    r = spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(root)
    base = root.rstrip("/")
    base = base if "://" in base else "file:" + base
    name = F.regexp_replace(F.col("path"), "^" + "".join("\\" + c if c in ".^$*+?()[]{}|\\" else c for c in base) + "/?", "")
    cont = base.rsplit("/", 1)[-1]
    return df.select(F.concat(F.lit(source + ":"), name).alias("id"), F.concat(F.lit(cont + "/"), name).alias("uri"),
                     F.lit(source).alias("source"), "content", "length", "modificationTime")


def event_filter(events: DataFrame, container: str = DOCUMENTS_CONTAINER) -> DataFrame:
    """Only blob-created events under the documents container (batch or stream)."""
    prefix = f"/blobServices/default/containers/{container}/blobs/"
    return events.filter((F.col("event_type") == CREATED_EVENT) & F.col("subject").startswith(prefix))


def event_expiry(events: DataFrame, as_of=None, ttl_days: int = 7, streaming: bool | None = None) -> DataFrame:
    """Drop events older than the delivery lifetime and duplicate deliveries.

    Streaming: ``withWatermark`` + ``dropDuplicatesWithinWatermark`` keep state bounded by
    the lifetime. Batch: events newer than ``as_of - ttl`` and one row per ``event_id``.
    """
    is_stream = events.isStreaming if streaming is None else streaming
    if is_stream:
        return events.withWatermark("event_time", f"{ttl_days} days").dropDuplicatesWithinWatermark(["event_id"])
    from datetime import timedelta

    start = _as_datetime(as_of) - timedelta(days=ttl_days)
    return events.filter(F.col("event_time") > _ts_literal(events, start, "event_time")).dropDuplicates(["event_id"])


def coalesce_events(events: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str,
                    counts_path: str | None = None, available_now: bool = True) -> StreamingQuery:
    """One ingest pass per micro-batch of trigger events.

    ``run(subjects, batch_id)`` gets the de-duplicated subjects of the batch; the number of
    drained events is written to a folder of the batch's own under ``counts_path`` (A17), so a
    replayed batch overwrites its count instead of adding to it.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # counted and handed on: read the source once
        try:
            drained = batch.count()
            if not drained:  # e.g. the no-data batch that only advances the watermark
                return
            if counts_path:
                batch.sparkSession.createDataFrame([(drained,)], "drained long") \
                    .write.mode("overwrite").parquet(f"{counts_path.rstrip('/')}/batch_id={batch_id}")
            run(batch.select("subject").dropDuplicates(["subject"]), batch_id)
        finally:
            batch.unpersist()

    w = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=POLL_INTERVAL)
    return w.start()


def drained_count(events: DataFrame) -> DataFrame:
    """A17 (batch form): number of trigger events consumed."""
    return events.agg(F.count(F.lit(1)).alias("drained"))
