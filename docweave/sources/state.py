"""Ingest state (S5-S7): one row per source document.

``doc_id, source, content_hash, chunk_ids, updated_at`` keyed by ``doc_id``
(``id = sha1(doc_id)``). Merges are keyed anti joins plus a union, so they
partition on ``doc_id`` and never gather a document set on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.hashing import state_id
from docweave.sources import bucketed, versioned

STATE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("source", T.StringType(), True),
    T.StructField("content_hash", T.StringType(), True),
    T.StructField("chunk_ids", T.ArrayType(T.StringType()), True),
    T.StructField("updated_at", T.TimestampType(), True),
    # listing facts of the file the hash was taken from (optional pre-filter)
    T.StructField("length", T.LongType(), True),
    T.StructField("modified", T.TimestampType(), True),
])


def state_scan(state: DataFrame) -> DataFrame:
    """The three columns the diff needs (S5); the scan reads only these."""
    return state.select("doc_id", "source", "content_hash", "chunk_ids")


def load_state(spark: SparkSession, root: str) -> DataFrame:
    if bucketed.exists(spark, root):
        return bucketed.read(spark, root, STATE_SCHEMA)
    return versioned.read_or_empty(spark, root, STATE_SCHEMA)


def state_rows(records: DataFrame, as_of=None) -> DataFrame:
    """State rows from ``(doc_id, source, content_hash, chunk_ids[, length, modified])`` records."""
    ts = F.lit(as_of).cast("timestamp") if as_of is not None else F.current_timestamp()
    length = F.col("length").cast("long") if "length" in records.columns else F.lit(None).cast("long")
    modified = F.col("modified").cast("timestamp") if "modified" in records.columns else F.lit(None).cast("timestamp")
    return records.select(state_id("doc_id").alias("id"), "doc_id", "source", "content_hash", "chunk_ids",
                          ts.alias("updated_at"), length.alias("length"), modified.alias("modified"))


def state_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Create or fully replace each document's state."""
    cols = old.columns
    return old.join(new.select("doc_id"), "doc_id", "left_anti").select(cols) \
        .unionByName(new.select(cols))


def state_forget(old: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Drop state of the given documents; absent ones are ignored."""
    return old.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")
