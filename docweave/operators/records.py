"""Chunk rows to index records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.hashing import chunk_id
from docweave.functions.text import derive_title, section_path, source_of


def build_records(chunks: DataFrame, as_of=None) -> DataFrame:
    """Index rows (without the vector) from ``chunk_blocks`` output.

    ``chunks``: ``id, uri, chunk_index, headings, text, first_headings``. ``updated_at`` is one
    stamp per run (``as_of``, trap T8), not one per record.
    """
    ts = F.lit(as_of).cast("timestamp") if as_of is not None else F.current_timestamp()
    return chunks.select(
        chunk_id("id", "chunk_index").alias("id"),
        F.col("id").alias("parent_id"),
        derive_title("uri", "first_headings").alias("title"),
        section_path("headings", "chunk_index").alias("section"),
        F.col("text").alias("content"),
        F.col("uri").alias("url"),
        source_of("id").alias("source"),
        ts.alias("updated_at"),
        F.col("chunk_index"),
    )
