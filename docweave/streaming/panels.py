"""Live dashboard panels (W6): the binned panels as tumbling windows with a watermark.

The watermark follows the rows that reach the panel (Catalyst pushes stateless
filters below the watermark node anyway). State per window is a count or a sum, so it stays small; in append mode a window is
emitted once the watermark passes its end, and then equals the batch panel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import has_term
from docweave.operators.telemetry import CHAT_TERM, with_token_columns


def _event_time(df: DataFrame, col: str = "TimeGenerated") -> DataFrame:
    """Watermarks need TIMESTAMP; a TIMESTAMP_NTZ column is read as UTC wall time."""
    if df.schema[col].dataType.typeName() == "timestamp_ntz":
        return df.withColumn(col, F.col(col).cast("timestamp"))
    return df


def _start(col: str = "w") -> F.Column:
    return F.col(f"{col}.start").cast("timestamp_ntz").alias("TimeGenerated")


def stream_request_volume(requests: DataFrame, width: str = "5 minutes", delay: str = "10 minutes",
                          term: str = CHAT_TERM) -> DataFrame:
    r = _event_time(requests).filter(has_term("Name", term)).withWatermark("TimeGenerated", delay)
    return r.groupBy(F.window("TimeGenerated", width).alias("w")).agg(
        F.count(F.lit(1)).alias("Requests"), F.count_if(F.col("Success") == F.lit(False)).alias("Failures")) \
        .select(_start(), "Requests", "Failures")


def stream_tokens_over_time(deps: DataFrame, width: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    d = with_token_columns(_event_time(deps).filter(F.col("Name") == "llm-call")).withWatermark("TimeGenerated", delay)
    return d.groupBy(F.window("TimeGenerated", width).alias("w"), "model") \
        .agg(F.sum(F.col("inTok") + F.col("outTok")).alias("Tokens")).select(_start(), "model", "Tokens")


def stream_ingest_throughput(deps: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    d = _event_time(deps).filter(F.col("Name") == "ingest-doc").withWatermark("TimeGenerated", delay)
    return d.groupBy(F.window("TimeGenerated", width).alias("w")).agg(
        F.count_if(F.col("Success") == F.lit(True)).alias("Ingested"),
        F.count_if(F.col("Success") == F.lit(False)).alias("Failed")).select(_start(), "Ingested", "Failed")
