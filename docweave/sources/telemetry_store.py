"""Telemetry tables on disk (S13, P12): parquet partitioned by day.

A ``TimeGenerated`` window then prunes whole day folders (``PartitionFilters``) before
any file is opened, and retention drops whole days.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.telemetry import _as_datetime, parse_since


def write_by_day(df: DataFrame, root: str, ts: str = "TimeGenerated", mode: str = "append") -> None:
    """Append telemetry rows under ``root/day=YYYY-MM-DD``, clustered by operation. A day is cut into files by size, so a
    busy one is many tasks."""
    out = df.withColumn("day", F.to_date(F.col(ts)))
    out.hint("rebalance", F.col("day")).sortWithinPartitions("day", "OperationId" if "OperationId" in df.columns else ts) \
        .write.mode(mode).partitionBy("day").parquet(root)


def read_window(spark: SparkSession, root: str, as_of, since: str, ts: str = "TimeGenerated") -> DataFrame:
    """Rows with ``ts > as_of - since``; the day predicate prunes partitions, the time predicate rows."""
    start = _as_datetime(as_of) - parse_since(since)
    df = spark.read.parquet(root)
    lit = F.lit(start.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(df.schema[ts].dataType)
    return df.filter((F.col("day") >= F.lit(start.date())) & (F.col(ts) > lit))


def retention_days(spark: SparkSession, root: str, as_of, days: int = 30) -> list[str]:
    """Day folders older than the retention at ``as_of`` (to drop as whole folders)."""
    from docweave.sources.versioned import _fs

    cutoff = (_as_datetime(as_of) - timedelta(days=days)).date()
    fs, path, _ = _fs(spark, root)
    if not fs.exists(path):
        return []
    old = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith("day=") and datetime.strptime(name[4:], "%Y-%m-%d").date() < cutoff:
            old.append(name)
    return sorted(old)
