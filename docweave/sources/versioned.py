"""Versioned parquet tables: each write is a new ``v=<n>`` folder, readers take the
highest version that has a ``_SUCCESS`` marker.

Plain parquet has no atomic replace; a new folder per version gives readers a
consistent snapshot, a failed or lost job never exposes a half-written table, and
re-running a job simply writes the next version. Old versions are kept until
``prune_versions`` removes them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_V = re.compile(r"^v=(\d+)$")


def _fs(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path, jvm


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions under ``root``, ascending."""
    fs, path, jvm = _fs(spark, root)
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        m = _V.match(st.getPath().getName())
        if m and st.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(m.group(1)))
    return sorted(out)


def latest_version(spark: SparkSession, root: str) -> int | None:
    v = versions(spark, root)
    return v[-1] if v else None


def read_latest(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The newest complete snapshot, or ``None`` when the table does not exist yet."""
    v = latest_version(spark, root)
    if v is None:
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{root.rstrip('/')}/v={v}")


def read_or_empty(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    df = read_latest(spark, root, schema)
    return df if df is not None else spark.createDataFrame([], schema)


def write_next(df: DataFrame, root: str, partition_cols: list[str] | None = None) -> int:
    """Write ``df`` as the next version and return its number."""
    spark = df.sparkSession
    all_v = _all_version_dirs(spark, root)
    nxt = (max(all_v) + 1) if all_v else 0
    w = df.write.mode("errorifexists")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(f"{root.rstrip('/')}/v={nxt}")
    return nxt


def prune_versions(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete all but the newest ``keep`` complete versions (and any incomplete older ones)."""
    fs, path, jvm = _fs(spark, root)
    done = versions(spark, root)
    keep_set = set(done[-keep:])
    newest = done[-1] if done else -1
    dropped = []
    for v in _all_version_dirs(spark, root):
        if v not in keep_set and v < newest:
            fs.delete(jvm.org.apache.hadoop.fs.Path(path, f"v={v}"), True)
            dropped.append(v)
    return dropped


def _all_version_dirs(spark: SparkSession, root: str) -> list[int]:
    fs, path, _ = _fs(spark, root)
    if not fs.exists(path):
        return []
    return sorted(int(m.group(1)) for st in fs.listStatus(path) if (m := _V.match(st.getPath().getName())))


def bucket_expr(key, n_buckets: int):
    """The bucket number of a key."""
    from pyspark.sql import functions as F

    col = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(col), F.lit(n_buckets)).cast("int")


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, p, _ = _fs(spark, path)
    fs.delete(p, True)
