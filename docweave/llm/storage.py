"""Shared-folder intermediate tables and distributed running sums."""

from __future__ import annotations

import threading
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.session import scratch_path
from docweave.sources.versioned import delete_folder


_LOCAL = threading.local()


def staged_folders() -> list[str]:
    """Folders that ``staged`` has written in this thread and nobody has discarded, in order."""
    return _LOCAL.__dict__.setdefault("folders", [])


def staged(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts lineage (a lost executor re-runs only its own tasks of the job at hand) and keeps
    work that several later steps read from being done more than once.
    """
    path = scratch_path(df.sparkSession, f"llm-{name}-{uuid.uuid4().hex}")
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    staged_folders().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, first: int, last: int | None = None) -> None:
    """Delete the folders ``staged_folders()[first:last]``, which nothing may read any more."""
    for path in staged_folders()[first:last]:
        delete_folder(spark, path)
    del staged_folders()[first:last]


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as it takes to be no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def numbered(docs: DataFrame, name: str, label: str) -> DataFrame:
    """``docs`` with ``name``: a number of its own for every row, the same in every job that reads it.

    Rows of Parquet files are told apart by their file and their place in it, which do not
    depend on how a job splits the files; any other frame is written once with its numbers.
    Files are numbered by path (Spark's file index holds the paths anyway).
    """
    spark, path = docs.sparkSession, unused(docs, "_file_path")[0]
    try:
        hidden = docs.metadataColumn("_metadata")
        rows = docs.select("*", hidden["file_path"].alias(path), hidden["row_index"].alias(name))
        files = sorted(r[0] for r in rows.select(path).distinct().collect())
    except AnalysisException:  # no plain scan of files
        return staged(docs.withColumn(name, F.monotonically_increasing_id()), label)
    if len(files) >= 1 << 22:
        return staged(docs.withColumn(name, F.monotonically_increasing_id()), label)
    at, key = unused(rows, "_file_number", "_file_key")
    table = spark.createDataFrame(list(enumerate(files)), f"{at} long, {key} string")
    return rows.join(F.broadcast(table), F.col(path) == F.col(key)).withColumn(
        name, F.shiftleft(at, 40) + F.col(name)).select(*docs.columns, name)


BROADCAST_KEYS = 4_000_000  # rows of one or two numbers: about 100 MB as a hash table


def small_side(keys: DataFrame) -> DataFrame:
    """A staged table of a few numbers a row, marked for broadcast while it has ``BROADCAST_KEYS`` rows at most, so that
    the texts it is joined with stay where they are; a larger one is joined by a shuffle."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out`` = sum of ``value`` over the rows of the group up to and including the row.

    The order must be total. Rows are range-partitioned over group and order, so a group
    with a third of all rows lies in many tasks; each task sums its own part, and what
    precedes a part comes from the per-part totals (one row for each group and part).
    Null group values form a group of their own.
    """
    n = tasks(df.sparkSession)
    parts = staged(df.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = parts.groupBy(*group, "_part").agg(F.sum(value).alias("_total"))
    over = Window.partitionBy(*[totals[g] for g in group]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"),
                           F.coalesce(F.sum("_total").over(over), F.lit(0)).alias("_before"))
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    local = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.withColumn(out, F.sum(value).over(local)).join(before, on, "left")
    return summed.withColumn(out, F.col(out) + F.col("_before")).drop(
        "_part", "_p", "_before", *[f"_g{i}" for i in range(len(group))])
