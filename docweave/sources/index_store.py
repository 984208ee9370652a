"""The search index as a parquet table (S8-S11), in one of two layouts.

Rows: ``id, parent_id, title, section, content, url, source, updated_at, vector``.

* ``versioned``: every run writes a full new snapshot ``v=<n>`` (atomic switch by
  ``_SUCCESS``); simple, but a run costs a rewrite of the whole index.
* ``buckets``: the table is cut by ``pmod(xxhash64(parent_id), n)`` (``bucketed``); a run
  reads only the buckets its documents touch, writes them anew beside the old ones and
  switches to them with one manifest. Work per run grows with the change, not with the
  index, and a run that stops half-way changes nothing.

Either way merges are keyed anti joins plus a union (mergeOrUpload by id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.sources import bucketed, versioned


def index_schema(vector_type: T.DataType = T.ArrayType(T.FloatType(), False)) -> T.StructType:
    return T.StructType([
        T.StructField("id", T.StringType(), False),
        T.StructField("parent_id", T.StringType(), False),
        T.StructField("title", T.StringType(), True),
        T.StructField("section", T.StringType(), True),
        T.StructField("content", T.StringType(), True),
        T.StructField("url", T.StringType(), True),
        T.StructField("source", T.StringType(), True),
        T.StructField("updated_at", T.TimestampType(), True),
        T.StructField("vector", vector_type, True),
    ])


INDEX_SCHEMA = index_schema()

# Declared abilities of the index fields (fixed values).
FILTERABLE = ("parent_id", "url", "source", "updated_at")
SEARCHABLE = ("title", "content")
FACETABLE = ("source",)
SORTABLE = ("updated_at",)


def index_ensure(records: DataFrame, dimensions: int) -> DataFrame:
    """Records without a vector or whose vector's width differs from the index width (S8); empty when valid."""
    width = F.when(F.col("vector").isNotNull(), F.size("vector"))
    return records.filter(~width.eqNullSafe(F.lit(dimensions))).select("id", width.alias("width"))


def load_index(spark: SparkSession, root: str) -> DataFrame | None:
    """The current index, or ``None`` when no index exists (P5 handles that)."""
    if bucketed.exists(spark, root):
        return bucketed.read(spark, root, INDEX_SCHEMA)
    return versioned.read_latest(spark, root, INDEX_SCHEMA)


def bucket_merge(spark: SparkSession, root: str, records: DataFrame, doomed_ids: DataFrame,
                 touched_parents: DataFrame, n_buckets: int | None = None, before_commit=None) -> list[int]:
    """Merge ``records`` and delete ``doomed_ids``, rewriting only the buckets of
    ``touched_parents`` (``parent_id`` of every document with new, stale or gone chunks)."""
    def merge(old: DataFrame) -> DataFrame:
        return index_upsert(index_delete(old, doomed_ids), records)

    return bucketed.replace(spark, root, INDEX_SCHEMA, "parent_id", merge, touched_parents, n_buckets, before_commit)


def index_upsert(old: DataFrame, records: DataFrame) -> DataFrame:
    """mergeOrUpload by id (S9). Records always carry every field, so merge equals replace."""
    cols = [f.name for f in INDEX_SCHEMA.fields]
    return old.join(records.select("id"), "id", "left_anti").select(cols).unionByName(records.select(cols))


def index_delete(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Delete chunk ids (S10); an empty id table is a no-op."""
    return index.join(ids.select(F.col(ids.columns[0]).alias("id")).distinct(), "id", "left_anti")


def write_index(index: DataFrame, root: str, files_per_version: int | None = None) -> int:
    """Write the next snapshot clustered by ``parent_id``."""
    n = files_per_version or index.sparkSession.conf.get("spark.sql.shuffle.partitions")
    laid = index.repartition(int(n), "parent_id").sortWithinPartitions("parent_id", "id")
    return versioned.write_next(laid, root)


def batch_plan(actions: DataFrame, batch_size: int = 500) -> DataFrame:
    """Number index actions into request batches of at most ``batch_size``.

    Batches are cut inside each partition of the action table: the low 33 bits of
    ``monotonically_increasing_id`` are the row's position in its partition, so
    the plan needs no shuffle, no global order and no single-task window.
    """
    pos = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return actions.withColumn("batch", F.concat_ws(
        "-", F.spark_partition_id().cast("string"), F.floor(pos / F.lit(batch_size)).cast("string")))


BATCH_GROUP_DIGITS = 3  # 4,096 groups of keys: fixed, so that a row's batch never depends on how many rows there are


def batch_plan_keyed(actions: DataFrame, key: str = "id", batch_size: int = 500, digits: int = BATCH_GROUP_DIGITS) -> DataFrame:
    """Deterministic request batches (S11): the same actions always get the same batches.

    Actions are grouped by the first ``digits`` hex digits of ``sha1(key)``; inside a group,
    rows are numbered by key and cut every ``batch_size``. Groups are even (the digest
    spreads the keys), so a window sees 1/16^digits of the rows; keys must be unique.
    """
    from pyspark.sql import Window

    grp = F.substring(F.sha1(F.col(key).cast("string")), 1, digits)
    w = Window.partitionBy("_g").orderBy(key)
    return actions.withColumn("_g", grp).withColumn("_rn", F.row_number().over(w)).withColumn(
        "batch", F.concat_ws("-", F.col("_g"), F.floor((F.col("_rn") - 1) / F.lit(batch_size)).cast("string"))
    ).drop("_g", "_rn")


def batched_sink(actions: DataFrame, send, batch_size: int = 500) -> None:
    """Post actions with ``send(list_of_dicts)`` in groups of at most ``batch_size`` per task."""
    def per_partition(rows):
        buf = []
        for r in rows:
            buf.append(r.asDict(recursive=True))
            if len(buf) == batch_size:
                send(buf)
                buf = []
        if buf:
            send(buf)

    actions.foreachPartition(per_partition)
