"""Bucketed parquet tables with an atomic switch.

    root/data/v=<n>/bucket=<b>/part-*     rows of bucket b as commit n wrote them
    root/manifests/<n>.json               bucket count, key column, and per bucket the commit that holds it

A commit writes the touched buckets into a new ``v=<n>`` folder and then one manifest that
names, for every bucket, the folder to read. Nothing that a reader may be using is ever
overwritten or removed by a commit, so a job stopped at any point leaves the table as it
was; the orphan folder is ignored and cleaned by ``prune``. The bucket count is fixed when
the table is created and lives in the manifest. Files of a bucket are cut to the session's
advisory partition size, so a large bucket is many tasks and files, not one.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.sources import versioned

DEFAULT_BUCKETS = 1024


@dataclass(frozen=True)
class Manifest:
    """What a reader needs: at most ``n_buckets`` integers, whatever the table's size."""
    number: int
    n_buckets: int
    key: str
    buckets: dict[int, int] = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p, _ = _fs(spark, path)
    return [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []


def _manifest_numbers(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(m[1]) for n in _names(spark, f"{root}/manifests") if (m := re.fullmatch(r"(\d+)\.json", n)))


def _load(spark: SparkSession, root: str, number: int) -> Manifest:
    fs, p, jvm = _fs(spark, f"{root}/manifests/{number:012d}.json")
    stream = fs.open(p)
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    d = json.loads(text)
    return Manifest(number, d["n_buckets"], d["key"], {int(b): v for b, v in d["buckets"].items()})


def manifest(spark: SparkSession, root: str) -> Manifest | None:
    """The newest manifest, or ``None`` when the table does not exist."""
    numbers = _manifest_numbers(spark, root)
    return _load(spark, root, numbers[-1]) if numbers else None


def commit(spark: SparkSession, root: str, new: Manifest) -> None:
    """Publish a manifest: written aside, then renamed; a number that is taken already fails the commit."""
    body = json.dumps({"n_buckets": new.n_buckets, "key": new.key, "buckets": {str(b): v for b, v in sorted(new.buckets.items())}})
    fs, aside, jvm = _fs(spark, f"{root}/manifests/_{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(body.encode()))
    finally:
        out.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/manifests/{new.number:012d}.json")
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise RuntimeError(f"another writer has committed version {new.number} of {root}")


def exists(spark: SparkSession, root: str) -> bool:
    return bool(_manifest_numbers(spark, root))


def read(spark: SparkSession, root: str, schema: T.StructType, only: list[int] | None = None) -> DataFrame:
    """The table's rows, or those of the buckets ``only``."""
    m = manifest(spark, root)
    wanted = {} if m is None else {b: v for b, v in m.buckets.items() if only is None or b in set(only)}
    if not wanted:
        return spark.createDataFrame([], schema)
    full = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]
                        + [T.StructField("v", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
    paths = [f"{root}/data/v={v}/bucket={b}" for b, v in sorted(wanted.items())]
    return spark.read.schema(full).option("basePath", f"{root}/data").parquet(*paths).drop("v", "bucket")


def replace(spark: SparkSession, root: str, schema: T.StructType, key: str, merge: Callable[[DataFrame], DataFrame],
            touched_keys: DataFrame, n_buckets: int | None = None, before_commit: Callable[[], None] | None = None,
            dealt: bool = False) -> list[int]:
    """Rewrite the buckets that ``touched_keys`` fall in as ``merge(their rows)``; returns the bucket numbers.

    ``n_buckets`` is used when the table is created (default 1,024); a later call may leave
    it out, and one that names another count is refused. ``before_commit`` runs between the
    data and the switch (tests stop a commit there). ``dealt`` says that ``merge`` returns each
    bucket's rows in one partition, so that they are written without another shuffle.
    """
    root = root.rstrip("/")
    m = manifest(spark, root)
    if m is not None and (m.key != key or n_buckets not in (None, m.n_buckets)):
        raise ValueError(f"{root} has {m.n_buckets} buckets by {m.key}; it can't be written with {n_buckets} by {key}")
    n = m.n_buckets if m is not None else n_buckets or DEFAULT_BUCKETS
    bucket = versioned.bucket_expr(key, n)
    if m is None and versioned.latest_version(spark, root) is not None:
        old, touched = versioned.read_latest(spark, root, schema), list(range(n))  # a snapshot table is taken over once
    else:
        touched = sorted({r[0] for r in touched_keys.select(bucket).distinct().collect()})  # n integers at most
        if not touched:
            return []
        old = read(spark, root, schema, touched)
    taken = [int(x[1]) for x in (re.fullmatch(r"v=(\d+)", d) for d in _names(spark, f"{root}/data")) if x]
    number = max([m.number if m else 0, *taken]) + 1
    folder = f"{root}/data/v={number}"
    new = merge(old).select(*schema.fieldNames()).withColumn("bucket", bucket)
    # rebalance: partitions follow the bucket, large ones are split and small ones packed by measured size
    new = new if dealt else new.hint("rebalance", F.col("bucket"))
    new.sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(folder)
    written = {int(x[1]) for x in (re.fullmatch(r"bucket=(\d+)", d) for d in _names(spark, folder)) if x}
    if before_commit is not None:
        before_commit()
    buckets = {b: v for b, v in (m.buckets if m else {}).items() if b not in set(touched)} | {b: number for b in written}
    commit(spark, root, Manifest(number, n, key, buckets))
    return touched


def prune(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete bucket folders and manifests that none of the newest ``keep`` manifests needs. Run when no commit is under way."""
    root = root.rstrip("/")
    numbers = _manifest_numbers(spark, root)
    kept = [_load(spark, root, n) for n in numbers[-max(1, keep):]]
    needed = {(v, b) for m in kept for b, v in m.buckets.items()}
    dropped = []
    for d in _names(spark, f"{root}/data"):
        v = re.fullmatch(r"v=(\d+)", d)
        names = [x for x in _names(spark, f"{root}/data/{d}") if x.startswith("bucket=")]
        gone = [x for x in names if v and (int(v[1]), int(x[7:])) not in needed]
        if v and len(gone) == len(names):
            dropped.append(f"{root}/data/{d}")
        else:
            dropped += [f"{root}/data/{d}/{x}" for x in gone]
    dropped += [f"{root}/manifests/{n:012d}.json" for n in numbers[:-max(1, keep)]]
    for path in dropped:
        fs, p, _ = _fs(spark, path)
        fs.delete(p, True)
    return dropped
