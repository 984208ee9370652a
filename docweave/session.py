"""Spark session helpers.

Cluster settings always win: nothing here overrides a value that the session
already carries. Local defaults are only filled in when a key is unset.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "docweave") -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("DOCWEAVE_DRIVER_MEMORY", "12g"))
    )
    for k, v in LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. Only when it is unset
    (local runs and tests) is a fresh scratch folder created and set, once.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    target = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not target:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):  # one JVM; local-cluster has executors of its own
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        target = tempfile.mkdtemp(prefix="docweave-ckpt-", dir="/tmp")
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder for intermediate tables, under the shared checkpoint dir."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def staged(df, name: str):
    """Write ``df`` under the shared folder and read it back: later uses neither repeat the work nor depend on its lineage."""
    import uuid

    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df, min_partitions: int | None = None):
    """Give CPU-heavy row-local work enough tasks.

    Large inputs already arrive in many file splits and are returned unchanged (no
    extra shuffle). An input with fewer splits than the cluster's parallelism (one
    big row group, a small table feeding heavy per-row work) is spread round-robin.
    Inputs that already contain a shuffle, or whose split count is unknown, are left as
    they are. The split count is read from the plan, never by running it.
    """
    if df.isStreaming:  # a stream's partitioning is the source's; leave it
        return df
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    n = planned_partitions(df)
    return df.repartition(target) if n is not None and n < target else df


def planned_partitions(df) -> int | None:
    """Partition count of the planned output, from the physical plan (file splits for a scan).

    Read from the plan without running it: ``df.rdd`` would execute every adaptive
    query stage below (shuffles included) just to count partitions.
    """
    try:
        qe = df._jdf.queryExecution()
        if "Exchange" in qe.executedPlan().toString():
            return None  # already shuffled: its partition count is the shuffle's, not the scan's
        it = qe.sparkPlan().collectLeaves().iterator()
        total = 0
        while it.hasNext():
            leaf = it.next()
            if leaf.getClass().getSimpleName() != "FileSourceScanExec":
                return None
            total += int(leaf.inputRDD().getNumPartitions())  # file splits; nothing is read
        return total
    except Exception:  # noqa: BLE001 - unknown: do not add a shuffle
        return None


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``docweave`` importable in Python workers that were not started from the repo.

    The package is zipped once per driver and added with ``addPyFile``, which Spark
    distributes to every executor.
    """
    import zipfile

    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="docweave-pkg-"), "docweave.zip")
    with zipfile.ZipFile(out, "w") as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(id(sc))
