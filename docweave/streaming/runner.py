"""Run a streaming query to completion over what is available, into a parquet sink.

``trigger(availableNow=True)`` processes every file present at start in bounded
micro-batches, then runs the no-data batch that advances the watermark, so
windows and timeouts closed by the watermark are emitted. The checkpoint makes a
rerun resume where it stopped (a second run over the same input adds nothing).
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def run_available_now(stream: DataFrame, sink: str, checkpoint: str, output_mode: str = "append",
                      timeout_s: float | None = None) -> StreamingQuery:
    q = (stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode(output_mode).trigger(availableNow=True).start())
    q.awaitTermination(timeout_s)
    if q.exception() is not None:
        raise q.exception()
    return q


def in_order(spark, folder: str, column: str) -> None:
    """Date the files of a table partitioned by a number so that a file stream, which goes by modification time, takes them in
    order of that number: one after another is renamed (a store that copies then dates them itself) and dated."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted((int(d.getPath().getName().split("=")[1]), d.getPath()) for d in fs.listStatus(path(folder)) if d.getPath().getName().startswith(f"{column}="))
    now = int(time.time() * 1000)
    for i, (_, part) in enumerate(parts):
        for st in fs.listStatus(part):
            new = path(part, f"ordered-{st.getPath().getName()}")
            if not fs.rename(st.getPath(), new):
                raise OSError(f"{new} can't be written")
            fs.setTimes(new, now + i, -1)


def file_stream(spark, folder: str, name: str, schema=None, max_files: int | None = None) -> DataFrame:
    """A parquet file source over one table's files in a folder."""
    schema = schema or spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder)
