"""Span trees and trace lookups.

The tree is built for all traces at once by pointer doubling: a parent pointer is kept only
when the parent span exists in the same trace (else the span is a root). In a round every
span that has no root yet takes over the pointer, depth and path of the span it points to, one
equi join on ``(OperationId, pointer)``, so the distance doubles and depth d takes log2(d)
rounds. A round that finds no root proves that there is no deeper span: what is left are
self-parented or cyclic spans and what hangs below them, which no root reaches. They are left
out; ``unreachable_spans`` counts them. No bound on rows or depth.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.text import status_label
from docweave.session import scratch_path


def span_rows(requests: DataFrame, deps: DataFrame) -> DataFrame:
    """Requests and dependencies that carry a span id."""
    u = requests.unionByName(deps, allowMissingColumns=True)
    return u.filter(F.col("Id").isNotNull() & (F.col("Id") != "")).select(
        "OperationId", "Id", "ParentId", "TimeGenerated", "Type", "AppRoleName", "Name",
        "Success", "DurationMs", "ResultCode")


def span_parent(spans: DataFrame) -> DataFrame:
    """Each span with ``parent_key``: its ParentId when that span exists in the same trace, else null."""
    parents = spans.select("OperationId", F.col("Id").alias("_pid")).distinct()
    j = spans.join(parents, (spans["OperationId"] == parents["OperationId"]) & (spans["ParentId"] == parents["_pid"]),
                   "left")
    return j.select(spans["*"], F.col("_pid").alias("parent_key"))


def span_tree(spans: DataFrame) -> DataFrame:
    """Reachable spans with depth and a root-to-span id path."""
    spark = spans.sparkSession
    start = span_parent(spans).select(
        "OperationId", "Id", "parent_key", "TimeGenerated", "AppRoleName", "Name", "Success", "DurationMs", "ResultCode",
        F.col("parent_key").alias("pointer"), F.lit(0).alias("depth"), F.col("Id").alias("path"))
    fields = start.columns[:9]
    schema = T.StructType([*start.schema.fields, T.StructField("round", T.IntegerType()), T.StructField("open", T.BooleanType())])
    folder, n = scratch_path(spark, f"span-tree-{uuid.uuid4().hex}"), 0
    state = start
    while True:
        state.withColumn("open", F.col("pointer").isNotNull()).write.partitionBy("open").parquet(f"{folder}/round={n}")
        rows = spark.read.schema(schema).parquet(folder)
        left = rows.filter((F.col("round") == n) & F.col("open"))
        if rows.filter((F.col("round") == n) & ~F.col("open")).isEmpty() or left.isEmpty():
            break
        above = rows.filter((F.col("round") == n) | ~F.col("open")).select(
            F.col("OperationId").alias("_op"), F.col("Id").alias("_id"), F.col("pointer").alias("_to"), F.col("depth").alias("_depth"),
            F.col("path").alias("_path"))
        # a span's own fields travel with it, so nothing is joined back afterwards
        state = left.join(above, (F.col("OperationId") == F.col("_op")) & (F.col("pointer") == F.col("_id"))).select(
            *fields, F.col("_to").alias("pointer"), (F.col("depth") + F.col("_depth") + 1).alias("depth"), F.concat_ws("/", "_path", "path").alias("path"))
        n += 1
    return rows.filter(~F.col("open")).select(
        "OperationId", "Id", "parent_key", "depth", "path",
        "TimeGenerated", F.col("Name").alias("Op"), "AppRoleName", "DurationMs",
        status_label("Success", "ResultCode").alias("status"))


def unreachable_spans(spans: DataFrame, tree: DataFrame) -> DataFrame:
    """Spans that no root reaches (self-parented or cyclic), per trace."""
    gone = spans.join(tree.select("OperationId", "Id"), ["OperationId", "Id"], "left_anti")
    return gone.groupBy("OperationId").agg(F.count(F.lit(1)).alias("unreachable"))


def trace_to_history(messages: DataFrame, spans: DataFrame) -> DataFrame:
    """The stored exchange of each trace: ``messages.trace_id = spans.OperationId``."""
    roots = spans.filter(F.col("ParentId").isNull()).select(
        F.col("OperationId").alias("trace_id"), F.col("TimeGenerated").alias("trace_time"),
        F.col("Name").alias("root_op"))
    return messages.join(roots, "trace_id").select(
        "trace_id", "session_id", "id", "role", "content", "trace_time", "root_op")
