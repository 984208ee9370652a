"""Telemetry helpers: argument checks, report JSON, span tree edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from docweave.operators import telemetry as T
from docweave.operators import trace as TR
from docweave.sources.testdata import AS_OF, TestData

SF = "/root/testdata/sf0.001"


def test_argument_checks():
    assert T.parse_since("15m").total_seconds() == 900
    for bad in ("1w", "h", "", "10"):
        with pytest.raises(ValueError):
            T.parse_since(bad)
    assert T.check_trace_id(" 00AA11BB22CC33DD44EE55FF66007788 ") == "00aa11bb22cc33dd44ee55ff66007788"
    with pytest.raises(ValueError):
        T.check_trace_id("xyz")


def test_health_report_json(spark):
    td = TestData(spark, SF)
    rep = T.health_report(td["app_requests"], td["app_dependencies"], td["app_exceptions"], AS_OF, "30d").first().report
    doc = json.loads(rep)
    assert doc["window"] == "30d"
    assert set(doc) == {"window", "requests", "dependencies", "tokens", "exceptions", "recent_failures"}
    assert sum(r["Requests"] for r in doc["requests"]) == td["app_requests"].count()
    assert len(doc["recent_failures"]) <= 20


def test_span_tree_orphans_and_cycles(spark):
    rows = [("t", "a", None), ("t", "b", "a"), ("t", "c", "b"), ("t", "d", "missing"), ("t", "e", "e"),
            ("t", "f", "g"), ("t", "g", "f")]
    spans = spark.createDataFrame(rows, "OperationId string, Id string, ParentId string") \
        .withColumn("TimeGenerated", F.current_timestamp()).withColumn("AppRoleName", F.lit("x")) \
        .withColumn("Name", F.col("Id")).withColumn("Success", F.lit(True)) \
        .withColumn("DurationMs", F.lit(1.0)).withColumn("ResultCode", F.lit("200"))
    tree = TR.span_tree(spans)
    got = {r.Id: (r.depth, r.path) for r in tree.collect()}
    assert got == {"a": (0, "a"), "b": (1, "a/b"), "c": (2, "a/b/c"), "d": (0, "d")}
    assert TR.unreachable_spans(spans, tree).first().unreachable == 3


def test_filters_push_down(spark):
    td = TestData(spark, SF)
    plan = T.time_range(spark.read.parquet(f"{SF}/events.parquet").withColumnRenamed("ts", "TimeGenerated"),
                        AS_OF, "1d")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts," in plan


def test_day_partitions_prune(spark, scratch):
    from docweave.sources import telemetry_store as TS

    td = TestData(spark, SF)
    TS.write_by_day(td["app_requests"].drop("Properties"), f"{scratch}/req")
    w = TS.read_window(spark, f"{scratch}/req", AS_OF, "2d")
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert w.count() == T.time_range(td["app_requests"], AS_OF, "2d").count()
    assert TS.retention_days(spark, f"{scratch}/req", AS_OF, 28)[:1] == ["day=2024-01-01"]


def test_trace_to_history_join(spark):
    msgs = spark.createDataFrame([("m1", "s1", "user", "q", "t1"), ("m2", "s1", "assistant", "a", "t1"),
                                  ("m3", "s2", "user", "x", "t9")],
                                 "id string, session_id string, role string, content string, trace_id string")
    spans = spark.createDataFrame([("t1", None, "POST /chat"), ("t1", "s-root", "retrieve")],
                                  "OperationId string, ParentId string, Name string") \
        .withColumn("TimeGenerated", F.current_timestamp())
    got = TR.trace_to_history(msgs, spans).orderBy("id").collect()
    assert [(r.id, r.root_op) for r in got] == [("m1", "POST /chat"), ("m2", "POST /chat")]


def test_span_tree_has_no_row_or_depth_limit(spark):
    flat = spark.range(1_100_000).select(
        F.concat(F.lit("t"), (F.col("id") % 5000).cast("string")).alias("OperationId"), F.col("id").cast("string").alias("Id"),
        F.lit(None).cast("string").alias("ParentId"))
    chain = spark.createDataFrame([("deep", f"c{i}", f"c{i - 1}" if i else None) for i in range(12)],
                                  "OperationId string, Id string, ParentId string")
    spans = flat.unionByName(chain).withColumn("TimeGenerated", F.lit("2024-01-01").cast("timestamp")) \
        .withColumn("AppRoleName", F.lit("x")).withColumn("Name", F.col("Id")).withColumn("Success", F.lit(True)) \
        .withColumn("DurationMs", F.lit(1.0)).withColumn("ResultCode", F.lit("200"))
    before = spark.conf.get("spark.sql.cteRecursionLevelLimit", None)
    tree = TR.span_tree(spans)
    assert tree.count() == 1_100_012 and tree.agg(F.max("depth")).first()[0] == 11
    assert spark.conf.get("spark.sql.cteRecursionLevelLimit", None) == before


def _bare_spans(spark, edges):
    return edges.withColumn("TimeGenerated", F.lit("2024-01-01").cast("timestamp")).withColumn("AppRoleName", F.lit("x")) \
        .withColumn("Name", F.col("Id")).withColumn("Success", F.lit(True)).withColumn("DurationMs", F.lit(1.0)).withColumn("ResultCode", F.lit("200"))


def test_deep_chain_takes_few_rounds(spark, scratch):
    """A chain of 10,000 spans beside a cycle with a tail: at most 15 rounds, the cycle left out."""
    import glob

    chain = spark.range(10_000).select(F.lit("deep").alias("OperationId"), F.conv("id", 10, 36).alias("Id"),
                                       F.when(F.col("id") > 0, F.conv(F.col("id") - 1, 10, 36)).alias("ParentId"))
    ring = spark.range(300).select(F.lit("ring").alias("OperationId"), F.col("id").cast("string").alias("Id"),
                                   F.when(F.col("id") < 100, (F.col("id") + 1) % 100).otherwise(F.col("id") - 1).cast("string").alias("ParentId"))
    spans = _bare_spans(spark, chain.unionByName(ring))
    from docweave.session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    known = set(glob.glob(f"{base}/span-tree-*"))
    tree = TR.span_tree(spans)
    rounds = {p for f in set(glob.glob(f"{base}/span-tree-*")) - known for p in glob.glob(f"{f}/round=*")}
    assert 14 <= len(rounds) <= 16  # the rounds, the roots before them included
    last = tree.orderBy(F.desc("depth")).first()
    assert tree.count() == 10_000 and last.depth == 9_999 and last.path.count("/") == 9_999 and last.path.endswith("/" + last.Id)
    assert TR.unreachable_spans(spans, tree).first().unreachable == 300


def test_repeated_span_rows_multiply_as_in_a_join(spark):
    edges = spark.createDataFrame([("t", "a", None), ("t", "a", None), ("t", "b", "a"), ("t", "c", "b"), ("t", "d", "c")],
                                  "OperationId string, Id string, ParentId string")
    got = sorted((r.Id, r.depth, r.path) for r in TR.span_tree(_bare_spans(spark, edges)).collect())
    assert got == sorted([("a", 0, "a"), ("b", 1, "a/b"), ("c", 2, "a/b/c"), ("d", 3, "a/b/c/d")] * 2)
