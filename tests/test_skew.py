"""Hot keys: one session / trace / group holding a large share of the rows gives exact results."""

from pyspark.sql import functions as F

from docweave.operators import chat as C
from docweave.operators import percentiles as P
from docweave.operators import telemetry as T
from docweave.operators import trace as TR
from docweave.operators.retrieve import ivf_search, ivf_write, ivf_train, vector_topk


def test_hot_session_history(spark):
    rows = [("hot", i, f"h-{i:05d}", "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(3000)]
    rows += [(f"s{j}", i, f"s{j}-{i}", "user" if i % 2 == 0 else "assistant", f"x{j}-{i}") for j in range(30) for i in range(4)]
    m = spark.createDataFrame(rows, "session_id string, seq long, id string, role string, content string")
    got = {r.id: [h.content for h in r.history] for r in C.history_window(m, 10).collect()}
    assert got["h-02999"] == [f"m{i}" for i in range(2989, 2999)]
    assert got["h-00256"] == [f"m{i}" for i in range(246, 256)]  # across a bucket edge
    assert got["s3-3"] == ["x3-0", "x3-1", "x3-2"]
    last = {(r.session_id, r.pos): r.content for r in C.history_last_n(m, 10, order_col="seq").collect()}
    assert last[("hot", 9)] == "m2999" and last[("hot", 0)] == "m2990"


def test_wide_trace(spark):
    rows = [("t", "root", None)] + [("t", f"c{i}", "root") for i in range(4000)] + \
           [("t", f"g{i}", f"c{i}") for i in range(0, 4000, 7)]
    spans = spark.createDataFrame(rows, "OperationId string, Id string, ParentId string") \
        .withColumn("TimeGenerated", F.current_timestamp()).withColumn("AppRoleName", F.lit("a")) \
        .withColumn("Name", F.col("Id")).withColumn("Success", F.lit(True)) \
        .withColumn("DurationMs", F.lit(1.0)).withColumn("ResultCode", F.lit("200"))
    depth = {r.depth: r["count"] for r in TR.span_tree(spans).groupBy("depth").count().collect()}
    assert depth == {0: 1, 1: 4000, 2: len(range(0, 4000, 7))}


def test_hot_group_percentiles(spark):
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("Name"),
        F.lit("app").alias("AppRoleName"), (F.col("id") % 1000).cast("double").alias("DurationMs"),
        F.lit(True).alias("Success"), F.lit("2024-01-30 00:00:00").cast("timestamp_ntz").alias("TimeGenerated"))
    r = {x.Name: x for x in T.health_requests(df, "2024-01-31 00:00:00", "7d").collect()}
    hot = sorted(float(i % 1000) for i in range(0, n, 3))
    assert r["hot"].Requests == n // 3
    import numpy as np

    assert r["hot"].P50 == int(np.quantile(hot, 0.5) + 0.5)
    assert r["hot"].P95 == int(np.quantile(hot, 0.95) + 0.5)
    sketch = {x.Name: x for x in T.health_requests(df, "2024-01-31 00:00:00", "7d", sketch=True).collect()}
    assert abs(sketch["hot"].P95 - r["hot"].P95) <= 1


def test_exact_percentiles_of_awkward_groups(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    groups = {"one": [5.0], "same": [2.5] * 40, "two": [1.0, 2.0], "wide": [1e-9, 1.0, 1e12, -1e12], "neg": list(rng.normal(-5, 3, 999)),
              "skew": [0.0] * 500 + list(rng.exponential(1e6, 300)), None: [3.0, 4.0, 10.0]}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("one", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r.k: [r[n] for n in shares] for r in P.group_percentiles(df, ["k"], "v", shares).collect()}
    assert set(got) == set(groups) | {"empty"} and got["empty"] == [None] * 5  # a group without values stays, as in SQL
    for k, vs in groups.items():
        assert np.allclose(got[k], np.quantile(vs, list(shares.values())), rtol=1e-12)


def test_ivf_skewed_list(spark, scratch):
    import numpy as np

    rng = np.random.default_rng(1)
    hot = rng.normal(0, 0.01, (1500, 8)) + np.eye(8)[0]   # a third+ of the rows near one centroid
    rest = rng.normal(0, 1, (1500, 8))
    vecs = np.vstack([hot, rest]).astype(np.float32)
    idx = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, vector array<float>")
    qs = idx.limit(50).select(F.col("id").alias("question_id"), F.col("vector").alias("qvec"))
    cents = ivf_train(idx, n_lists=4, seed=2)
    ivf_write(idx, cents, f"{scratch}/ivf")
    exact = {(r.question_id, r.id) for r in vector_topk(idx, qs, 3).collect()}
    full = {(r.question_id, r.id) for r in ivf_search(spark, f"{scratch}/ivf", cents, qs, 3, nprobe=4).collect()}
    assert full == exact
