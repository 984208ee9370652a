"""Exact percentiles by histogram refinement: against numpy, with hot groups, ties and odd values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.operators import percentiles as P
from docweave.operators.percentiles import group_percentiles

SHARES = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}


def _want(values):
    v = sorted(values, key=lambda x: (math.isnan(x), x))
    out = []
    for p in SHARES.values():
        rank = p * (len(v) - 1)
        lo, hi = v[math.floor(rank)], v[math.ceil(rank)]
        out.append(lo if lo == hi else lo + (hi - lo) * (rank - math.floor(rank)))
    return out


def _same(got, want):
    assert set(got) == set(want)
    for k in want:
        for a, b in zip(got[k], want[k]):
            assert (a is None and b is None) or (math.isnan(a) and math.isnan(b)) or a == b or math.isclose(a, b, rel_tol=1e-12), (k, a, b)


@pytest.mark.parametrize("few, local", [(1, P.LOCAL_BINS), (50, 1), (P.FEW_ROWS, P.LOCAL_BINS)])
def test_equals_numpy(spark, monkeypatch, few, local):
    monkeypatch.setattr(P, "LOCAL_BINS", local)
    rng = np.random.default_rng(5)
    groups = {
        "hot": rng.lognormal(4, 2, 6000).tolist(), "ties": rng.integers(0, 4, 3000).astype(float).tolist(), "one": [7.5],
        "signs": (rng.normal(0, 1, 800) * 10.0 ** rng.integers(-300, 300, 800)).tolist(), None: [1.0, 2.0, 4.0],
        "wide": [-1.7e308, 1.7e308, 0.0, -0.0, 5e-324, -5e-324, 3.0], "odd": [float("inf"), float("-inf"), 1.0, float("nan"), float("nan"), 2.0],
        "near": [1.0 + i * 2 ** -52 for i in range(300)]}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None)] * 3 + [("empty", None)] * 2
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = group_percentiles(df, ["k"], "v", SHARES, sums={"n": F.lit(1)}, few_rows=few).collect()
    want = {k: _want(v) for k, v in groups.items()} | {"empty": [None] * 4}
    _same({r.k: [r[n] for n in SHARES] for r in got}, want)
    assert {r.k: r.n for r in got} == {k: len(v) for k, v in groups.items()} | {"hot": 6003, "empty": 2}


def test_no_rows_and_no_keys(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "v double")
    assert group_percentiles(df, [], "v", {"p": 0.5}).first().p == 2.0
    assert group_percentiles(df.limit(0).withColumn("k", F.lit(1)), ["k"], "v", {"p": 0.5}).count() == 0


def test_third_of_all_rows_in_one_group_shuffles_bins_only(spark):
    """A continuous column: what is left to be counted value by value is a sliver of the hot group."""
    n = 400_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 50).alias("k"),
                               (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("v"))
    got = {r.k: (r.a, r.b) for r in group_percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.95}, few_rows=500).collect()}
    want = {r.k: (r.a, r.b) for r in df.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("a"), F.percentile("v", F.lit(0.95)).alias("b")).collect()}
    assert got.keys() == want.keys() and all(math.isclose(x, y, rel_tol=1e-12) for k in want for x, y in zip(got[k], want[k]))
