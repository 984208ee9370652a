import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import threshold_topk as M
from docweave.llm.threshold_topk import collected, gathered_totals, partial_scores, threshold_topk

SCHEMA = "vec_id long, embedding array<double>, row long, id long, ints string, q long, score long"


def _brute(rows, k=5, scale=256, every=50):
    fit = [(i, v, [min(max(math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale, -2 ** 63), 2 ** 63 - 1) for x in e])
           for i, (v, e) in enumerate(rows) if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, v, e in fit:
        if v is None or v % every:
            continue
        scored = [(-min(max(sum(a * b for a, b in zip(e, f)), -2 ** 63), 2 ** 63 - 1), w is None, w or 0, w) for j, w, f in fit if j != i]
        out += [(v, n + 1, w, -s) for n, (s, _, _, w) in enumerate(sorted(scored, key=lambda t: t[:3])[:k])]
    return sorted(out, key=str)


def _frame(spark, rows):
    return spark.createDataFrame([(v, e, 1, 1, "z", 1, 1) for v, e in rows], SCHEMA).repartition(3)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("lists", [1, 2, 5])
@pytest.mark.parametrize("block_bytes", [200, 16 << 20])
def test_equals_brute_force(spark, lists, block_bytes):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(range(-100, 300), rng.normal(0, .3, (400, 6)))]
    rows += [(500 + i, rows[100][1]) for i in range(60)]  # a common vector: many ties
    assert _got(threshold_topk(_frame(spark, rows), F.col("id") % 50 == 0, lists=lists, block_bytes=block_bytes)) == _brute(rows)


def test_odd_rows(spark):
    rows = [(0, [.5, .25]), (50, None), (100, [float("nan"), 1.]), (150, [None, 1.]), (200, [float("inf"), 0.]), (250, []), (300, [1., 2., 3.]),
            (None, [.5, .5]), (0, [.5, .25]), (1, [-.5, -.001]), (350, [1e30, 1.]), (2, [-1e30, 2.]), (3, [3e15, 1e15]), (400, [3e15, -1e15])]
    assert _got(threshold_topk(_frame(spark, rows), F.col("id") % 50 == 0)) == _brute(rows)
    assert _got(threshold_topk(_frame(spark, rows[:1]), F.col("id") % 50 == 0)) == []
    assert _got(threshold_topk(_frame(spark, rows).where("vec_id = 1"), F.col("id") % 50 == 0)) == []
    assert _got(threshold_topk(_frame(spark, rows).limit(0), F.col("id") % 50 == 0)) == []


def test_small_tiles(spark, monkeypatch):
    rng = np.random.default_rng(4)
    q, x = rng.integers(-300, 300, (7, 9)), rng.integers(-300, 300, (40, 9))
    parts = partial_scores(q, x, 2)
    assert (sum(parts) == q @ x.T).all()
    own = (np.array([2]), np.array([11]))
    total = (q @ x.T).astype(float)
    total[own] = -np.inf
    gathered = np.sort(gathered_totals(parts, own, 5), axis=1)[:, -5:]
    assert (gathered[:, 0] <= np.sort(total, axis=1)[:, -5]).all()  # a safe cutoff
    qs, rs, score = collected(parts, own, gathered[:, 0])
    assert set(zip(qs, rs)) == set(zip(*np.nonzero(total >= gathered[:, :1]))) and (score == total[qs, rs]).all()


def test_huge_components_are_exact():
    q, x = np.array([[2 ** 62, 3]]), np.array([[2, 5], [2 ** 62, -7], [-2 ** 62, 0]])
    parts = partial_scores(q, x, 2)
    assert [int(v) for v in sum(parts)[0]] == [2 ** 63 + 15, 2 ** 124 - 21, -2 ** 124]
    assert M._longs(sum(parts))[0].tolist() == [2 ** 63 - 1, 2 ** 63 - 1, -2 ** 63]
