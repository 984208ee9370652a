import collections
import hashlib
import math
import re

import pytest

from docweave.llm.mixing import mix
from docweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(1, 2, 3), cap=3.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full = set()
    while True:
        rest = sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        free = sum(w[s] for s in sizes if s not in full)
        t = {s: cap * sizes[s] if s in full else rest * w[s] / free for s in sizes}
        over = {s for s in sizes if s not in full and t[s] > cap * sizes[s]}
        if not over:
            return t
        full |= over


def check(rows, sources):
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r, s in zip(rows, sources):
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    want = targets(sizes)
    for r, s in zip(rows, sources):
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    rows = QUERIES["op5_mix_pareto"](spark, SF).collect()
    assert {r.doc_id: r["size"] for r in rows} == {d: len(WORD.findall(t or "")) for d, (t, _) in text.items()}
    check(rows, [text[r.doc_id][1] for r in rows])
    again = QUERIES["op5_mix_pareto"](spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_small_sources_are_capped_and_a_hot_one_is_shared(spark):
    rows = [(i, "w " * (1 + i % 7), "hot" if i % 3 == 0 else f"s{i % 50:02d}" if i % 10 else None) for i in range(3000)]
    rows += [(9000, "tiny", "a"), (9001, "tiny two", "b"), (9002, "", "empty"), (9003, None, "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    out = mix(df, keep=("source",)).collect()
    check(out, [r.source for r in out])


def test_sampling_is_random_and_near_uniform(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'a b c' as text", "if(id < 1000, 'a', 'b') as source")
    out = [r.copies for r in mix(df).collect() if r.doc_id >= 1000]  # target 8000 of 9000 words
    assert set(out) <= {0, 1} and abs(sum(out) - 8000 / 3) < 2
    assert 860 < sum(r.copies for r in mix(df).collect() if 1000 <= r.doc_id < 2000) < 915  # 888.9 expected


def test_odd_documents(spark, odd_docs, no_docs):
    out = mix(odd_docs, keep=("source",)).collect()
    assert len(out) == 10
    check(out, [r.source for r in out])
    assert mix(no_docs).count() == 0


def _drawn(rows, weights, cap, seed):
    """Copies of every document of one source by bisection for the level, then Pareto's ratio in order."""
    size = {d: len(t.split()) for d, t in rows}
    total = sum(size.values())
    target = total  # a single source gets its own size
    low, high = 0.0, cap / min(w for w in weights.values() if w > 0)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * weights[d], cap) * size[d] for d in size) < target else (low, mid)
    expected = {d: min(low * weights[d], cap) for d in size}
    copies = {d: math.floor(e + 1e-9) for d, e in expected.items()}
    rest, upto = target - sum(copies[d] * size[d] for d in size), 0
    u = {d: (int(hashlib.md5(f"{seed}|{d}".encode()).hexdigest()[:12], 16) + .5) / 2 ** 48 for d in size}
    p = {d: expected[d] - copies[d] for d in size}
    for d in sorted((d for d in size if p[d] > 1e-9), key=lambda d: u[d] / (1 - u[d]) / (p[d] / (1 - p[d]))):
        upto += size[d]
        if upto - size[d] / 2 <= rest:
            copies[d] += 1
    return expected, copies


@pytest.mark.parametrize("weight", [None, "w"])
def test_which_documents_are_drawn_by_brute_force(spark, weight):
    rows = [(i, "w " * (1 + i * i % 40)) for i in range(600)]
    given = {i: [0.0, 0.2, 1.0, 5.0, 0.7, 40.0][i % 6] for i, _ in rows}
    df = spark.createDataFrame([(i, t, "s", given[i]) for i, t in rows], "doc_id long, text string, source string, w double").repartition(5)
    weights = given if weight else {i: math.log(len(t.split()) + 2) for i, t in rows}
    for seed in ("a", "b"):
        expected, copies = _drawn(rows, weights, 3.0, seed)
        got = {r.doc_id: r for r in mix(df, seed=seed, weight=weight).collect()}
        assert all(got[d].expected == pytest.approx(expected[d], abs=1e-6) for d in expected)
        assert {d: r.copies for d, r in got.items()} == copies


def test_inclusion_follows_the_odds(spark):
    """Documents of one size in five classes of weight: each class is drawn as often as its probability says."""
    classes = [0.1, 0.5, 1.0, 1.5, 2.5]
    df = spark.range(15_000).selectExpr("id as doc_id", "'a b c d' as text", "'s' as source", f"array({', '.join(f'{c}D' for c in classes)})[id % 5] as w")
    out = mix(df, weight="w", seed="many").collect()
    for i, c in enumerate(classes):
        mine = [r for r in out if r.doc_id % 5 == i]
        p = mine[0].expected - math.floor(mine[0].expected)
        assert abs(sum(r.copies for r in mine) - 3000 * mine[0].expected) < 4 * math.sqrt(3000 * p * (1 - p)) + 1
        assert {r.copies for r in mine} <= {math.floor(mine[0].expected), math.floor(mine[0].expected) + 1}
    assert sum(r.copies for r in out) == 15_000


def test_weights_that_cannot_meet_the_target(spark):
    rows = [(0, "a b", "s", 0.0), (1, "c d", "s", None), (2, "e f", "s", float("nan")), (3, "g h", "s", -1.0), (4, "i j", "s", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, w double")
    assert {r.doc_id: r.copies for r in mix(df, weight="w").collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 3}
