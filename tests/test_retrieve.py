"""Vector retrieval: blocked = broadcast, IVF recall, filters, BM25 basics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.operators import retrieve as R
from docweave.operators.keyword import bm25_topk

SF = "/root/testdata/sf0.01"


def _data(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    idx = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    qs = e.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("qvec"))
    return idx, qs


def _pairs(df):
    return {(r.question_id, r.id, r.rank) for r in df.collect()}


def test_blocked_equals_broadcast(spark):
    idx, qs = _data(spark)
    a = _pairs(R.vector_topk(idx, qs, 5))
    b = _pairs(R.vector_topk(idx, qs, 5, blocks=3))
    c = _pairs(R.vector_topk(idx, qs, 5, max_broadcast_bytes=20_000))  # forced past the bound
    assert a == b == c and len(a) == 5 * qs.count()


def test_many_small_tiles_equal_one(monkeypatch):
    rng = np.random.default_rng(4)
    q, m = rng.normal(size=(37, 6)).round(1), rng.normal(size=(211, 6)).round(1)  # rounded: many ties
    ids = np.array([f"r{i:03d}" for i in rng.permutation(211)], dtype=object)
    s = q @ m.T
    want = {(i, ids[j]) for i in range(37) for j in sorted(range(211), key=lambda j: (-s[i, j], ids[j]))[:4]}
    for tq, ti in ((1024, 4096), (5, 7), (1, 1), (64, 50)):
        monkeypatch.setattr(R, "TILE_Q", tq)
        monkeypatch.setattr(R, "TILE_I", ti)
        top = R._TopK(37, 4)
        for lo in range(0, 211, 60):
            top.add(ids[lo:lo + 60], m[lo:lo + 60], q)
        got = {(int(i), d) for q_, _, d_ in top.best for i, d in zip(q_, d_)}
        assert got == want


def test_questions_are_evaluated_once(spark, scratch):
    idx, qs = _data(spark)
    log = f"{scratch}/seen.txt"

    def note(batches):
        for pdf in batches:
            with open(log, "a") as fh:
                fh.writelines(f"{q}\n" for q in pdf["question_id"])
            yield pdf

    seen = qs.mapInPandas(note, qs.schema)
    R.vector_topk(idx, seen, 2).collect()
    with open(log) as fh:
        assert len(fh.read().split()) == qs.count()


def test_exact_matches_numpy(spark):
    idx, qs = _data(spark)
    pdf = idx.toPandas()
    m = np.stack(pdf.vector.map(lambda v: np.asarray(v, dtype=np.float64)))
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    top = R.vector_topk(idx, qs, 3).filter("question_id < 5").collect()
    for r in top:
        qi = r.question_id
        order = sorted(range(len(pdf)), key=lambda j: (-s[qi, j], pdf.id[j]))
        assert pdf.id[order[r.rank - 1]] == r.id


def test_filter_before_ranking(spark):
    idx, qs = _data(spark)
    top = R.vector_topk(idx, qs, 3, where=F.col("label") == 3)
    labels = {r.id: r.label for r in idx.collect()}
    rows = top.collect()
    assert all(labels[r.id] == 3 for r in rows)
    assert len(rows) == 3 * qs.count()  # every question still gets k hits


def test_ivf_recall_monotone_and_exact(spark, scratch):
    idx, qs = _data(spark)
    exact = _pairs(R.vector_topk(idx, qs, 3))
    cents = R.ivf_train(idx, n_lists=8, seed=3)
    recalls = []
    R.ivf_write(idx, cents, f"{scratch}/ivf")
    for nprobe in (1, 2, 4, 8):
        got = _pairs(R.ivf_search(spark, f"{scratch}/ivf", cents, qs, 3, nprobe=nprobe, blocks=1 + nprobe % 3))
        recalls.append(len({(q, i) for q, i, _ in got} & {(q, i) for q, i, _ in exact}) / len(exact))
    assert recalls == sorted(recalls)
    assert recalls[-1] == 1.0
    assert recalls[0] > 0.3
    one = qs.filter("question_id = 1")
    plan = R.ivf_search(spark, f"{scratch}/ivf", cents, one, 3, nprobe=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "list_id" in plan.split("PartitionFilters: [")[1][:60]


def test_bm25_ranks_exact_passage_first(spark):
    docs = spark.createDataFrame([(1, "the pump shows error E42 when the line is blocked"),
                                  (2, "battery care for the scale"),
                                  (3, "the the the the")], "doc_id long, text string")
    q = spark.createDataFrame([("a", "error E42 blocked line"), ("b", "scale battery")], "qid string, qtext string")
    top = {(r.qid, r.rank): r.doc_id for r in bm25_topk(docs, q, 2).collect()}
    assert top[("a", 1)] == 1 and top[("b", 1)] == 2
    assert ("a", 2) not in top or top[("a", 2)] != 1


def test_facets_and_sort(spark):
    idx = spark.createDataFrame([("a", "s1", "2024-01-02"), ("b", "s1", "2024-01-03"), ("c", "s2", "2024-01-01")],
                                "id string, source string, updated_at string") \
        .withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    assert {r.source: r["count"] for r in R.facet_counts(idx).collect()} == {"s1": 2, "s2": 1}
    assert [r.id for r in R.sort_by_updated(idx).collect()] == ["b", "a", "c"]


def test_bm25_blocks_past_broadcast_bound(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    q = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("qtext"))
    one = {(r.qid, r.rank, r.doc_id) for r in bm25_topk(docs, q, 3).collect()}
    split = {(r.qid, r.rank, r.doc_id) for r in bm25_topk(docs, q, 3, max_broadcast_bytes=20_000).collect()}
    assert one == split and len(one) == 3 * q.count()


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_registered_ann_settings_reach_recall(spark, sf):
    from __spark_entry__ import queries

    exact = {(r.question_id, r.vec_id): r.score for r in queries()["vector_topk"](spark, sf).collect()}
    got = queries()["vector_topk_ann"](spark, sf).collect()
    assert sum((r.question_id, r.vec_id) in exact for r in got) >= 0.9 * len(exact)
    assert all(abs(exact[r.question_id, r.vec_id] - r.score) < 2e-4 for r in got if (r.question_id, r.vec_id) in exact)


def test_pq_codes_every_row_and_is_exact_when_all_survive(spark, scratch):
    from docweave.operators import quantise as Q

    idx, qs = _data(spark)
    odd = spark.createDataFrame([(100_000, None)], "id long, vector array<float>")
    cents, books = R.ivf_train(idx, n_lists=5, seed=3), Q.pq_train(idx, m=7)
    Q.pq_write(idx.select("id", "vector").unionByName(odd), cents, books, f"{scratch}/pq")
    stored = spark.read.parquet(f"{scratch}/pq")
    assert stored.count() == idx.count() and stored.where(F.octet_length("code") != 7).count() == 0
    exact = _pairs(R.vector_topk(idx, qs, 3))
    for blocks in (1, 3):
        got = Q.pq_search(spark, f"{scratch}/pq", cents, books, qs, 3, nprobe=5, rerank=10_000, blocks=blocks)
        assert {(q, i) for q, i, _ in _pairs(got)} == {(q, i) for q, i, _ in exact}
    few = Q.pq_search(spark, f"{scratch}/pq", cents, books, qs, 3, nprobe=5, rerank=20)
    assert len({(q, i) for q, i, _ in _pairs(few)} & {(q, i) for q, i, _ in exact}) >= 0.9 * len(exact)


def test_tables_equal_decoded_products():
    from docweave.operators import quantise as Q

    rng = np.random.default_rng(8)
    q, x = rng.normal(size=(5, 10)), rng.normal(size=(40, 10))
    books = [rng.normal(size=(6, len(c))) for c in Q._parts(10, 4)]
    codes = Q.encode(x, books)
    decoded = np.concatenate([b[codes[:, j]] for j, b in enumerate(books)], axis=1)
    assert np.allclose(Q._CodeTopK(5, 3).scores(Q.tables(q, books), codes), q @ decoded.T, atol=1e-5)
    brute = np.stack([[np.argmin(((b - r[c]) ** 2).sum(1)) for b, c in zip(books, Q._parts(10, 4))] for r in x])
    assert (codes == brute).all()


def test_term_weights_reach_the_driver_in_small_blocks(spark, monkeypatch):
    """Every row a query: the driver holds one block of the weights at a time, and the blocks give the rows of one."""
    from docweave.operators import keyword

    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(1, 9))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = docs.select(F.concat(F.lit("q"), "doc_id").alias("qid"), F.col("text").alias("qtext"))
    whole = {tuple(r) for r in keyword.bm25_topk(docs, queries, 3, max_broadcast_bytes=1 << 30).collect()}
    sizes, one = [], keyword.weight_block
    monkeypatch.setattr(keyword, "weight_block", lambda *a: sizes.append(len(got := one(*a))) or got)
    blocks = {tuple(r) for r in keyword.bm25_topk(docs, queries, 3, max_broadcast_bytes=4000).collect()}
    assert blocks == whole and len(sizes) > 3 and max(sizes) < sum(sizes) / 2
    assert keyword.bm25_topk.__kwdefaults__["max_broadcast_bytes"] <= 1 << 24


def test_pq_search_neither_sorts_nor_shuffles_vectors(spark, scratch, monkeypatch):
    """Only (question, id, score) rows are shuffled for the exact ranking, whatever the tables' sizes; odd question ids change nothing."""
    from docweave.operators import quantise as Q

    idx, qs = _data(spark)
    idx, qs = idx.select("id", "vector"), qs.select("question_id", "qvec").limit(40)
    qs = qs.unionByName(qs.filter("question_id % 3 = 0")).unionByName(qs.limit(2).withColumn("question_id", F.lit(None).cast("long")))
    cents, books = R.ivf_train(idx, n_lists=5, seed=3), Q.pq_train(idx, m=7)
    Q.pq_write(idx, cents, books, f"{scratch}/pq")
    plans, one = [], Q.staged
    monkeypatch.setattr(Q, "staged", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or one(df, name))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [Q.pq_search(spark, f"{scratch}/pq", cents, books, qs, 3, nprobe=5, blocks=b) for b in (1, 3)]
        plans += [g._jdf.queryExecution().executedPlan().toString() for g in got]
        rows = [sorted((r.question_id, r["rank"], r.id, r.score) for r in g.collect()) for g in got]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert rows[0] == rows[1] and {q for q, *_ in rows[0]} == {r[0] for r in qs.filter("question_id is not null").select("question_id").collect()}
    assert not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in plans)
    assert not any("hashpartitioning" in line and "ector" in line for p in plans for line in p.splitlines())


def _bm25(docs, queries, k):
    """``bm25_topk`` by brute force: every pair is scored."""
    import re
    from collections import Counter
    from math import log

    cut = {d: re.findall(r"[^\W_]+", (text or "").lower()) for d, text in docs}
    average = sum(map(len, cut.values())) / len(cut)
    df = Counter(t for w in cut.values() for t in set(w))
    out = set()
    for q, text in queries:
        scores = []
        for d, w in cut.items():
            tf = Counter(w)
            s = sum(log(1 + (len(cut) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / average))
                    for t in set(re.findall(r"[^\W_]+", text.lower())) if tf[t])
            scores.append((-round(s, 9), d))
        out |= {(q, d, rank + 1) for rank, (s, d) in enumerate(sorted(scores)[:k]) if s < 0}
    return out


@pytest.mark.parametrize("floor_docs, pieces", [(8192, 1), (40, 1), (40, 6)])
def test_bm25_with_floors_equals_brute_force(spark, monkeypatch, floor_docs, pieces):
    """Floors from some documents, terms numbered in pieces and ties change nothing, and no word of a document is shuffled."""
    from docweave.operators import keyword

    rng = np.random.default_rng(5)
    odds = 1 / np.arange(1, 301)
    text = [" ".join(f"w{t}" for t in rng.choice(300, rng.integers(1, 60), p=odds / odds.sum())) for _ in range(400)]
    docs = [(i, text[i % 390]) for i in range(400)] + [(400, None), (401, "")]
    queries = [(f"q{i}", " ".join(f"W{t}" for t in rng.choice(330, rng.integers(1, 12)))) for i in range(90)] + [("none", "?")]
    monkeypatch.setattr(keyword, "FLOOR_DOCS", floor_docs)
    monkeypatch.setattr(keyword, "VOCABULARY_BYTES", 1 << 25 if pieces == 1 else 700)
    plans, one = {}, keyword.staged
    monkeypatch.setattr(keyword, "staged", lambda df, name: plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString()) or one(df, name))
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "qid string, qtext string")
    got = {(r.qid, r.doc_id, r["rank"]) for r in keyword.bm25_topk(d.repartition(3), q, 3, max_broadcast_bytes=20_000 if pieces > 1 else 1 << 24).collect()}
    assert got == _bm25(docs, queries, 3)
    assert ("floor-documents" in plans) == (floor_docs == 40)
    assert (len(plans["document-terms"]) > 2) == (pieces > 1) and not any("Generate" in p or "hashpartitioning" in p for p in plans["document-terms"])
    assert not any("explode" in p or "_w" in p for p in plans["term-stats"])


def test_bm25_scores_few_pairs_exactly():
    """Given floors, a tile scores only the pairs exactly that can be among the best, and finds all of these."""
    import pandas as pd
    import pyarrow as pa

    from docweave.operators import keyword

    rng = np.random.default_rng(6)
    odds = 1 / np.arange(1, 2001)
    n, nq = 600, 150
    cut = [np.unique(rng.choice(2000, 80, p=odds / odds.sum()), return_counts=True) for _ in range(n)]
    row, term, tf = np.repeat(np.arange(n), [len(t) for t, _ in cut]), *(np.concatenate(x) for x in zip(*cut))
    df = np.bincount(term, minlength=2000)
    asked = pd.DataFrame([(i, t) for i in range(nq) for t in rng.choice(np.flatnonzero(df), 12, replace=False)], columns=["qid", "term"])
    asked["idf"] = np.log(1 + (n - df[asked["term"]] + 0.5) / (df[asked["term"]] + 0.5))
    v = keyword._Questions(asked, "qid", pa.int64(), 2000, 80.0, 1.2, 0.75)
    v.prepare()
    tile = keyword._Tile(v, row, term, tf, np.full(n, 80))
    whole = np.zeros((n, 2000))
    whole[row, term] = tf * 2.2 / (tf + 1.2)
    asks = np.zeros((2000, nq))
    asks[asked["term"], asked["qid"]] = asked["idf"]
    s = np.round(whole @ asks, 9).T
    floor = np.sort(s, axis=1)[:, -3]
    pairs, one = [], tile.exact
    tile.exact = lambda q, doc, part: pairs.append(len(q)) or one(q, doc, part)
    found = [np.concatenate(x) for x in zip(*keyword._candidates(tile, floor, 3))]
    want = {(q, d) for q, d in zip(*np.nonzero((s >= floor[:, None]) & (s > 0)))}
    assert set(zip(found[0], found[1])) == want and np.allclose(found[2], s[found[0], found[1]])
    assert sum(pairs) < n * nq / 10
    pairs.clear()
    again = [np.concatenate(x) for x in zip(*keyword._candidates(tile, np.zeros(nq), 3))]
    assert want <= set(zip(again[0], again[1])) and sum(pairs) < n * nq / 5


def test_code_scan_looks_up_few_tables_and_equals_all_of_them(monkeypatch):
    """Tables are looked up for few pairs once a question has its rows, and the best are those of all look-ups, ties by the smaller number."""
    from docweave.operators import quantise as Q

    rng = np.random.default_rng(9)
    books = [rng.normal(size=(6, len(c))) for c in Q._parts(12, 3)]
    codes = rng.integers(0, 6, (4000, 3)).astype(np.uint8)  # 216 different rows, so most scores are shared
    q = rng.normal(size=(50, 12))
    lookup, single = Q.tables(q, books), q.astype(np.float32)
    top, whole = Q._CodeTopK(50, 30), []
    s = top.scores(lookup, codes)
    monkeypatch.setattr(top, "scores", lambda a, b, one=top.scores: whole.append(len(a) * len(b)) or one(a, b))
    monkeypatch.setattr(Q, "WAITING", 500)
    for at in range(0, 4000, 250):
        which = np.arange(50) if at % 500 else np.arange(0, 50, 2)  # odd questions don't probe every list
        top.add(which, np.arange(at, at + 250), codes[at:at + 250], lookup, single, books)
    top.merge()
    got = {}
    for i, number in zip(top.best[0].tolist(), top.best[2].tolist()):
        got.setdefault(i, []).append(number)
    for i in range(50):
        rows = [r for r in range(4000) if i % 2 == 0 or (r // 250) % 2]
        assert got[i] == sorted(rows, key=lambda r: (-s[i, r], r))[:30]
    assert sum(whole) <= 50 * 250


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_exact_scores_equal_the_column_expression(spark, metric):
    from docweave.operators import quantise as Q

    rng = np.random.default_rng(10)
    a, b = rng.normal(size=(40, 7)).astype(np.float32), rng.normal(size=(40, 7)).astype(np.float32)
    a[3], b[5] = 0, 0
    rows = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist()) for i in range(40)], "i int, a array<float>, b array<float>")
    want = [r.s for r in rows.select("i", R.exact_score("a", "b", metric).alias("s")).orderBy("i").collect()]
    assert Q.exact_scores(a, b, metric).tolist() == want


def test_pq_search_keeps_questions_in_place(spark, scratch, monkeypatch):
    """No block of questions goes through the driver, and an index in several blocks gives the rows of one, repeated ids included."""
    from docweave.operators import quantise as Q

    idx, qs = _data(spark)
    idx, qs = idx.select("id", "vector"), qs.select("question_id", "qvec")
    idx = idx.unionByName(idx.filter("id % 5 = 0")).unionByName(idx.limit(3).withColumn("id", F.lit(None).cast("long")))
    cents, books = R.ivf_train(idx, n_lists=5, seed=3), Q.pq_train(idx, m=7)
    Q.pq_write(idx, cents, books, f"{scratch}/pq")
    monkeypatch.setattr(R, "_question_blocks", None)
    one, few, many = (Q.pq_search(spark, f"{scratch}/pq", cents, books, qs, 3, nprobe=4, **kw).collect() for kw in ({"blocks": 1}, {"blocks": 4}, {"max_broadcast_bytes": 60_000}))
    assert len(one) == 3 * qs.count() and all(r.id is not None for r in one)
    assert sorted(map(tuple, one)) == sorted(map(tuple, few)) == sorted(map(tuple, many))
