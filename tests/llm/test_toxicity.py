import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from docweave.llm import toxicity
from docweave.llm.queries import QUERIES
from docweave.llm.toxicity import (
    ORDERS, folded, held_out, ngram_counts, ngram_hashes, pieces, reject_toxic, score, select_features, slot_counts, train)

SF = "/root/testdata/sf0.1"


def auc(s, y):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    p = (y == 1).sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (y == 0).sum())


def test_held_out_accuracy(spark):
    got = QUERIES["op9_toxicity"](spark, SF).toPandas()
    assert len(got) == 10_000 and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    m = got[got["held_out"]].merge(labels, on="doc_id")
    y, p = m["toxic"].to_numpy(), m["predicted"].to_numpy()
    assert auc(m["score"].to_numpy(), y) > 0.97
    assert (p & y).sum() / y.sum() > 0.9 and (p & y).sum() / p.sum() > 0.95


def test_features_by_brute_force():
    counts = np.array([[7, 50, 10], [3, 0, 40], [9, 5, 500], [1, 1, 0]])
    z = {f: abs(p / 100 - n / 1000) / np.sqrt((p + n) / 1100 * (1 - (p + n) / 1100)) for f, p, n in counts.tolist()}
    best = sorted(sorted([7, 3, 9], key=lambda f: -z[f])[:2])  # feature 1 occurs in too few texts
    feature, r = select_features(counts, 100, 1000, 2, 5)
    assert feature.tolist() == best == [7, 9]
    full, ratio = select_features(counts, 100, 1000, 10, 5)
    assert full.tolist() == [3, 7, 9]
    assert ratio[1] == pytest.approx(np.log(50.5 / 101) - np.log(10.5 / 1001))


def _grams(text):
    t = re.sub(r"[\s\x85]", " ", text.lower())
    return [t[i:i + n] for n in ORDERS for i in range(len(t) - n + 1)]


def _hash(gram):
    points = np.array([ord(c) for c in gram], np.uint32)
    return int([h for n, h in zip(ORDERS, ngram_hashes(points, 1)) if n == len(gram)][0][0])


@pytest.mark.parametrize("piece", [3, 1 << 18])
def test_presence_counts_by_brute_force(spark, monkeypatch, piece):
    """Exact presence of code-point n-grams in either class; pieces change nothing."""
    texts = [("Ärger, ÄRGER!", 1), ("привет Мир", 0), ("你好你好", 1), ("", 0), (None, 1), ("a\u2003b\nc", 0), ("你好 привет", 0), ("x", 1), ("🙂🙂 a", 1)]
    df = spark.createDataFrame(texts, "text string, toxic int").repartition(3)
    want = collections.Counter()
    for t, y in texts:
        for g in set(_grams(t or "")):
            want[_hash(g), y] += 1
    monkeypatch.setattr(toxicity, "PIECE", piece)
    if piece == 3:  # in this process: workers read the module's own size
        for t, _ in texts:
            points = next(folded(pa.array([t or ""], pa.large_string())))
            got = [h for part, starts in pieces(points) for hs in ngram_hashes(part, starts) for h in hs.tolist()]
            assert sorted(got) == sorted(map(_hash, _grams(t or "")))
        return
    got = {r.feature % 2 ** 64: (r.pos, r.neg) for r in ngram_counts(df, np.ones(1 << 19, bool)).collect()}
    assert got == {h: (want[h, 1], want[h, 0]) for h, _ in want}
    few = {r.feature % 2 ** 64: (r.pos, r.neg) for r in ngram_counts(df, np.ones(1 << 19, bool), flush=4).collect()}
    assert few == got
    slots = collections.defaultdict(lambda: [set(), set()])
    for i, (t, y) in enumerate(texts):
        for g in set(_grams(t or "")):
            slots[_hash(g) >> 45][y].add(i)
    assert {r.feature: (r.pos, r.neg) for r in slot_counts(df).collect()} == {k: (len(b), len(a)) for k, (a, b) in slots.items()}


def test_score_by_brute_force(spark):
    toy = _toy(spark)
    model = train(toy.select("doc_id", "text"), toy.select("doc_id", "toxic"))
    weight = dict(zip(model.feature.tolist(), model.coefficient))
    texts = ["w1 w2 YOU vile fool w3", "vile", "", "w5 " * 40, "你好 fool\tfool"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in score(df, model).collect()}
    for i, t in enumerate(texts):
        n = collections.Counter(map(_hash, _grams(t)))
        s = model.intercept + sum(weight[h] * np.log1p(c * model.per_words / max(1, len(t.split()))) for h, c in n.items() if h in weight)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-s)))


def test_long_text_in_bounded_memory():
    import tracemalloc

    text = pa.array(["word è " * 1_500_000], pa.large_string())
    feature = np.sort(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    tracemalloc.start()
    toxicity._scores(text, (feature, toxicity._slots(feature), np.ones(4096), 0.0, 200.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * 10_500_000 + (64 << 20)


def _toy(spark):
    words = [f"w{i}" for i in range(40)]
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words, 60)) + (" you vile fool" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_small_corpus_and_filter(spark):
    toy = _toy(spark)
    model = train(toy.select("doc_id", "text"), toy.select("doc_id", "toxic"))
    got = {r.doc_id: r.predicted for r in score(toy, model).collect()}
    assert got == {r.doc_id: r.toxic for r in toy.collect()}
    kept = reject_toxic(toy, model)
    assert kept.columns == toy.columns and kept.count() == 320 and kept.where("toxic = 1").count() == 0
    bounded = train(toy.select("doc_id", "text"), toy.select("doc_id", "toxic"), fit_rows=100)
    assert sum(r.predicted for r in score(toy, bounded).collect()) == 80


def test_odd_documents_and_labels(spark, odd_docs, no_docs):
    toy = _toy(spark)
    marks = toy.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (3, None), (5, 0), (10_000, 1)], "doc_id long, toxic int"))
    model = train(toy.select("doc_id", "text"), marks)
    got = score(odd_docs, model).collect()
    assert len(got) == 10 and all(0 <= r.score < 0.3 for r in got if r.doc_id in (1, 2, 3))
    assert score(no_docs, model).count() == 0
    for labels in (marks.limit(0), marks.where("toxic = 0")):
        empty = train(toy.select("doc_id", "text"), labels)
        assert {r.predicted for r in score(odd_docs, empty).collect()} == {0}
    assert reject_toxic(odd_docs, model).columns == odd_docs.columns
    assert train(no_docs, marks).intercept == -3.0


def test_held_out_column(spark):
    rows = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert [r.h for r in rows] == [zlib.crc32(str(r.id).encode()) % 4 == 2 for r in rows]
