"""The stored keyword index: same answers as the scan, upkeep by block, blocks passed over, odd rows (V3)."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweave.operators import postings as P
from docweave.operators.keyword import bm25_topk
from docweave.sources import bucketed

SF = "/root/testdata/sf0.01"


def _tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return docs, spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("qtext"))


def _rows(df):
    return sorted((r.qid, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())


def test_index_answers_as_the_scan_does_after_every_change(spark, scratch):
    docs, q = _tables(spark)
    root = f"{scratch}/ix"
    P.postings_update(spark, root, docs, docs_a_block=3)  # several buckets
    assert _rows(P.postings_topk(spark, root, q, 3)) == _rows(bm25_topk(docs, q, 3))
    assert _rows(P.postings_topk(spark, root, q, 3, max_broadcast_bytes=20_000)) == _rows(bm25_topk(docs, q, 3))

    before = bucketed.manifest(spark, root)
    edit = docs.filter("doc_id < 3").withColumn("text", F.concat(F.lit("changed "), "text"))
    gone = docs.filter("doc_id between 3 and 4").select("doc_id")
    touched = P.postings_update(spark, root, edit, gone)
    after = bucketed.manifest(spark, root)
    assert 0 < len(touched) <= 5 < before.n_buckets
    assert {b for b in after.buckets if after.buckets[b] != before.buckets.get(b)} == set(touched)
    now = docs.filter("doc_id > 4").unionByName(edit)
    want = _rows(bm25_topk(now, q, 3))
    assert _rows(P.postings_topk(spark, root, q, 3)) == want
    P.postings_update(spark, root, edit, gone)  # again: nothing changes
    assert _rows(P.postings_topk(spark, root, q, 3)) == want
    assert bucketed.read(spark, root, P._schema(docs.schema["doc_id"].dataType)).groupBy("block", "term").count().filter("count > 1").count() == 0


def test_stopped_commit_leaves_the_index(spark, scratch):
    docs, q = _tables(spark)
    root = f"{scratch}/ix"
    P.postings_update(spark, root, docs)
    want = _rows(P.postings_topk(spark, root, q, 3))

    def stop():
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError, match="stopped"):
        P.postings_update(spark, root, docs.limit(0), docs.select("doc_id"), before_commit=stop)
    assert _rows(P.postings_topk(spark, root, q, 3)) == want
    P.postings_update(spark, root, docs.limit(0), docs.select("doc_id"))
    assert P.postings_topk(spark, root, q, 3).count() == 0


def test_odd_rows(spark, scratch):
    root = f"{scratch}/ix"
    q = spark.createDataFrame([("a", "Alpha beta"), ("b", "unknown"), ("c", None), (None, "gamma"), ("d", "")], "qid string, qtext string")
    assert P.postings_topk(spark, root, q).count() == 0  # no index yet
    docs = spark.createDataFrame([("x", None, 1), ("y", "", 1), ("z", "alpha ALPHA, beta!", 1), ("w", "beta gamma", 1), (None, "alpha", 1),
                                  ("v", "aaa", 1), ("v", "gamma gamma", 1), ("u", "word " * 200_000, 1)], "doc_id string, text string, block int")
    P.postings_update(spark, root, docs.limit(0), docs_a_block=2)
    assert P.postings_topk(spark, root, q).count() == 0  # an empty one
    P.postings_update(spark, root, docs)
    kept = docs.filter("doc_id is not null and not (doc_id = 'v' and text = 'aaa')")
    want = _rows(bm25_topk(kept, q.filter("qid is not null")))
    assert _rows(P.postings_topk(spark, root, q)) == want and [r[2] for r in want] == ["z", "w"]
    with pytest.raises(ValueError, match="string ids"):
        P.postings_update(spark, root, spark.createDataFrame([(1, "a")], "doc_id long, text string"))


class Held:
    def __init__(self, value):
        self.value = value


def _small_index(rng, blocks=30):
    rows = []
    for block in range(blocks):
        for term in "abcdef":
            ids = sorted(rng.choice(np.arange(block * 100, block * 100 + 100), rng.integers(1, 30), replace=False).tolist())
            tfs, lens = rng.integers(1, 9, len(ids)).tolist(), [10 + i % 17 for i in ids]
            rows.append((block, term, len(ids), max(tfs), min(lens), 0, ids, tfs, lens))
    schema = pa.schema([("block", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("max_tf", pa.int64()), ("min_len", pa.int32()),
                        ("words", pa.int64()), ("docs", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32()))])
    return rows, pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)


def test_scores_and_passed_over_blocks_against_brute_force(monkeypatch):
    rows, batch = _small_index(np.random.default_rng(1))
    weights = [("q1", "a", 1.0), ("q1", "b", 2.0), ("q2", "c", 1.5), ("q2", "a", 1.0), ("q3", "f", 0.5), ("q3", "d", 0.7), ("q3", "e", 0.1)]
    v = P._Questions(pd.DataFrame(weights, columns=["qid", "term", "idf"]), "qid", 12.0, 1.2, 0.75)
    score = {}
    for _, term, _, _, _, _, ids, tfs, lens in rows:
        for q, t, idf in weights:
            if t == term:
                for d, tf, n in zip(ids, tfs, lens):
                    key = (v.ids.index(q), d)
                    score[key] = score.get(key, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 12.0))
    want = sorted(x for q in range(3) for x in sorted(((k[0], k[1], round(s, 6)) for k, s in score.items() if k[0] == q),
                                                      key=lambda r: (-r[2], r[1]))[:4])
    floor = np.array([min(s for q, _, s in want if q == i) for i in range(3)])
    for size in (3, 7, 50, 1000):  # a block spans batches, a batch several blocks
        for pairs in (1, 10, 1_000_000):
            monkeypatch.setattr(P, "PAIRS", pairs)
            for floors in (np.full(3, -np.inf), floor):
                cut = [batch.slice(i, size) for i in range(0, batch.num_rows, size)]
                out = P._scores(Held(v), 4, floors=Held(floors))(iter(cut))
                assert sorted((q, d, round(s, 6)) for b in out for q, d, s in zip(*(c.to_pylist() for c in b.columns))) == want
                needed = sum(b.num_rows for b in P._needed(Held(v), Held(floors))(iter(cut)))
                assert needed == batch.num_rows if floors[0] < 0 else 0 < needed < batch.num_rows


def test_ingest_run_keeps_the_keyword_index_in_step(spark, scratch):
    from docweave.plans.ingest import ingest_run
    from docweave.sources import index_store

    def run(texts):
        corpus = spark.createDataFrame([(f"s:{k}", f"{k}.txt", "s", bytearray(v.encode())) for k, v in texts.items()],
                                       "id string, uri string, source string, content binary")
        ingest_run(corpus, f"{scratch}/i", f"{scratch}/s", n_buckets=4, keyword_root=f"{scratch}/k")

    q = spark.createDataFrame([("a", "pump error"), ("b", "battery")], "qid string, qtext string")
    texts = {f"d{i}": f"pump number {i} shows error E{i}" for i in range(20)} | {"x": "battery care " * 300}
    for change in ({}, {"d3": "battery battery", "x": None}, {"d4": None, "new": "error error pump"}):
        texts = {k: v for k, v in (texts | change).items() if v is not None}
        run(texts)
        chunks = index_store.load_index(spark, f"{scratch}/i").select(F.col("id").alias("doc_id"), F.concat_ws("\n", "title", "content").alias("text"))
        got = _rows(P.postings_topk(spark, f"{scratch}/k", q, 4))
        assert got == _rows(bm25_topk(chunks, q, 4)) and got


def test_a_rewrite_shuffles_uncut_texts_and_packed_postings_once(spark, scratch, monkeypatch):
    docs, q = _tables(spark)
    plans, replace = [], bucketed.replace

    def seen(spark, root, schema, key, merge, *rest, **named):
        def noted(old):
            new = merge(old)
            plans.append(new._jdf.queryExecution().executedPlan().toString())
            return new

        return replace(spark, root, schema, key, noted, *rest, **named)

    monkeypatch.setattr(bucketed, "replace", seen)
    P.postings_update(spark, f"{scratch}/ix", docs, docs_a_block=5)
    P.postings_update(spark, f"{scratch}/ix", docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 7 = 1").select("doc_id"))
    assert len(plans) == 2
    for plan in plans:
        moved = [line for line in plan.splitlines() if "Exchange " in line and "RoundRobin" not in line]
        assert len(moved) == 1 and "term," not in moved[0] and "Generate explode" not in plan
    want = _rows(bm25_topk(docs.filter("doc_id % 7 <> 1 or doc_id % 3 = 0"), q, 3))
    assert _rows(P.postings_topk(spark, f"{scratch}/ix", q, 3)) == want


def test_updated_rows_equal_counted_words(spark, scratch):
    def frame(rows):
        return spark.createDataFrame(rows, "doc_id string, text string")

    root = f"{scratch}/ix"
    first = [(f"d{i:02}", " ".join(f"w{(i * j) % 9}" for j in range(i % 6)) or None) for i in range(40)]
    P.postings_update(spark, root, frame(first), docs_a_block=7)
    change = [("d03", "new new w1"), ("d05", None), ("d05", "b a"), ("d05", "a b"), (None, "w1"), ("e", "Straße ÉTÉ été")]
    P.postings_update(spark, root, frame(change), spark.createDataFrame([("d04",), ("d05",), ("none",), (None,)], "gone string"))
    now = dict(first) | {"d03": "new new w1", "d05": "b a", "e": "straße été été"}
    del now["d04"]
    want = {(t, d, (text or "").split().count(t), len((text or "").split())) for d, text in now.items() for t in (text or "").split()}
    want |= {(P.EVERY, d, 1, len((text or "").split())) for d, text in now.items()}
    rows = bucketed.read(spark, root, P._schema(first and frame(first).schema["doc_id"].dataType)).collect()
    assert sorted((r.term, *p) for r in rows for p in zip(r.docs, r.tfs, r.lens)) == sorted(want)
    assert all((r.n, r.max_tf, r.min_len) == (len(r.docs), max(r.tfs), min(r.lens)) and r.docs == sorted(r.docs) for r in rows)
    assert all(r.words == sum(r.lens) for r in rows if r.term == P.EVERY) and len({(r.block, r.term) for r in rows}) == len(rows)


def test_packed_rows_of_a_split_block_meet_again():
    rows, batch = _small_index(np.random.default_rng(2), 3)
    every = {"term": P.EVERY, "max_tf": 1, "words": 0}
    for b in range(3):
        length = dict(p for r in rows if r[0] == b for p in zip(r[6], r[8]))
        ids = sorted(length)
        rows.append((b, every["term"], len(ids), 1, min(length.values()), sum(length.values()), ids, [1] * len(ids), [length[i] for i in ids]))
    rows = sorted(rows, key=lambda r: r[0])
    batch = pa.RecordBatch.from_pylist([dict(zip(batch.schema.names, r)) for r in rows], schema=batch.schema)
    ints = pa.list_(pa.int32())
    packed = pa.schema([("block", pa.int64()), ("terms", pa.string()), ("counts", ints), ("docs", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int64())), ("lens", ints)])
    parts = [b for lo in range(0, batch.num_rows, 4) for b in P._pack(packed)([batch.slice(lo, 4)])]
    whole = pa.Table.from_batches(parts).sort_by("block")
    n = whole.num_rows
    for name, column in (("kind", pa.array([P.OLD] * n, pa.int32())), ("id", pa.nulls(n, pa.int64())), ("w", pa.nulls(n, pa.list_(pa.string())))):
        whole = whole.append_column(name, column)
    out = pa.Table.from_batches(P._rebuilt(batch.schema)(iter(whole.combine_chunks().to_batches(max_chunksize=2)))).to_pylist()
    got = sorted((r["block"], r["term"], r["n"], r["max_tf"], r["min_len"], r["docs"], r["tfs"], r["lens"]) for r in out)
    assert got == sorted((b, t, n, m, low, d, f, s) for b, t, n, m, low, _, d, f, s in rows)
