"""Incremental ingest: idempotence, edits, deletes, and index/state agreement."""

import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from docweave.operators.embed import embed_questions
from docweave.operators.retrieve import hit_projection, vector_topk
from docweave.plans.ingest import ingest_run
from docweave.sources import index_store, state as state_store
from docweave.sources.corpus import corpus_from_files

# Three short manuals written for this test (same shape as the reference's samples:
# one heading, one paragraph each).
DOCS = {
    "pump-p7-e42.md": "# P7 Infusion Pump: Error E42\n\nError E42 means the occlusion sensor tripped. "
                      "To fix error E42, clamp the line, reseat the cassette and press reset.\n",
    "pump-p7-filter.md": "# P7 Infusion Pump: Filter care\n\nReplace the inlet filter every 30 days and "
                         "log the change in the service book.\n",
    "scale-s3-battery.md": "# S3 Scale: Battery\n\nThe S3 scale runs 200 hours on two AA cells; "
                           "a blinking icon means the cells are low.\n",
}


def _write(root, files):
    os.makedirs(root, exist_ok=True)
    for name, text in files.items():
        with open(os.path.join(root, name), "w", encoding="utf-8") as fh:
            fh.write(text)


def _stats(res):
    return res.stats.first().asDict()


def _index_ids(spark, root):
    return {r.id for r in index_store.load_index(spark, root).select("id").collect()}


def _state_ids(spark, root):
    st = state_store.load_state(spark, root)
    return {c for r in st.select("chunk_ids").collect() for c in (r.chunk_ids or [])}


def test_first_run_then_idempotent(spark, scratch):
    src, idx, st = f"{scratch}/docs", f"{scratch}/index", f"{scratch}/state"
    _write(src, DOCS)
    res = ingest_run(corpus_from_files(spark, src, container="documents"), idx, st, as_of="2024-01-31 00:00:00")
    s1 = _stats(res)
    assert s1 == {"scanned": 3, "ingested": 3, "skipped": 0, "chunks": 3, "pruned_docs": 0}
    assert _index_ids(spark, idx) == _state_ids(spark, st)

    res2 = ingest_run(corpus_from_files(spark, src, container="documents"), idx, st)
    assert _stats(res2) == {"scanned": 3, "ingested": 0, "skipped": 3, "chunks": 0, "pruned_docs": 0}
    assert _index_ids(spark, idx) == _state_ids(spark, st)

    rows = index_store.load_index(spark, idx).orderBy("id").collect()
    titles = sorted(r.title for r in rows)
    assert titles == ["P7 Infusion Pump: Error E42", "P7 Infusion Pump: Filter care", "S3 Scale: Battery"]
    assert all(r.id.endswith("-0") and r.parent_id.startswith("blob:") for r in rows)
    assert {r.url for r in rows} == {f"documents/{n}" for n in DOCS}


@pytest.mark.parametrize("layout", ["versioned", "buckets"])
def test_edit_delete_and_stale(spark, scratch, layout):
    src, idx, st = f"{scratch}/docs", f"{scratch}/index", f"{scratch}/state"
    _write(src, DOCS)
    kw = {"index_layout": layout, "n_buckets": 4}
    ingest_run(corpus_from_files(spark, src), idx, st, **kw)
    # change one doc into two chunks' worth of text at a tiny limit, delete another
    long_text = "# P7 Infusion Pump: Filter care\n\n" + "\n".join(f"line {i} of the filter guide" for i in range(40))
    _write(src, {"pump-p7-filter.md": long_text})
    os.remove(os.path.join(src, "scale-s3-battery.md"))
    res = ingest_run(corpus_from_files(spark, src), idx, st, limit=64, **kw)
    s = _stats(res)
    assert s["scanned"] == 2 and s["ingested"] == 1 and s["pruned_docs"] == 1 and s["chunks"] > 1
    assert _index_ids(spark, idx) == _state_ids(spark, st)
    # shrink it again: stale chunk ids must disappear from the index
    _write(src, {"pump-p7-filter.md": "# P7 Infusion Pump: Filter care\n\nshort now\n"})
    ingest_run(corpus_from_files(spark, src), idx, st, limit=64, **kw)
    ids = _index_ids(spark, idx)
    assert ids == _state_ids(spark, st)
    assert len(ids) == 2


def test_golden_question_ranks_e42_first(spark, scratch):
    src, idx, st = f"{scratch}/docs", f"{scratch}/index", f"{scratch}/state"
    _write(src, DOCS)
    ingest_run(corpus_from_files(spark, src), idx, st)
    index = index_store.load_index(spark, idx)
    q = spark.createDataFrame([("q1", "How do I fix error E42?")], "question_id string, message string")
    qv = embed_questions(q)
    hits = hit_projection(vector_topk(index, qv, 3), index).orderBy("rank").collect()
    assert hits[0].title == "P7 Infusion Pump: Error E42"
    assert len(hits) == 3


def test_missing_index_gives_no_hits(spark, scratch):
    from docweave.operators.retrieve import empty_hits, hit_counts

    assert index_store.load_index(spark, f"{scratch}/nothing") is None
    q = spark.createDataFrame([("q1",), ("q2",)], "question_id string")
    counts = {r.question_id: r.n_hits for r in hit_counts(q, empty_hits(spark)).collect()}
    assert counts == {"q1": 0, "q2": 0}


def test_empty_document_policies(spark, scratch):
    src, idx, st = f"{scratch}/docs", f"{scratch}/index", f"{scratch}/state"
    _write(src, DOCS)
    ingest_run(corpus_from_files(spark, src), idx, st)
    _write(src, {"pump-p7-e42.md": "   \n\n  "})  # now yields no chunk
    res = ingest_run(corpus_from_files(spark, src), idx, st, empty_policy="keep")
    s = _stats(res)
    assert s["ingested"] == 0 and s["skipped"] == 3
    assert len(_index_ids(spark, idx)) == 3  # reference behaviour: old chunks kept
    res = ingest_run(corpus_from_files(spark, src), idx, st, empty_policy="clear")
    assert len(_index_ids(spark, idx)) == 2
    assert _index_ids(spark, idx) == _state_ids(spark, st)


def test_config_fingerprint_reingests(spark, scratch):
    src, idx, st = f"{scratch}/docs", f"{scratch}/index", f"{scratch}/state"
    _write(src, DOCS)
    ingest_run(corpus_from_files(spark, src), idx, st)
    same = _stats(ingest_run(corpus_from_files(spark, src), idx, st))
    assert same["ingested"] == 0
    changed = _stats(ingest_run(corpus_from_files(spark, src), idx, st, config_fingerprint="limit=512"))
    assert changed["ingested"] == 3 and _index_ids(spark, idx) == _state_ids(spark, st)


def test_bucket_layout_touches_only_changed_buckets(spark, scratch):
    from docweave.sources import bucketed

    src, idx, st = f"{scratch}/docs", f"{scratch}/index", f"{scratch}/state"
    _write(src, DOCS)
    ingest_run(corpus_from_files(spark, src), idx, st, index_layout="buckets", n_buckets=64)
    before = bucketed.manifest(spark, idx).buckets
    assert len(before) == 3 and len(bucketed.manifest(spark, st).buckets) == 3
    _write(src, {"scale-s3-battery.md": "# S3 Scale: Battery\n\nNow 300 hours.\n"})
    res = ingest_run(corpus_from_files(spark, src), idx, st)
    assert _stats(res)["ingested"] == 1
    after = bucketed.manifest(spark, idx).buckets
    assert before.keys() == after.keys() and sum(before[b] != after[b] for b in before) == 1
    assert _index_ids(spark, idx) == _state_ids(spark, st)
    os.remove(os.path.join(src, "scale-s3-battery.md"))
    ingest_run(corpus_from_files(spark, src), idx, st)
    assert len(bucketed.manifest(spark, idx).buckets) == 2  # the emptied bucket is gone
    assert bucketed.prune(spark, idx, keep=1) and bucketed.prune(spark, idx, keep=1) == []
    assert _index_ids(spark, idx) == _state_ids(spark, st)


@pytest.mark.parametrize("stop_at", ["index", "state"])
def test_a_stopped_commit_loses_nothing(spark, scratch, stop_at):
    from docweave.sources import bucketed

    src, idx, st = f"{scratch}/docs", f"{scratch}/index", f"{scratch}/state"
    many = {f"d{i}.md": f"# Doc {i}\n\nbody {i}\n" for i in range(12)}
    _write(src, many)
    ingest_run(corpus_from_files(spark, src), idx, st, n_buckets=2)
    before = sorted(map(tuple, index_store.load_index(spark, idx).select("id", "content").collect()))
    _write(src, {"d3.md": "# Doc 3\n\nnew body\n"})
    os.remove(os.path.join(src, "d4.md"))

    def stop(table):
        if table == stop_at:
            raise RuntimeError("stopped")

    with pytest.raises(RuntimeError, match="stopped"):
        ingest_run(corpus_from_files(spark, src), idx, st, before_commit=stop)
    now = sorted(map(tuple, index_store.load_index(spark, idx).select("id", "content").collect()))
    assert now == before if stop_at == "index" else len(now) == 11
    res = _stats(ingest_run(corpus_from_files(spark, src), idx, st))
    assert (res["ingested"], res["skipped"], res["pruned_docs"]) == (1, 10, 1)
    assert _index_ids(spark, idx) == _state_ids(spark, st) and len(_index_ids(spark, idx)) == 11
    assert _stats(ingest_run(corpus_from_files(spark, src), idx, st))["ingested"] == 0
    assert any("data/v=" in p for p in bucketed.prune(spark, idx, keep=1))


def test_another_bucket_count_is_refused(spark, scratch):
    src, idx, st = f"{scratch}/docs", f"{scratch}/index", f"{scratch}/state"
    _write(src, DOCS)
    ingest_run(corpus_from_files(spark, src), idx, st, n_buckets=16)
    _write(src, {"pump-p7-filter.md": "# P7\n\nother\n"})
    with pytest.raises(ValueError, match="16 buckets"):
        ingest_run(corpus_from_files(spark, src), idx, st, n_buckets=8)
    assert _stats(ingest_run(corpus_from_files(spark, src), idx, st))["ingested"] == 1
    assert _index_ids(spark, idx) == _state_ids(spark, st) and len(_index_ids(spark, idx)) == 3


def test_a_run_leaves_no_scratch_folder(spark, scratch):
    import glob

    from docweave.session import ensure_checkpoint_dir

    src, idx, st = f"{scratch}/docs", f"{scratch}/index", f"{scratch}/state"
    _write(src, DOCS)
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/ingest-*"))
    res = ingest_run(corpus_from_files(spark, src), idx, st)
    assert set(glob.glob(f"{folder}/ingest-*")) == before and _stats(res)["ingested"] == 3


def test_listing_prefilter_reads_only_changed_files(spark, scratch):
    from docweave.plans.ingest import ingest_files

    src, idx, st = f"{scratch}/docs", f"{scratch}/index", f"{scratch}/state"
    _write(src, DOCS)
    s1 = _stats(ingest_files(spark, src, idx, st))
    assert s1["ingested"] == 3
    # nothing changed: every file is trusted from the listing, nothing re-ingested
    assert _stats(ingest_files(spark, src, idx, st))["ingested"] == 0
    # touch one file without changing bytes, edit another
    p = os.path.join(src, "pump-p7-filter.md")
    os.utime(p, (os.path.getatime(p) + 100, os.path.getmtime(p) + 100))
    _write(src, {"scale-s3-battery.md": "# S3 Scale: Battery\n\nNow 300 hours.\n"})
    s3 = _stats(ingest_files(spark, src, idx, st))
    assert s3["ingested"] == 1 and s3["skipped"] == 2
    assert _index_ids(spark, idx) == _state_ids(spark, st)
    st_rows = {r.doc_id: r for r in state_store.load_state(spark, st).collect()}
    assert st_rows["blob:pump-p7-filter.md"].modified is not None
    # the touched file is trusted again on the next run
    assert _stats(ingest_files(spark, src, idx, st))["ingested"] == 0
    os.remove(os.path.join(src, "pump-p7-e42.md"))
    assert _stats(ingest_files(spark, src, idx, st))["pruned_docs"] == 1
    assert _index_ids(spark, idx) == _state_ids(spark, st)


def test_chat_turns_end_to_end(spark, scratch):
    from docweave.plans.chat_turn import answer_questions

    src, idx, st = f"{scratch}/docs", f"{scratch}/index", f"{scratch}/state"
    _write(src, DOCS)
    ingest_run(corpus_from_files(spark, src), idx, st)
    msgs = spark.createDataFrame(
        [("m1", "s1", "user", "hello", "t0", "2024-01-01 00:00:00"),
         ("m2", "s1", "assistant", "hi", "t0", "2024-01-01 00:00:01")],
        "id string, session_id string, role string, content string, trace_id string, created_at string") \
        .withColumn("created_at", F.col("created_at").cast("timestamp"))
    qs = spark.createDataFrame([("q1", "s1", "How do I fix error E42?", "model-x"),
                                ("q2", "", "battery life of the scale", None)],
                               "question_id string, session_id string, message string, model string")
    res = answer_questions(spark, qs, idx, msgs, "model-a, model-b")
    a = {r.question_id: r for r in res.answers.collect()}
    assert a["q1"].answer == "See P7 Infusion Pump: Error E42." and a["q1"].model == "model-a"
    assert a["q1"].sources[0] == "P7 Infusion Pump: Error E42" and len(a["q1"].sources) == 3
    assert a["q2"].session_id and a["q2"].session_id != ""
    rows = res.history_rows.orderBy("session_id", "order_in_turn").collect()
    assert [r.role for r in rows if r.session_id == "s1"] == ["user", "assistant"]
    assert len(rows) == 4
    # no index yet: every question is still answered, without sources
    none = answer_questions(spark, qs, f"{scratch}/no-index", msgs, "model-a").answers.collect()
    assert {r.sources_text for r in none} == {"none"} and len(none) == 2


def test_models_are_called_once_per_question(spark, scratch):
    """Both results of a batch of turns derive from one embedding and one chat call per question."""
    from docweave.plans.chat_turn import answer_questions

    src, idx, st = f"{scratch}/docs", f"{scratch}/index", f"{scratch}/state"
    _write(src, DOCS)
    ingest_run(corpus_from_files(spark, src), idx, st)
    log = f"{scratch}/calls.txt"

    def embed(texts):
        with open(log, "a") as fh:
            fh.writelines("embed\n" for _ in texts)
        return [[1.0] + [0.0] * 255 for _ in texts]

    def chat(prompts, models):
        import uuid

        with open(log, "a") as fh:
            fh.writelines("chat\n" for _ in prompts)
        return [(f"answer {uuid.uuid4()}", 1, 1) for _ in prompts]

    messages = spark.createDataFrame([("m1", "s1", "user", "hello", 1), ("m2", "s2", "user", "other", 2)],
                                     "id string, session_id string, role string, content string, created_at long")
    questions = spark.createDataFrame([(f"q{i}", "s1", f"question {i}", None) for i in range(5)],
                                      "question_id string, session_id string, message string, model string")
    res = answer_questions(spark, questions, idx, messages, "model-a", embed, chat)
    answers = {r.answer for r in res.answers.collect()}
    assert {r.content for r in res.history_rows.collect() if r.role == "assistant"} == answers and len(answers) == 5
    with open(log) as fh:
        calls = fh.read().split()
    assert calls.count("embed") == 5 and calls.count("chat") == 5


EDIT = st_.lists(st_.tuples(st_.sampled_from(["add", "edit", "delete"]), st_.integers(0, 5),
                            st_.integers(1, 60)), min_size=1, max_size=3)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(script=EDIT)
def test_random_edit_scripts_keep_index_and_state_in_step(spark, script):
    import tempfile

    base = tempfile.mkdtemp(prefix="docweave-edit-", dir="/tmp")
    src, idx, st = f"{base}/docs", f"{base}/index", f"{base}/state"
    _write(src, DOCS)
    ingest_run(corpus_from_files(spark, src), idx, st, limit=32)
    for op, n, lines in script:
        name = f"doc{n}.md"
        if op == "delete":
            if os.path.exists(os.path.join(src, name)):
                os.remove(os.path.join(src, name))
        else:
            _write(src, {name: f"# Doc {n}\n\n" + "\n".join(f"{op} line {i} of doc {n}" for i in range(lines))})
        res = ingest_run(corpus_from_files(spark, src), idx, st, limit=32)
        assert _index_ids(spark, idx) == _state_ids(spark, st)
        assert _stats(res)["scanned"] == len(os.listdir(src))
    again = _stats(ingest_run(corpus_from_files(spark, src), idx, st, limit=32))
    assert again["ingested"] == 0


def test_versioned_to_bucketed_migration(spark, scratch):
    src, idx, st = f"{scratch}/docs", f"{scratch}/index", f"{scratch}/state"
    _write(src, DOCS)
    ingest_run(corpus_from_files(spark, src), idx, st, index_layout="versioned")
    before = _index_ids(spark, idx)
    res = ingest_run(corpus_from_files(spark, src), idx, st, index_layout="buckets", n_buckets=8)
    assert _stats(res)["ingested"] == 0
    assert _index_ids(spark, idx) == before == _state_ids(spark, st)


def test_duplicate_ids_are_refused(spark, scratch):
    from docweave.sources.corpus import corpus_from_table

    t = spark.createDataFrame([(1, "a"), (1, "b")], "k long, text string")
    with pytest.raises(ValueError, match="not unique"):
        ingest_run(corpus_from_table(t, "k", "text", source="tbl"), f"{scratch}/i", f"{scratch}/s", fmt="text")
