"""Redaction (E8, X1-X5): fail closed, never leak, pass unmarked content through."""

import json

from pyspark.sql import functions as F

from docweave.operators import redact as X

EMAIL = "jane.doe@mail.example.com"


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_key long, span_id string, name string, ts timestamp, attributes map<string,string>")


def test_deidentify_counts(spark):
    df = spark.createDataFrame([(1, f"mail {EMAIL} or call +1 (555) 123-4567 from 10.0.0.1, token = \"abc123\"")],
                               "doc_id long, text string")
    r = X.deidentify_corpus(df).first()
    assert EMAIL not in r.text and "10.0.0.1" not in r.text and "abc123" not in r.text
    assert (r.n_email, r.n_phone, r.n_ip, r.n_secret) == (1, 1, 1, 1)


def test_pieces_sizes_and_join(spark):
    unit = "x" * 4968 + f" {EMAIL} " + "y" * 5  # exactly one 5,000-char piece
    texts = [(0, ""), (1, "a" * 5000), (2, "b" * 5001), (3, unit * 6 + "z"), (4, "x" * 4990 + EMAIL)]
    df = spark.createDataFrame(texts, "k long, t string")
    pieces = X.text_pieces(df, "k", "t").groupBy("k").count().orderBy("k").collect()
    assert [r["count"] for r in pieces] == [1, 1, 2, 7, 2]
    out = {r.k: r.redacted for r in X.redact_text(df, "k", "t").collect()}
    assert out[0] == "" and out[1] == "a" * 5000 and out[2] == "b" * 5001
    assert EMAIL not in out[3] and out[3].count("[EMAIL]") == 6
    assert out[4] == "x" * 4990 + "[EMAIL]" or EMAIL not in out[4]  # the chain sees the whole text, so no cut hides an entity
    # a service gets pieces: an entity cut by a boundary reaches it in two halves (trap T7)
    halves = {r.k: r.redacted for r in X.redact_text(df, "k", "t", X.regex_scrubber).collect()}
    assert EMAIL in halves[4] and halves[3].count("[EMAIL]") == 6


def test_fail_closed_when_scrubber_raises(spark):
    calls = {"n": 0}

    def flaky(texts):
        calls["n"] += 1
        if any(t.startswith("c") for t in texts):
            raise RuntimeError("service down")
        return [t.upper() for t in texts]

    # 30,000 chars = 6 pieces = 2 calls; the second call raises
    text = "a" * 25000 + "c" * 5000
    df = spark.createDataFrame([(1, text), (2, "fine")], "k long, t string")
    out = {r.k: r.redacted for r in X.redact_text(df, "k", "t", flaky).collect()}
    assert out[1] == X.WITHHELD
    assert out[2] == "FINE"


def test_scrub_events_cases(spark):
    ok = json.dumps({"query": f"write to {EMAIL}", "n": 3, "nested": {"q": EMAIL}})
    rows = [
        (1, "s1", "gen_ai.content.retrieval", None, {"content": ok, "scrub_keys": '["query", "n", "nested", "missing"]'}),
        (2, "s2", "other.event", None, {"content": ok, "scrub_keys": '["query"]'}),
        (3, "s3", "gen_ai.content.x", None, {"content": "not json", "scrub_keys": '["query"]'}),
        (4, "s4", "gen_ai.content.x", None, {"content": json.dumps(["a", EMAIL]), "scrub_keys": '["query"]'}),
        (5, "s5", "gen_ai.content.x", None, {"content": ok, "scrub_keys": "not json"}),
        (6, "s6", "gen_ai.content.x", None, {"content": ok}),
        (7, "s7", None, None, {"content": ok, "scrub_keys": '["query"]'}),
    ]
    out = {r.event_key: r.attributes for r in X.scrub_events(_events(spark, rows)).collect()}
    c1 = json.loads(out[1]["content"])
    assert EMAIL not in c1["query"] and c1["n"] == 3 and c1["nested"] == {"q": EMAIL}
    assert "scrub_keys" not in out[1]
    assert out[2] == rows[1][4]  # other prefix: unchanged, marker kept
    assert out[3]["content"] == X.WITHHELD and out[4]["content"] == X.WITHHELD  # strict default
    assert out[5] == {"content": X.WITHHELD}  # a marker that can't be read withholds
    assert out[6] == rows[5][4]  # no marker: unchanged
    assert len(out) == 7 and out[7] == rows[6][4]  # no name: kept, unchanged
    lax = {r.event_key: r.attributes for r in X.scrub_events(_events(spark, rows), strict=False).collect()}
    assert lax[3]["content"] == "not json" and lax[5]["content"] == ok


def test_scrubber_sees_each_text_in_its_own_calls(spark):
    """Six pieces of one text make two calls; a short text and a null beside it are no part of them."""
    def tagged(texts):
        return [f"<{len(texts)}:{len(t)}>" for t in texts]

    df = spark.createDataFrame([(1, ["a" * 25_001, None, "", "é" * 5_000]), (2, []), (3, None)], "k long, t array<string>").coalesce(1)
    out = {r.k: r.t for r in X.scrub_lists(df, "t", tagged).collect()}
    assert out[1] == ["<5:5000>" * 5 + "<1:1>", None, "<1:0>", "<1:5000>"]
    assert out[2] == [] and not out[3]


def test_payload_with_a_key_twice_is_withheld(spark):
    rows = [(1, "s", "gen_ai.content.x", None, {"content": '{"q": "%s", "q": "%s"}' % (EMAIL, EMAIL), "scrub_keys": '["q"]'})]
    for scrubber in (None, X.regex_scrubber):
        assert X.scrub_events(_events(spark, rows), scrubber).first().attributes == {"content": X.WITHHELD}


def test_long_runs_of_letters_take_linear_time(spark):
    """A blob without an address, an address after a long run, and a domain of many labels."""
    import time

    blob = "A" * 1_000_000
    df = spark.createDataFrame([(1, blob), (2, blob + "@mail.example.com"), (3, "x@" + "a." * 50_000), (4, "a@" * 200_000)], "doc_id long, text string")
    began = time.time()
    out = {r.doc_id: r.text for r in X.deidentify_corpus(df).collect()}
    assert time.time() - began < 30
    assert out[1] == blob and out[2] == "A" * (1_000_000 - 64) + "[EMAIL]" and out[3].startswith("[EMAIL]") and out[4] == "a@" * 200_000


def test_scrub_events_fail_closed(spark):
    def broken(texts):
        raise RuntimeError("no endpoint")

    rows = [(1, "s1", "gen_ai.content.retrieval", None,
             {"content": json.dumps({"query": EMAIL, "keep": "x"}), "scrub_keys": '["query"]'})]
    a = X.scrub_events(_events(spark, rows), broken).first().attributes
    c = json.loads(a["content"])
    assert c == {"query": X.WITHHELD, "keep": "x"}


def test_erase_subjects(spark):
    m = spark.createDataFrame([("1", "a"), ("2", "b"), ("1", "c")], "session_id string, content string")
    who = spark.createDataFrame([("1",), ("9",)], "session_id string")
    assert [r.content for r in X.erase_subjects(m, who).collect()] == ["b"]


def test_erase_traces_of_subjects_only(spark):
    m = spark.createDataFrame([("1", "t1"), ("1", None), ("2", "t2"), ("3", "t3")], "session_id string, trace_id string")
    t = spark.createDataFrame([("t1", "a"), ("t1", "b"), ("t2", "c"), (None, "d"), ("t9", "e")], "OperationId string, Id string")
    who = spark.createDataFrame([("1",), ("1",), (None,), ("8",)], "session_id string")
    assert sorted(r.Id for r in X.erase_traces(t, m, who).collect()) == ["c", "d", "e"]
