"""Streaming: file arrivals, coalesced ingest per micro-batch, stream = batch panels."""

import os

from pyspark.sql import functions as F

from docweave.operators import telemetry as T
from docweave.sources.testdata import TestData, spans_from
from docweave.streaming import arrivals as A
from docweave.streaming import panels as P
from docweave.streaming.runner import file_stream, run_available_now

SF = "/root/testdata/sf0.01"


def test_arrival_stream_once(spark, scratch):
    src = f"{scratch}/drop"
    os.makedirs(src)
    for i in range(3):
        with open(f"{src}/doc{i}.md", "w") as fh:
            fh.write(f"# Doc {i}\n\nbody {i}\n")
    s = A.arrival_stream(spark, src).select("id", "uri", "source", F.length("content").alias("n"))
    run_available_now(s, f"{scratch}/out", f"{scratch}/ck")
    assert spark.read.parquet(f"{scratch}/out").count() == 3
    # a second run over the same folder adds nothing (checkpointed file log)
    run_available_now(s, f"{scratch}/out", f"{scratch}/ck")
    assert spark.read.parquet(f"{scratch}/out").count() == 3
    with open(f"{src}/doc9.md", "w") as fh:
        fh.write("# Doc 9\n")
    run_available_now(s, f"{scratch}/out", f"{scratch}/ck")
    ids = sorted(r.id for r in spark.read.parquet(f"{scratch}/out").collect())
    assert ids == ["blob:doc0.md", "blob:doc1.md", "blob:doc2.md", "blob:doc9.md"]


def test_coalesce_events_one_pass_per_batch(spark, scratch):
    td = TestData(spark, SF)
    ev = A.event_filter(td["blob_events"])
    ev.write.parquet(f"{scratch}/events")
    stream = spark.readStream.schema(ev.schema).parquet(f"{scratch}/events")
    passes = []

    def run(subjects, batch_id):
        passes.append((batch_id, subjects.count()))

    q = A.coalesce_events(stream, run, f"{scratch}/ck", counts_path=f"{scratch}/counts")
    q.awaitTermination()
    assert len(passes) == 1
    assert passes[0][1] == ev.select("subject").distinct().count()
    assert spark.read.parquet(f"{scratch}/counts").first().drained == ev.count()


def test_event_expiry_stream_dedup(spark, scratch):
    td = TestData(spark, SF)
    ev = td["blob_events"].withColumn("event_time", F.col("event_time").cast("timestamp"))
    ev.unionByName(ev.limit(50)).write.parquet(f"{scratch}/ev")  # duplicate deliveries
    s = A.event_expiry(spark.readStream.schema(ev.schema).parquet(f"{scratch}/ev"))
    run_available_now(s, f"{scratch}/out", f"{scratch}/ck")
    assert spark.read.parquet(f"{scratch}/out").count() == ev.count()


def test_stream_equals_batch_on_closed_windows(spark, scratch):
    td = TestData(spark, SF)
    ev = file_stream(spark, SF, "events", max_files=1)
    deps = spans_from(ev).filter(F.col("Type") == "AppDependencies")
    run_available_now(P.stream_ingest_throughput(deps), f"{scratch}/out", f"{scratch}/ck")
    streamed = {r.TimeGenerated: (r.Ingested, r.Failed) for r in spark.read.parquet(f"{scratch}/out").collect()}
    batch = {r.TimeGenerated: (r.Ingested, r.Failed) for r in T.ingest_throughput(td["app_dependencies"]).collect()}
    assert streamed and all(batch[k] == v for k, v in streamed.items())
    # only windows the watermark has not closed are missing
    import datetime as dt

    last = td["app_dependencies"].filter("Name = 'ingest-doc'").agg(F.max("TimeGenerated")).first()[0]
    wm = last - dt.timedelta(minutes=10)
    assert all(k + dt.timedelta(hours=1) > wm for k in set(batch) - set(streamed))


def test_deltas_over_many_micro_batches_equal_batch(spark, scratch):
    """Events split into time-ordered files, one file per micro-batch."""
    from docweave.operators.chat import assemble_deltas
    from docweave.sources.testdata import token_deltas_sql
    from docweave.streaming.deltas import stream_deltas

    ev = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(4):
        ev.filter((F.col("event_id") % 10000 >= i * 2500) & (F.col("event_id") % 10000 < (i + 1) * 2500)) \
            .coalesce(1).write.parquet(f"{scratch}/events/part{i}")
    src = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(f"{scratch}/events")
    sql = token_deltas_sql("spark").replace("as completion_tokens\nfrom", "as completion_tokens, ts\nfrom")
    q = run_available_now(stream_deltas(spark.sql(sql, events=src)), f"{scratch}/out", f"{scratch}/ck")
    assert len(q.recentProgress) >= 4
    streamed = {r.turn_id: (r.answer, r.input_tokens, r.output_tokens) for r in spark.read.parquet(f"{scratch}/out").collect()}
    batch = {r.turn_id: (r.answer, r.input_tokens, r.output_tokens)
             for r in assemble_deltas(spark.sql(token_deltas_sql("spark"), events=ev)).collect()}
    assert streamed and all(batch[t] == v for t, v in streamed.items())
    assert len(batch) - len(streamed) <= 5  # turns that the watermark has not passed yet


def test_a_late_delta_joins_its_turn(spark, scratch):
    """The usage chunk comes in an earlier micro-batch than a part of the answer."""
    from docweave.streaming.deltas import stream_deltas

    schema = "turn_id long, seq long, delta string, prompt_tokens int, completion_tokens int, ts string"
    parts = [[(1, 0, "a", None, None, "2024-01-01 00:00:00"), (1, 2, "c", 7, 3, "2024-01-01 00:00:02")],
             [(1, 1, "b", None, None, "2024-01-01 00:00:01")],
             [(2, 0, "x", None, None, "2024-01-01 03:00:00")], [(3, 0, "y", 1, 1, "2024-01-01 06:00:00")]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1) \
            .write.parquet(f"{scratch}/in/part{i}")
    src = spark.readStream.schema(spark.read.parquet(f"{scratch}/in/part0").schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(f"{scratch}/in")
    run_available_now(stream_deltas(src), f"{scratch}/out", f"{scratch}/ck")
    got = {r.turn_id: (r.answer, r.input_tokens, r.output_tokens, r.timed_out) for r in spark.read.parquet(f"{scratch}/out").collect()}
    assert got == {1: ("abc", 7, 3, False), 2: ("x", 0, 0, True)}


def test_a_replayed_batch_counts_once(spark, scratch):
    import pytest

    ev = spark.createDataFrame([(i, f"s{i % 2}") for i in range(9)], "event_id long, subject string")
    ev.write.parquet(f"{scratch}/ev")
    seen = []

    def run(subjects, batch_id):
        seen.append(subjects.count())
        if len(seen) == 1:
            raise RuntimeError("crash in the pass")

    for attempt in range(2):
        q = A.coalesce_events(spark.readStream.schema(ev.schema).parquet(f"{scratch}/ev"), run, f"{scratch}/ck", f"{scratch}/counts")
        if attempt == 0:
            with pytest.raises(Exception, match="crash in the pass"):
                q.awaitTermination()
        else:
            q.awaitTermination()
    assert seen == [2, 2]
    assert [r.drained for r in spark.read.parquet(f"{scratch}/counts").collect()] == [9]


def test_events_trigger_one_ingest_pass(spark, scratch):
    from docweave.plans.ingest import ingest_on_events
    from docweave.sources import index_store
    from docweave.sources.corpus import corpus_from_files

    src = f"{scratch}/docs"
    os.makedirs(src)
    for i in range(3):
        with open(f"{src}/m{i}.md", "w") as fh:
            fh.write(f"# Manual {i}\n\nstep {i}\n")
    rows = [(i, "Microsoft.Storage.BlobCreated", f"/blobServices/default/containers/documents/blobs/m{i % 3}.md")
            for i in range(9)]
    ev = spark.createDataFrame(rows, "event_id long, event_type string, subject string") \
        .withColumn("event_time", F.current_timestamp())
    ev.write.parquet(f"{scratch}/ev")
    stream = spark.readStream.schema(ev.schema).parquet(f"{scratch}/ev")
    q, results = ingest_on_events(stream, lambda: corpus_from_files(spark, src), f"{scratch}/index",
                                  f"{scratch}/state", f"{scratch}/ck", counts_path=f"{scratch}/counts")
    assert len(results) == 1 and results[0][1].ingested == 3  # nine events, one pass
    assert index_store.load_index(spark, f"{scratch}/index").count() == 3
    assert spark.read.parquet(f"{scratch}/counts").first().drained == 9


def test_row_operators_on_streams(spark, scratch):
    """Row-local operators (de-identification, embedding) apply to streaming frames unchanged."""
    from docweave.operators.embed import embed_chunks
    from docweave.operators.redact import deidentify_corpus

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(50)
    docs.write.parquet(f"{scratch}/d")
    s = spark.readStream.schema(docs.schema).parquet(f"{scratch}/d")
    out = embed_chunks(deidentify_corpus(s), "text", "vector").select("doc_id", "n_email", F.size("vector").alias("w"))
    run_available_now(out, f"{scratch}/out", f"{scratch}/ck")
    got = spark.read.parquet(f"{scratch}/out")
    assert got.count() == 50 and {r.w for r in got.collect()} == {256}


def _notes(log, seen):
    """A connector whose change listing grows: edits take the next number (a local class: workers can't import tests)."""
    class Notes:
        name = "note"

        def _lines(self):
            with open(log) as fh:
                return [line.rstrip("\n").split("\t") for line in fh]

        def last(self):
            return len(self._lines())

        def changes(self, start, end):
            for i, (key, body) in enumerate(self._lines()[start:end], start):
                with open(seen, "a") as fh:
                    fh.write(f"{i}\n")
                yield i, key, f"notes/{key}.txt", body.encode()

    return Notes()


def test_connector_changes_stream_into_the_index(spark, scratch):
    """Triggers over a growing listing, edits in one trigger, a restart, and a replayed trigger equal one batch run."""
    from docweave.plans.ingest import ingest_arrivals, ingest_run
    from docweave.sources import index_store
    from docweave.sources import state as S
    from docweave.sources.connector_stream import connector_stream

    log, seen = f"{scratch}/log.txt", f"{scratch}/seen.txt"
    batches = [[("a", "first a"), ("b", "first b"), ("a", "second a")], [("c", "first c"), ("b", "second b")], [("d", "   ")]]
    where = (f"{scratch}/index", f"{scratch}/state", f"{scratch}/ck")
    for lines in batches:
        with open(log, "a") as fh:
            fh.writelines(f"{k}\t{v}\n" for k, v in lines)
        ran = ingest_arrivals(connector_stream(spark, _notes(log, seen), changes_per_task=2), *where, counts_path=f"{scratch}/counts", as_of="2024-01-31 00:00:00")
        assert len(ran) == 1
    assert ingest_arrivals(connector_stream(spark, _notes(log, seen)), *where, as_of="2024-01-31 00:00:00") == []  # nothing new
    assert sorted(r.drained for r in spark.read.parquet(f"{scratch}/counts").collect()) == [1, 2, 3]
    with open(seen) as fh:
        assert sorted(map(int, fh)) == list(range(6))  # every change was fetched once
    final = [("note:a", "second a"), ("note:b", "second b"), ("note:c", "first c"), ("note:d", "   ")]
    corpus = spark.createDataFrame([(i, f"notes/{i[5:]}.txt", "note", bytearray(t.encode())) for i, t in final], "id string, uri string, source string, content binary")
    ingest_run(corpus, f"{scratch}/index2", f"{scratch}/state2", as_of="2024-01-31 00:00:00")
    for load, one, two, key in ((index_store.load_index, "index", "index2", "id"), (S.load_state, "state", "state2", "doc_id")):
        got, want = ({r[key]: r for r in load(spark, f"{scratch}/{x}").collect()} for x in (one, two))
        assert got == want and len(want) >= 3


def test_a_failed_trigger_is_replayed(spark, scratch, monkeypatch):
    import pytest

    from docweave.plans import ingest
    from docweave.sources import state as S
    from docweave.sources.connector_stream import connector_stream

    log, where = f"{scratch}/log.txt", (f"{scratch}/index", f"{scratch}/state", f"{scratch}/ck")
    with open(log, "w") as fh:
        fh.write("a\tone\nb\ttwo\n")

    def crash(table):
        if table == "state":
            raise RuntimeError("stopped between index and state")

    with pytest.raises(Exception, match="stopped between"):
        ingest.ingest_arrivals(connector_stream(spark, _notes(log, f"{scratch}/seen")), *where, before_commit=crash)
    assert len(ingest.ingest_arrivals(connector_stream(spark, _notes(log, f"{scratch}/seen")), *where)) == 1
    assert sorted(r.doc_id for r in S.load_state(spark, where[1]).collect()) == ["note:a", "note:b"]


def test_a_growing_listing_takes_several_triggers(spark, scratch):
    from docweave.plans.ingest import ingest_arrivals
    from docweave.plans.stand_ins import PagesSource
    from docweave.sources import state as S
    from docweave.sources.connector_stream import connector_stream

    source = PagesSource(f"{SF}/pages.parquet", arrivals=3)
    ran = ingest_arrivals(connector_stream(spark, source), f"{scratch}/index", f"{scratch}/state", f"{scratch}/ck")
    assert len(ran) >= 2 and sum(r.scanned for _, r in ran) == source.n == S.load_state(spark, f"{scratch}/state").count()


def test_change_listing_over_a_table_of_several_files(spark, scratch):
    from docweave.plans.stand_ins import PagesSource
    from docweave.sources.connector_stream import connector_stream

    rows = [(i, f"https://a.example/{i}", f"<p>{i}</p>") for i in range(40)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartitionByRange(4, "page_id").write.parquet(f"{scratch}/pages.parquet")
    source = PagesSource.over(spark.read.parquet(f"file://{scratch}/pages.parquet"))
    changes = connector_stream(spark, PagesSource(source.path), changes_per_task=7)
    q = changes.writeStream.format("parquet").option("path", f"{scratch}/out").option("checkpointLocation", f"{scratch}/ck").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.seq, r.id, r.uri, bytes(r.content).decode()) for r in spark.read.parquet(f"{scratch}/out").collect()}
    assert got == {(i, f"made:{i}", url, html) for i, url, html in rows}


def test_files_of_a_table_are_streamed_in_order_of_a_number(spark, scratch):
    """Written by one job in no order, taken two files a trigger: no row comes before one of an earlier file."""
    from docweave.streaming.runner import in_order

    spark.range(80).select("id", (F.col("id") / 10).cast("int").alias("part")).repartition(8, "part").write.partitionBy("part").parquet(f"{scratch}/t")
    in_order(spark, f"{scratch}/t", "part")
    seen = []
    s = spark.readStream.schema("id long").option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(f"{scratch}/t")
    q = s.writeStream.foreachBatch(lambda batch, _: seen.append(sorted(r.id for r in batch.collect()))).option("checkpointLocation", f"{scratch}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == [list(range(i, i + 20)) for i in range(0, 80, 20)]


def test_the_number_of_triggers_does_not_grow_with_the_events(spark, scratch, monkeypatch):
    from docweave.plans import q_stream

    n = 6000
    spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts")).repartition(3).write.parquet(f"{scratch}/events.parquet")
    monkeypatch.setattr(q_stream, "PART_ROWS", 250)
    seen = []
    s = q_stream._event_stream(TestData(spark, f"file://{scratch}"))
    q = s.writeStream.foreachBatch(lambda batch, _: seen.append([r.event_id for r in batch.collect()])).option("checkpointLocation", f"{scratch}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) == 4 and sorted(x for b in seen for x in b) == list(range(n))
    assert all(max(a) < min(b) and not min(b) % 10 for a, b in zip(seen, seen[1:]))
