"""Sources and stores: files, connectors, content type, versioned tables, batches."""

import os

from pyspark.sql import functions as F

from docweave.functions.text import content_type, derive_title, distinct_options, source_of
from docweave.sources import versioned
from docweave.sources.corpus import corpus_from_files, corpus_from_source, with_fingerprint
from docweave.sources.index_store import batch_plan


def test_corpus_from_files_and_fingerprint(spark, scratch):
    os.makedirs(f"{scratch}/docs/sub")
    with open(f"{scratch}/docs/a_b-c.md", "w") as fh:
        fh.write("hello")
    with open(f"{scratch}/docs/sub/x.pdf", "wb") as fh:
        fh.write(b"%PDF")
    df = with_fingerprint(corpus_from_files(spark, f"{scratch}/docs", container="documents"))
    rows = {r.id: r for r in df.collect()}
    assert set(rows) == {"blob:a_b-c.md", "blob:sub/x.pdf"}
    a = rows["blob:a_b-c.md"]
    assert a.uri == "documents/a_b-c.md" and a.content_type == "text/markdown" and a.source == "blob"
    assert a.content_hash == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    assert rows["blob:sub/x.pdf"].content_type == "application/pdf"


def test_python_data_source_connector(spark):
    class ListSource:  # defined here so it is shipped to the workers by value
        name = "kb"

        def shards(self):
            return ["s0", "s1"]

        def list(self, shard):
            return [(f"{shard}/doc{i}", f"mem://{shard}/doc{i}") for i in range(3)]

        def fetch(self, uri):
            return uri.encode()

    df = corpus_from_source(spark, ListSource())
    rows = df.collect()
    assert len(rows) == 6 and {r.source for r in rows} == {"kb"}
    assert rows[0].id.startswith("kb:s") and bytes(rows[0].content).startswith(b"mem://")


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("blob:a/b-c_d.tar.gz", "docs/b-c_d.tar.gz", " m1, m2 ,m1,, ")], "id string, uri string, csv string")
    r = df.select(source_of("id").alias("s"), derive_title("uri").alias("t"), content_type("uri").alias("ct"),
                  distinct_options("csv").alias("o")).first()
    assert (r.s, r.t, r.ct, r.o) == ("blob", "b c d.tar", "application/octet-stream", ["m1", "m2"])


def test_versioned_tables(spark, scratch):
    root = f"{scratch}/tbl"
    assert versioned.read_latest(spark, root) is None
    versioned.write_next(spark.range(3), root)
    versioned.write_next(spark.range(5), root)
    os.makedirs(f"{root}/v=7")  # an incomplete version is never read
    assert versioned.read_latest(spark, root).count() == 5
    assert versioned.versions(spark, root) == [0, 1]
    versioned.prune_versions(spark, root, keep=1)
    assert versioned.versions(spark, root) == [1]


def test_batch_plan_bounded(spark):
    actions = spark.range(2345).repartition(3)
    sizes = [r["count"] for r in batch_plan(actions, 500).groupBy("batch").count().collect()]
    assert sum(sizes) == 2345 and max(sizes) <= 500


def test_keyed_batch_plan_is_deterministic_and_bounded(spark):
    from docweave.sources.index_store import batch_plan_keyed

    a = spark.range(5000).select(F.col("id").cast("string").alias("id"))
    one = {r.id: r.batch for r in batch_plan_keyed(a, "id", 300, digits=1).collect()}
    two = {r.id: r.batch for r in batch_plan_keyed(a.repartition(7), "id", 300, digits=1).collect()}
    assert one == two
    sizes = {}
    for b in one.values():
        sizes[b] = sizes.get(b, 0) + 1
    assert max(sizes.values()) <= 300 and sum(sizes.values()) == 5000
    # a row's group never depends on the number of rows
    few = {r.id: r.batch for r in batch_plan_keyed(a.limit(40), "id", 300).collect()}
    many = {r.id: r.batch for r in batch_plan_keyed(a, "id", 300).collect()}
    assert all(many[k].split("-")[0] == b.split("-")[0] and len(b.split("-")[0]) == 3 for k, b in few.items())


def test_null_and_misfit_vectors_are_reported(spark):
    from docweave.sources.index_store import index_ensure

    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None), ("c", [1.0])], "id string, vector array<float>")
    assert {r.id: r.width for r in index_ensure(df, 2).collect()} == {"b": None, "c": 1}


def test_batched_sink_posts_bounded_batches(spark, scratch):
    from docweave.sources.index_store import batched_sink

    log = f"{scratch}/posted.txt"

    def send(rows):
        with open(log, "a") as fh:
            fh.write(f"{len(rows)} {sum(r['id'] for r in rows)}\n")

    batched_sink(spark.range(1234).repartition(3), send, 100)
    with open(log) as fh:
        posted = [tuple(map(int, line.split())) for line in fh]
    assert max(n for n, _ in posted) <= 100 and sum(n for n, _ in posted) == 1234
    assert sum(total for _, total in posted) == sum(range(1234))


def test_pages_connector_over_a_table_of_several_files(spark, scratch, monkeypatch):
    from docweave.plans import stand_ins
    from docweave.plans.catalog import QUERIES

    monkeypatch.setattr(stand_ins, "PART_ROWS", 7)
    rows = [(i, f"https://a.example/{i}.html", None if i % 11 == 0 else f"<p>page {i}</p>") for i in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartitionByRange(5, "page_id").write.parquet(f"{scratch}/pages.parquet")
    source = stand_ins.PagesSource.over(spark.read.parquet(f"{scratch}/pages.parquet"), arrivals=3)
    assert source.n == 60 and len(source.parts) > 5 and len(source.shards()) == len(source.parts)
    for start, end in ((0, 60), (0, 1), (5, 23), (59, 60), (60, 60)):
        assert list(source.changes(start, end)) == [(i, str(i), url, (html or "").encode()) for i, url, html in rows[start:end]]
    assert [source.last() for _ in range(4)] == [20, 40, 60, 60]
    spark.createDataFrame([(1, "a text", "src")], "doc_id long, text string, source string").write.parquet(f"{scratch}/documents.parquet")
    got = QUERIES["corpus_sources"](spark, f"file://{scratch}").groupBy("source").count().collect()
    assert {r.source: r["count"] for r in got} == {"src": 1, "web": 60, "made": 60}
