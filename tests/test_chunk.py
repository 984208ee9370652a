"""Chunking properties (E3-E5, P2): token conservation, limit, order, windows."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.operators.chunk import chunk_blocks, token_count
from docweave.operators.parse import parse_documents

WORD = st.text(alphabet="abcdefghij", min_size=1, max_size=6)
LINE = st.lists(WORD, min_size=0, max_size=30).map(" ".join)
DOC = st.lists(LINE, min_size=1, max_size=25).map("\n".join)


def _chunks(spark, docs, limit, fmt="text"):
    df = spark.createDataFrame([(f"d{i}", f"src/d{i}.txt", t) for i, t in enumerate(docs)], "id string, uri string, text string")
    return chunk_blocks(parse_documents(df, "text", fmt).select("id", "uri", "blocks"), limit=limit)


@settings(max_examples=15, deadline=None)
@given(docs=st.lists(DOC, min_size=1, max_size=4), limit=st.integers(min_value=3, max_value=40))
def test_token_sum_and_limit(spark, docs, limit):
    rows = _chunks(spark, docs, limit).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.id, []).append(r)
        assert r.n_tokens <= limit
        assert r.n_tokens == len(r.text.split())
    for i, t in enumerate(docs):
        got = sorted(by_doc.get(f"d{i}", []), key=lambda r: r.chunk_index)
        assert [r.chunk_index for r in got] == list(range(len(got)))
        assert sum(r.n_tokens for r in got) == len(t.split())
        # text order is preserved
        assert " ".join(" ".join(r.text.split()) for r in got) == " ".join(t.split())


def test_long_block_is_windowed(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = _chunks(spark, [text], 10).orderBy("chunk_index").collect()
    assert [r.n_tokens for r in rows] == [10, 10, 5]
    assert rows[0].text == " ".join(f"w{i}" for i in range(10))


def test_blank_lines_make_no_chunk(spark):
    rows = _chunks(spark, ["  \n\t\n   "], 10).collect()
    assert rows == []


def test_markdown_headings_open_chunks(spark):
    md = "# Pump\n\nintro text\n\n## Errors\n\nE42 means occlusion\n\n## Care\n\nclean weekly"
    rows = _chunks(spark, [md], 100, fmt="markdown").orderBy("chunk_index").collect()
    assert [r.headings for r in rows] == [["Pump"], ["Pump", "Errors"], ["Pump", "Care"]]
    assert rows[1].text == "Pump\nErrors\nE42 means occlusion"
    # heading tokens count against the limit
    assert rows[1].n_tokens == 1 + 1 + 3


def test_html_blocks(spark):
    html = ("<html><head><title>T</title><script>var x='<p>';</script></head><body><nav>menu</nav>"
            "<h1>Main &amp; more</h1><p>first para</p><div>second</div></body></html>")
    df = spark.createDataFrame([("p1", "site/p1.html", html)], "id string, uri string, text string")
    b = parse_documents(df).select("blocks").first().blocks
    assert [(x.text, list(x.headings)) for x in b] == [("first para", ["Main & more"]), ("second", ["Main & more"])]


def test_token_count_expression(spark):
    df = spark.createDataFrame([("a  b\tc\nd",), ("",), (None,)], "t string")
    assert [r.n for r in df.select(token_count(F.col("t")).alias("n")).collect()] == [4, 0, 0]


def test_history_window_buckets_are_exact(spark):
    from docweave.operators.chat import history_window

    rows = [("s", i, f"s-{i}", "user" if i % 2 == 0 else ("assistant" if i % 7 else "system"), f"c{i}")
            for i in range(60)] + [("t", 0, "t-0", "user", "only")]
    m = spark.createDataFrame(rows, "session_id string, seq long, id string, role string, content string")

    def hist(df, order="seq"):
        return {r.id: [h.content for h in r.history] for r in history_window(df, 4, order).collect()}

    ref = hist(m)
    times = m.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 3600))
    assert ref == hist(m.repartition(5)) == hist(times, "at")  # any order type and spacing
    assert ref["s-40"] == ["c36", "c37", "c38", "c39"] and ref["t-0"] == [] and "s-7" not in ref


def test_unclosed_skip_tags_keep_the_rest_of_the_page():
    from docweave.operators.parse import _html

    texts = lambda page: [b["text"] for b in _html(page)]
    assert texts("<body><nav><ul><li>menu</ul></nav><p>one</p><p>two") == ["one", "two"]
    assert texts("<body><nav><a>menu</a><h1>Head</h1><p>one</p><p>two</p>") == ["menu", "one", "two"]
    assert texts("<p>a</p><svg><text>x</text><p>b</p><noscript>c</noscript>") == ["a", "x", "b"]
    assert texts("<nav><template>t</nav><p>kept</p>") == ["kept"]  # closed with what is around it
    assert texts("<p>a</p></nav></svg><p>b</p><script>var x = '<p>no</p>'") == ["a", "b"]
    assert _html("<nav>x<h2>T</h2><p>y")[-1] == {"text": "y", "headings": ["T"]}
