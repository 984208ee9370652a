"""Catalog entries: corpus scan, diff, chunking, records and state over the corpus fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions.hashing import chunk_id_range
from docweave.operators import diff as D
from docweave.operators.chunk import DEFAULT_LIMIT, chunk_blocks
from docweave.operators.parse import parse_documents
from docweave.operators.records import build_records
from docweave.plans.catalog import register
from docweave.plans.ingest import plan_chunks
from docweave.sources import state as S
from docweave.sources.corpus import corpus_from_table, with_fingerprint
from docweave.sources.testdata import duckdb_with

W = duckdb_with
LIMIT = DEFAULT_LIMIT


def corpus(td):
    """The corpus fixture as a source frame (content = UTF-8 bytes of the text)."""
    return corpus_from_table(td["documents"], "doc_id", "text", source_col="source")


def state(td):
    """The ingest_state fixture with chunk id arrays."""
    st = td["ingest_state"]
    return st.select("doc_id", "source", "content_hash", chunk_id_range("doc_id", "n_chunks").alias("chunk_ids"))


def diff(td):
    fp = with_fingerprint(corpus(td))
    return D.ingest_diff(fp.select("id", "source", "content_hash"), S.state_scan(state(td)))


def chunks(td):
    c = corpus(td).withColumn("text", F.decode("content", "UTF-8"))
    return plan_chunks(c, "text", "text", LIMIT)


def chunks_cte(limit: int = LIMIT) -> str:
    """DuckDB: the same chunk definition by a recursive query (greedy fold per document)."""
    return f"""
, lines as (
  select id, uri, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as ln
  from corpus),
tok as (
  select id, uri, ln, line, regexp_extract_all(line, '[^ \\t\\n\\r\\f\\x0B]+') as toks from lines),
tok2 as (select id, uri, ln, line, toks, len(toks) as n from tok where len(toks) > 0),
pieces as (
  select id, ln, 0 as w, line as text, n as tokens from tok2 where n <= {limit}
  union all
  select id, ln, w, array_to_string(toks[w * {limit} + 1 : (w + 1) * {limit}], ' ') as text,
         least({limit}, n - w * {limit}) as tokens
  from (select id, ln, toks, n, unnest(range(cast(ceil(n / {limit}) as bigint))) as w from tok2 where n > {limit})),
numbered as (
  select id, row_number() over (partition by id order by ln, w) as k, text, tokens from pieces),
fold as (
  select id, k, 0 as chunk_no, tokens as used from numbered where k = 1
  union all
  select n.id, n.k,
         case when f.used + n.tokens > {limit} then f.chunk_no + 1 else f.chunk_no end,
         case when f.used + n.tokens > {limit} then n.tokens else f.used + n.tokens end
  from fold f join numbered n on n.id = f.id and n.k = f.k + 1),
chunks as (
  select f.id, cast(f.chunk_no as integer) as chunk_index, cast(sum(n.tokens) as integer) as n_tokens,
         string_agg(n.text, chr(10) order by n.k) as text
  from fold f join numbered n on f.id = n.id and f.k = n.k
  group by f.id, f.chunk_no)
"""


def _with_recursive(*views: str) -> str:
    return W(*views).replace("with ", "with recursive ", 1)


DIFF_SQL = """
, scoped as (select * from ingest_state where source in (select distinct source from corpus)),
diff as (
  select coalesce(c.id, s.doc_id) as doc_id, coalesce(c.source, s.source) as source,
         case when s.doc_id is null then 'new' when c.id is null then 'gone'
              when s.content_hash = sha256(c.text) then 'unchanged' else 'changed' end as status,
         sha256(c.text) as hash, s.content_hash as known_hash, s.n_chunks as known_chunks
  from corpus c full outer join scoped s on c.id = s.doc_id)
"""


@register("corpus_scan", W("corpus") + """
select id, uri, source, sha256(text) as content_hash, 'text/plain' as content_type,
       cast(octet_length(encode(text)) as bigint) as n_bytes
from corpus""")
def corpus_scan(td):
    """Fingerprinted corpus listing."""
    fp = with_fingerprint(corpus(td))
    return fp.select("id", "uri", "source", "content_hash", "content_type",
                     F.length("content").cast("bigint").alias("n_bytes"))


@register("corpus_sources", W("corpus") + """
select id, uri, source, sha256(text) as content_hash, 'text/plain' as content_type from corpus
union all
select 'web:' || cast(page_id as varchar) as id, url as uri, 'web' as source, sha256(html) as content_hash,
       case when url like '%.html' then 'text/html' else 'application/octet-stream' end as content_type from pages
union all
select 'made:' || cast(page_id as varchar) as id, url as uri, 'made' as source, sha256(html) as content_hash,
       case when url like '%.html' then 'text/html' else 'application/octet-stream' end as content_type from pages""")
def corpus_sources(td):
    """Documents, web pages and the same pages through a connector, as one corpus."""
    from docweave.plans.stand_ins import PagesSource
    from docweave.sources.corpus import corpus_from_source, corpus_union

    pages = td["pages"].select(
        F.concat(F.lit("web:"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("uri"), F.lit("web").alias("source"),
        F.encode("html", "UTF-8").alias("content"))
    made = corpus_from_source(td.spark, PagesSource.over(td["pages"]))
    return with_fingerprint(corpus_union(corpus(td), pages, made)).select("id", "uri", "source", "content_hash", "content_type")


@register("ingest_diff", W("corpus", "ingest_state") + DIFF_SQL + """
select doc_id, source, status, hash, known_hash, known_chunks from diff""")
def ingest_diff(td):
    """New / changed / unchanged / gone per document (gone scoped to scanned sources)."""
    d = diff(td)
    return d.select("doc_id", "source", "status", "hash", "known_hash",
                    F.when(F.col("chunk_ids").isNotNull(), F.size("chunk_ids")).alias("known_chunks"))


@register("ingest_status_counts", W("corpus", "ingest_state") + DIFF_SQL + """
select status, count(*) as docs from diff group by status""")
def ingest_status_counts(td):
    """J1 summary: documents per status."""
    return diff(td).groupBy("status").agg(F.count(F.lit(1)).alias("docs"))


@register("gone_docs", W("corpus", "ingest_state") + DIFF_SQL + """
select doc_id, source, known_chunks as n_chunks from diff where status = 'gone'""")
def gone_docs(td):
    """J2 / S7 input."""
    return D.gone_docs(diff(td)).select("doc_id", "source", F.size("chunk_ids").alias("n_chunks"))


@register("chunk_documents", _with_recursive("corpus") + chunks_cte() + """
select id as doc_id, chunk_index, n_tokens, text from chunks""")
def chunk_documents(td):
    """E1 (text) / E3 / E4 / E5 / P2: every document of the corpus chunked at 1,024 tokens."""
    return chunks(td).select(F.col("id").alias("doc_id"), "chunk_index", "n_tokens", "text")


@register("chunk_totals", _with_recursive("corpus") + chunks_cte() + """
select count(*) as n_chunks, cast(sum(n_tokens) as bigint) as n_tokens,
       cast(max(n_tokens) as integer) as max_tokens, count(distinct id) as n_docs from chunks""")
def chunk_totals(td):
    """E3 invariants as numbers: totals, and the largest chunk stays within the limit."""
    c = chunks(td)
    return c.agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_tokens").cast("bigint").alias("n_tokens"),
                 F.max("n_tokens").alias("max_tokens"), F.count_distinct("id").alias("n_docs"))


@register("index_records", _with_recursive("corpus") + chunks_cte() + """
select sha1(c.id) || '-' || cast(c.chunk_index as varchar) as id, c.id as parent_id,
       coalesce(nullif(trim(translate(regexp_replace(regexp_extract(k.uri, '[^/]*$'), '\\.[^.]+$', ''), '_-', '  ')), ''), k.uri) as title,
       'chunk ' || cast(c.chunk_index as varchar) as section, c.text as content, k.uri as url,
       split_part(c.id, ':', 1) as source
from chunks c join corpus k on c.id = k.id""")
def index_records(td):
    """Index rows of every chunk (vectors are checked by tests)."""
    return build_records(chunks(td)).drop("updated_at", "chunk_index")


@register("stale_chunks", _with_recursive("corpus", "ingest_state") + chunks_cte() + DIFF_SQL + """
, counts as (select id, count(*) as m from chunks group by id)
select d.doc_id, sha1(d.doc_id) || '-' || cast(i as varchar) as chunk_id
from diff d join counts c on d.doc_id = c.id,
     unnest(range(cast(c.m as bigint), cast(d.known_chunks as bigint))) as r(i)
where d.status = 'changed'""")
def stale_chunks(td):
    """Old chunk ids a changed document no longer produces."""
    c = chunks(td)
    new_ids = c.groupBy(F.col("id").alias("doc_id")).agg(F.collect_list(
        F.concat_ws("-", F.sha1("id"), F.col("chunk_index").cast("string"))).alias("chunk_ids"))
    return D.stale_chunks(diff(td), new_ids)


@register("ingest_stats", _with_recursive("corpus", "ingest_state") + chunks_cte() + DIFF_SQL + """
, counts as (select id, count(*) as m from chunks group by id)
select count(*) filter (where d.status <> 'gone') as scanned,
       count(*) filter (where d.status in ('new', 'changed') and coalesce(c.m, 0) > 0) as ingested,
       count(*) filter (where d.status = 'unchanged' or (d.status in ('new', 'changed') and coalesce(c.m, 0) = 0)) as skipped,
       cast(coalesce(sum(case when d.status in ('new', 'changed') then c.m end), 0) as bigint) as chunks,
       count(*) filter (where d.status = 'gone') as pruned_docs
from diff d left join counts c on d.doc_id = c.id""")
def ingest_stats(td):
    """The run's counters (scanned, ingested, skipped, chunks, pruned_docs)."""
    c = chunks(td)
    counts = c.groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).cast("int").alias("n_chunks"))
    return D.ingest_stats(diff(td), counts)


@register("state_after_run", _with_recursive("corpus", "ingest_state") + chunks_cte() + DIFF_SQL + """
, counts as (select id, count(*) as m from chunks group by id)
select doc_id, source, content_hash, n_chunks from (
  select s.doc_id, s.source, s.content_hash, s.n_chunks from ingest_state s
  where s.doc_id not in (select doc_id from diff where status in ('new', 'changed', 'gone'))
  union all
  select d.doc_id, d.source, d.hash as content_hash, coalesce(c.m, 0) as n_chunks
  from diff d left join counts c on d.doc_id = c.id where d.status in ('new', 'changed'))""")
def state_after_run(td):
    """State after recording re-ingested docs and forgetting gone ones."""
    d = diff(td)
    c = chunks(td)
    new_ids = c.groupBy(F.col("id").alias("doc_id")).agg(F.collect_list(
        F.concat_ws("-", F.sha1("id"), F.col("chunk_index").cast("string"))).alias("chunk_ids"))
    todo = d.filter(F.col("status").isin(D.NEW, D.CHANGED)).drop("chunk_ids")
    fresh = todo.join(new_ids, "doc_id", "left").select(
        "doc_id", "source", F.col("hash").alias("content_hash"),
        F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))
    st = S.state_upsert(S.state_forget(state(td), D.gone_docs(d)), fresh)
    return st.select("doc_id", "source", "content_hash", F.size("chunk_ids").alias("n_chunks"))


def pages_corpus(td):
    """The web-page fixture as a corpus: ``id = 'web:' || page_id``, ``uri = url``, text = raw HTML."""
    p = td["pages"]
    return p.select(F.col("page_id"), F.concat(F.lit("web:"), F.col("page_id").cast("string")).alias("id"),
                    F.col("url").alias("uri"), F.lit("web").alias("source"), F.col("html").alias("text"))


@register("page_headings", """
select page_id,
       trim(regexp_replace(
         replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
           regexp_extract(html, '<h1>(.*?)</h1>', 1),
           '&quot;', '"'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'),
           '&quot', '"'), '&lt', '<'), '&gt', '>'), '&amp', '&'), '&nbsp;', ' '),
         '\\s+', ' ', 'g')) as heading
from pages""")
def page_headings(td):
    """E1 (HTML): the first heading found while parsing every page into blocks."""
    parsed = parse_documents(pages_corpus(td), "text", "html")
    first = F.filter("blocks", lambda b: F.size(b["headings"]) > 0)
    return parsed.select("page_id", F.element_at(F.element_at(first, 1)["headings"], 1).alias("heading"))


def _page_chunks(td):
    """E1 + E3 (HTML): every page parsed (scripts, styles, navigation dropped) and chunked."""
    parsed = parse_documents(pages_corpus(td), "text", "html")
    c = chunk_blocks(parsed.select("id", "uri", "blocks"), limit=LIMIT)
    return c.select(F.col("id").alias("doc_id"), "chunk_index", "n_tokens",
                    F.array_join("headings", " > ").alias("section"))


register("page_chunks")(_page_chunks)


def old_index(td):
    """The index as the fixture state describes it: placeholder chunks of every document known before the run."""
    known = S.state_rows(state(td), "2024-01-30 00:00:00").select("doc_id", "source", F.explode("chunk_ids").alias("id"))
    return known.select(
        "id", F.col("doc_id").alias("parent_id"), F.lit("old").alias("title"), F.lit("old").alias("section"),
        F.concat(F.lit("old "), "id").alias("content"), F.col("doc_id").alias("url"), "source",
        F.lit("2024-01-30 00:00:00").cast("timestamp").alias("updated_at"), F.array_repeat(F.lit(0.0).cast("float"), 4).alias("vector"))


def run_from_fixture(td, **settings):
    """The real incremental run over the whole corpus, from the fixture's index and state; returns (base folder, result)."""
    import uuid

    from docweave.plans.ingest import ingest_run
    from docweave.session import scratch_path
    from docweave.sources import bucketed, index_store

    base = scratch_path(td.spark, f"ingest-q-{uuid.uuid4().hex}")
    known, rows = old_index(td), S.state_rows(state(td), "2024-01-30 00:00:00")
    bucketed.replace(td.spark, f"{base}/index", index_store.INDEX_SCHEMA, "parent_id", lambda _: known, known.select("parent_id"), 64)
    bucketed.replace(td.spark, f"{base}/state", S.STATE_SCHEMA, "doc_id", lambda _: rows, rows.select("doc_id"), 64)
    return base, ingest_run(corpus(td), f"{base}/index", f"{base}/state", fmt="text", as_of="2024-01-31 00:00:00", **settings)


@register("ingest_run_stats", _with_recursive("corpus", "ingest_state") + chunks_cte() + DIFF_SQL + """
, counts as (select id, count(*) as m from chunks group by id)
select count(*) filter (where d.status <> 'gone') as scanned,
       count(*) filter (where d.status in ('new', 'changed') and coalesce(c.m, 0) > 0) as ingested,
       count(*) filter (where d.status = 'unchanged' or (d.status in ('new', 'changed') and coalesce(c.m, 0) = 0)) as skipped,
       cast(coalesce(sum(case when d.status in ('new', 'changed') then c.m end), 0) as bigint) as chunks,
       count(*) filter (where d.status = 'gone') as pruned_docs
from diff d left join counts c on d.doc_id = c.id""")
def ingest_run_stats(td):
    """The real incremental run (diff, parse, chunk, embed, index and state merge) over the
    whole corpus, starting from the fixture's index and state; returns the run's counters."""
    return run_from_fixture(td)[1].stats


@register("index_after_run", _with_recursive("corpus", "ingest_state") + chunks_cte() + DIFF_SQL + """
select sha1(c.id) || '-' || cast(c.chunk_index as varchar) as id, c.id as parent_id, c.text as content, k.uri as url,
       'chunk ' || cast(c.chunk_index as varchar) as section, split_part(c.id, ':', 1) as source, '2024-01-31' as updated,
       1 as unit_vector
from chunks c join corpus k on c.id = k.id join diff d on d.doc_id = c.id where d.status in ('new', 'changed')
union all
select sha1(s.doc_id) || '-' || cast(i as varchar) as id, s.doc_id as parent_id,
       'old ' || sha1(s.doc_id) || '-' || cast(i as varchar) as content, s.doc_id as url, 'old' as section, s.source, '2024-01-30' as updated,
       0 as unit_vector
from ingest_state s, unnest(range(cast(s.n_chunks as bigint))) as r(i)
where s.doc_id not in (select doc_id from diff where status in ('new', 'changed', 'gone'))""")
def index_after_run(td):
    """The index that the run wrote, read back: new chunks of new and changed documents, old ones of the rest."""
    from docweave.sources import index_store

    base, _ = run_from_fixture(td)
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return index_store.load_index(td.spark, f"{base}/index").select(
        "id", "parent_id", "content", "url", "section", "source", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"),
        F.round(norm).cast("int").alias("unit_vector"))


@register("state_written", _with_recursive("corpus", "ingest_state") + chunks_cte() + DIFF_SQL + """
, counts as (select id, count(*) as m from chunks group by id)
select sha1(doc_id) as id, doc_id, source, content_hash, n_chunks, updated from (
  select s.doc_id, s.source, s.content_hash, s.n_chunks, '2024-01-30' as updated from ingest_state s
  where s.doc_id not in (select doc_id from diff where status in ('new', 'changed', 'gone'))
  union all
  select d.doc_id, d.source, d.hash as content_hash, coalesce(c.m, 0) as n_chunks, '2024-01-31' as updated
  from diff d left join counts c on d.doc_id = c.id where d.status in ('new', 'changed'))""")
def state_written(td):
    """The state table that the run wrote, read back."""
    base, _ = run_from_fixture(td)
    return S.load_state(td.spark, f"{base}/state").select(
        "id", "doc_id", "source", "content_hash", F.size("chunk_ids").alias("n_chunks"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@register("index_batches", _with_recursive("corpus") + chunks_cte() + """
, acts as (select sha1(id) || '-' || cast(chunk_index as varchar) as id from chunks)
select substr(sha1(id), 1, 3) || '-' || cast(cast(floor((rn - 1) / 500) as bigint) as varchar) as batch,
       count(*) as actions
from (select id, row_number() over (partition by substr(sha1(id), 1, 3) order by id) as rn from acts)
group by 1""")
def index_batches(td):
    """Index actions of every chunk cut into deterministic request batches of at most 500."""
    from docweave.sources.index_store import batch_plan_keyed

    acts = build_records(chunks(td)).select("id")
    return batch_plan_keyed(acts, "id", 500).groupBy("batch").agg(F.count(F.lit(1)).alias("actions"))


@register("index_by_updated", W("corpus", "ingest_state") + """
select sha1(doc_id) || '-' || cast(i as varchar) as id, doc_id as parent_id,
       timestamp '2024-01-01 00:00:00' + interval (n_chunks) hour as updated_at,
       row_number() over (order by timestamp '2024-01-01 00:00:00' + interval (n_chunks) hour desc,
                          sha1(doc_id) || '-' || cast(i as varchar)) as place
from ingest_state, unnest(range(cast(n_chunks as bigint))) as r(i)
qualify place <= 100""")
def index_by_updated(td):
    """V5: the newest 100 index rows (the feature is a top list), ties by id, with their place."""
    from pyspark.sql import Window

    from docweave.operators.retrieve import sort_by_updated

    known = state(td).select("doc_id", F.size("chunk_ids").alias("n"), F.explode("chunk_ids").alias("id"))
    when = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, n, 0, 0)")
    rows = known.select("id", F.col("doc_id").alias("parent_id"), when.alias("updated_at"))
    top = sort_by_updated(rows, 100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("updated_at"), "id")).cast("bigint"))
