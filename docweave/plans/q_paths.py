"""Catalog entries: blocks and headings of pages, the whole health report, index widths, question vectors, empty documents,
and a connector's change listing streamed into an index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docweave.functions.text import contextualize, derive_title, section_path
from docweave.operators import retrieve as R
from docweave.operators import telemetry as T
from docweave.operators.embed import embed_questions
from docweave.operators.parse import parse_documents
from docweave.plans.catalog import SINCE, WINDOW_START, register
from docweave.plans.q_ingest import DIFF_SQL, chunks_cte, pages_corpus, run_from_fixture
from docweave.plans.q_retrieve import TITLE_SQL
from docweave.plans.stand_ins import PagesSource, letter_counts
from docweave.session import scratch_path
from docweave.sources import index_store
from docweave.sources.testdata import AS_OF, TestData, duckdb_with

W = duckdb_with

# the fixture pages: blocks end at these tags; menus are left out; a heading names what follows it
BLOCKS_SQL = """
with body as (
  select page_id, url, regexp_replace(regexp_extract(html, '(?s)<body>(.*)', 1), '(?s)<nav>.*?</nav>|<!--.*?-->', '', 'g') as b from pages),
marked as (
  select page_id, url, regexp_replace(regexp_replace(regexp_replace(b, '(?s)<h1>(.*?)</h1>', chr(30) || chr(31) || '\\1' || chr(30), 'g'),
         '</?(p|div|article|footer|ul|li|br)( [^>]*)?>', chr(30), 'g'), '<[^>]*>', '', 'g') as b from body),
pieces as (
  select page_id, url, unnest(string_split(b, chr(30))) as raw, generate_subscripts(string_split(b, chr(30)), 1) as ord from marked),
texts as (
  select page_id, url, ord, starts_with(raw, chr(31)) as is_heading,
         trim(regexp_replace(replace(replace(replace(replace(replace(raw, chr(31), ''), '&quot;', '"'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&'), '\\s+', ' ', 'g')) as text from pieces),
named as (
  select *, last_value(case when is_heading then text end ignore nulls) over (partition by page_id order by ord) as heading from texts where text <> ''),
blocks as (
  select page_id, url, row_number() over (partition by page_id order by ord) - 1 as pos, heading, text from named where not is_heading)
"""


@register("page_blocks", BLOCKS_SQL + f"""
select page_id, cast(pos as integer) as pos, coalesce(heading, 'chunk ' || cast(pos as varchar)) as section,
       coalesce(heading, {TITLE_SQL.format(u='url')}) as title, md5(coalesce(heading || chr(10), '') || text) as context_md5
from blocks""")
def page_blocks(td):
    """Every block of every page with its section, title and heading-contextualised text."""
    parsed = parse_documents(pages_corpus(td), "text", "html")
    b = parsed.select("page_id", "uri", F.posexplode("blocks").alias("pos", "block"))
    return b.select("page_id", "pos", section_path("block.headings", "pos").alias("section"),
                    derive_title("uri", "block.headings").alias("title"), F.md5(contextualize("block.headings", "block.text")).alias("context_md5"))


REPORT_SQL = f"""
select 'requests' as section, AppRoleName as who, Name as what, count(*) as n, cast(count(*) filter (where Success = false) as double) as a,
       round(quantile_cont(DurationMs, 0.5), 0) as b, round(quantile_cont(DurationMs, 0.95), 0) as c
from app_requests where TimeGenerated > {WINDOW_START} group by AppRoleName, Name
union all
select 'dependencies', AppRoleName, Name, count(*), cast(count(*) filter (where Success = false) as double),
       round(quantile_cont(DurationMs, 0.5), 0), round(quantile_cont(DurationMs, 0.95), 0)
from app_dependencies where TimeGenerated > {WINDOW_START} group by AppRoleName, Name
union all
select 'tokens', null, model, count(*), null, cast(sum(in_tok) as double), cast(sum(out_tok) as double)
from app_dependencies where TimeGenerated > {WINDOW_START} and (in_tok is not null or out_tok is not null) group by model
union all
select * from (select 'exceptions', AppRoleName, ProblemId, count(*) as n, null, null, null
               from app_exceptions where TimeGenerated > {WINDOW_START} group by AppRoleName, ProblemId order by n desc, ProblemId, AppRoleName limit 10)
union all
select 'recent_failures', AppRoleName, Op, count(*), null, null, null from (
  select AppRoleName, Name as Op, TimeGenerated, Id from app_requests where TimeGenerated > {WINDOW_START} and Success = false
  union all
  select AppRoleName, Name as Op, TimeGenerated, Id from app_dependencies where TimeGenerated > {WINDOW_START} and Success = false
  order by TimeGenerated desc, Id limit 20) group by AppRoleName, Op"""


@register("health_report_values", W("app_requests", "app_dependencies", "app_exceptions") + REPORT_SQL)
def health_report_values(td):
    """Every section of the one-document report, read back from its JSON."""
    rep = T.health_report(td["app_requests"], td["app_dependencies"], td["app_exceptions"], AS_OF, SINCE)
    health = "array<struct<AppRoleName:string, Name:string, Requests:bigint, Calls:bigint, Failures:bigint, P50:double, P95:double>>"
    doc = rep.select(F.from_json("report", (
        f"struct<requests:{health}, dependencies:{health}, tokens:array<struct<Model:string, Calls:bigint, InTokens:bigint, OutTokens:bigint>>, "
        "exceptions:array<struct<ProblemId:string, AppRoleName:string, Count:bigint>>, recent_failures:array<struct<AppRoleName:string, Op:string>>>")).alias("d"))
    parts = []
    for section, who, what, n, numbers in (
            ("requests", "r.AppRoleName", "r.Name", "r.Requests", ("r.Failures", "r.P50", "r.P95")), ("dependencies", "r.AppRoleName", "r.Name", "r.Calls", ("r.Failures", "r.P50", "r.P95")),
            ("tokens", None, "r.Model", "r.Calls", (None, "r.InTokens", "r.OutTokens")), ("exceptions", "r.AppRoleName", "r.ProblemId", "r.Count", (None,) * 3),
            ("recent_failures", "r.AppRoleName", "r.Op", None, (None,) * 3)):
        rows = doc.select(F.explode(f"d.{section}").alias("r")).select(
            F.lit(section).alias("section"), (F.col(who) if who else F.lit(None).cast("string")).alias("who"), F.col(what).alias("what"),
            (F.col(n) if n else F.lit(1).cast("bigint")).alias("n"),
            *[(F.col(c) if c else F.lit(None)).cast("double").alias(name) for c, name in zip(numbers, "abc")])
        parts.append(rows if n else rows.groupBy("section", "who", "what", "a", "b", "c").agg(F.sum("n").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("index_widths", """
select cast(vec_id as varchar) as id, case when vec_id % 9 = 0 then 32 end as width from embeddings where vec_id % 9 = 0 or vec_id % 11 = 0""")
def index_widths(td):
    """Records whose vector is missing or of another width than the index (the fixture cuts every ninth and drops every eleventh)."""
    v = F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 32)).when(F.col("vec_id") % 11 != 0, F.col("embedding"))
    return index_store.index_ensure(td["embeddings"].select(F.col("vec_id").cast("string").alias("id"), v.alias("vector")), 64)


@register("question_vectors", """
with v as (select item_id, [cast(length(text) as double), cast(length(text) - length(replace(text, 'a', '')) as double),
                            cast(length(text) - length(replace(text, 'e', '')) as double), cast(length(text) - length(replace(text, chr(10), '')) as double)] as e from benchmark),
d as (select doc_id, [cast(length(text) as double), cast(length(text) - length(replace(text, 'a', '')) as double),
                      cast(length(text) - length(replace(text, 'e', '')) as double), cast(length(text) - length(replace(text, chr(10), '')) as double)] as e
      from (select doc_id, coalesce(text, '') as text from documents)),
s as (select item_id, doc_id, list_dot_product(v.e, d.e) as score, row_number() over (partition by item_id order by list_dot_product(v.e, d.e) desc, doc_id) as rank from v, d)
select item_id, doc_id, cast(rank as integer) as rank, score from s where rank <= 3""")
def question_vectors(td):
    """V4: benchmark passages embedded as questions by a callable, searched in the documents' vectors by the same one."""
    q = embed_questions(td["benchmark"].select(F.col("item_id").alias("question_id"), "text"), "text", "qvec", letter_counts)
    d = embed_questions(td["documents"].select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")), "text", "vector", letter_counts)
    top = R.vector_topk(d.select("id", "vector"), q.select("question_id", "qvec"), 3, metric="dot")
    return top.select(F.col("question_id").alias("item_id"), F.col("id").alias("doc_id"), "rank", "score")


class _Blanked(TestData):
    """The fixture with every seventh document blank."""

    def table(self, name):
        if name == "documents" and name not in self._cache:
            text = F.when(F.col("doc_id") % 7 == 0, F.lit(" \n ")).otherwise(F.col("text"))
            self._cache[name] = super().table(name).withColumn("text", text)
        return super().table(name)

    __getitem__ = table


BLANKED = "(select doc_id, case when doc_id % 7 = 0 then ' ' || chr(10) || ' ' else text end as text, source from documents)"


def _blanked(sql: str) -> str:
    return sql.replace("from documents", f"from {BLANKED}")


@register("empty_documents", _blanked(W("corpus", "ingest_state").replace("with ", "with recursive ", 1) + chunks_cte()) + DIFF_SQL + """
, counts as (select id, count(*) as m from chunks group by id),
todo as (select d.*, coalesce(c.m, 0) as m from diff d left join counts c on d.doc_id = c.id where d.status in ('new', 'changed')),
kept as (select s.* from ingest_state s where s.doc_id in (select doc_id from todo where m = 0))
select (select count(*) from diff where status = 'unchanged') + (select count(*) from todo where m = 0) as skipped,
       (select count(*) from todo where m > 0) as ingested, (select count(*) from todo where m = 0) as blank,
       (select cast(coalesce(sum(n_chunks), 0) as bigint) from kept) as old_chunks_kept""")
def empty_documents(td):
    """A real run over a corpus in which every seventh document is blank, left as it was: counted as skipped, its old chunks kept."""
    td = _Blanked(td.spark, td.sf_dir)
    base, result = run_from_fixture(td, empty_policy="keep")
    blank = td["corpus"].filter("doc_id % 7 = 0 and doc_id % 10 >= 7").select(F.col("id").alias("parent_id"))  # known under another hash, or new
    kept = index_store.load_index(td.spark, f"{base}/index").filter("section = 'old'").join(blank, "parent_id", "left_semi")
    counts = result.stats.select(F.lit("a").alias("part"), "skipped", "ingested").unionByName(
        blank.agg(F.count(F.lit(1)).alias("blank")).withColumn("part", F.lit("b")), allowMissingColumns=True).unionByName(
        kept.agg(F.count(F.lit(1)).alias("old_chunks_kept")).withColumn("part", F.lit("c")), allowMissingColumns=True)
    return counts.agg(*[F.max(c).alias(c) for c in ("skipped", "ingested", "blank", "old_chunks_kept")])


@register("arrival_ingest", """
select 'made:' || cast(page_id as varchar) as id, url as uri, sha256(html) as content_hash from pages""")
def arrival_ingest(td):
    """A connector over the pages table streams its change listing in several triggers into a real index and
    state; a second start of the stream adds nothing. Returns the state's documents (the index is compared in tests)."""
    from docweave.plans.ingest import ingest_arrivals
    from docweave.sources import state as S
    from docweave.sources.connector_stream import connector_stream

    base = scratch_path(td.spark, f"arrivals-{uuid.uuid4().hex}")
    growing = PagesSource.over(td["pages"], arrivals=3)
    for source in (growing, PagesSource(growing.path)):
        ingest_arrivals(connector_stream(td.spark, source), f"{base}/index", f"{base}/state", f"{base}/ck", as_of=AS_OF)
    docs = S.load_state(td.spark, f"{base}/state").select(F.col("doc_id").alias("id"), "content_hash")
    urls = td["pages"].select(F.concat(F.lit("made:"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("uri"))
    return docs.join(urls, "id").select("id", "uri", "content_hash")
