"""Catalog entries: chat history, prompts, answers and deltas over the conversations and events fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions.text import file_title
from docweave.operators import chat as C
from docweave.operators.keyword import bm25_topk
from docweave.plans.catalog import register
from docweave.plans.q_retrieve import BM25_CTE, TITLE_SQL
from docweave.sources.testdata import duckdb_with

W = duckdb_with

# Our own system prompt (the reference's prompt text is not reused).
SYSTEM_PROMPT = "Answer from the context below and name the titles of the sources you used."
MODEL_OPTIONS = "model-b, model-a ,model-b,,"


def stored(td):
    return td["messages"].filter(F.col("role").isin(*C.STORED_ROLES))


@register("history_last_n", W("messages") + """
select session_id, cast(cnt - rn as integer) as pos, role, content from (
  select session_id, role, content,
         row_number() over (partition by session_id order by seq desc, id desc) as rn,
         count(*) over (partition by session_id) as cnt0
  from messages where role in ('user', 'assistant'))
  join (select session_id as s2, least(count(*), 10) as cnt from messages
        where role in ('user', 'assistant') group by 1) on s2 = session_id
where rn <= 10""")
def history_last_n(td):
    """H1: newest 10 stored messages of every session, oldest first."""
    return C.history_last_n(stored(td), 10, order_col="seq")


def _question_hits(td):
    """BM25 top-3 documents for every user turn, with title/content of the document."""
    qs = stored(td).filter(F.col("role") == "user").select(F.col("id").alias("qid"), F.col("content").alias("qtext"))
    top = bm25_topk(td["documents"], qs, 3)
    docs = td["corpus"].select("doc_id", file_title("uri").alias("title"), F.col("text").alias("content"))
    return top.join(docs, "doc_id").select(F.col("qid").alias("question_id"), "rank", "title", "content")


def prompts(td):
    """One message list per user turn (system, last 10 stored messages, user turn with context).

    Context block (F7) and sources line (A16) come from one aggregation over the hits, so
    the retrieval plan runs once even though both are used downstream.
    """
    h = C.history_window(td["messages"], 10, order_col="seq").filter(F.col("role") == "user")
    ctx = C.hit_summary(_question_hits(td))
    p = h.join(ctx, h["id"] == ctx["question_id"], "left")
    return p.select("id", "session_id", "seq", "trace_id", F.col("content").alias("message"),
                    F.coalesce("sources_text", F.lit("none")).alias("sources_text"),
                    C.build_messages(SYSTEM_PROMPT, F.col("history"), F.col("context"), F.col("content"))
                    .alias("messages"))


PROMPT_SQL = f"""
, queries as (select id as qid, content as qtext from messages where role = 'user')
{BM25_CTE}
, hits as (
  select b.qid, b.rank, {TITLE_SQL.format(u='c.uri')} as title, c.text as content
  from bm_ranked b join corpus c on b.doc_id = c.doc_id where b.rank <= 3),
ctx as (
  select qid, string_agg('[' || title || ']' || chr(10) || content, chr(10) || chr(10) order by rank) as context
  from hits group by qid),
st as (
  select *, row_number() over (partition by session_id order by seq, id) as k
  from messages where role in ('user', 'assistant')),
turns as (select * from st where role = 'user'),
msgs as (
  select t.id, t.session_id, t.seq, 0 as pos, 'system' as role, '{SYSTEM_PROMPT}' as content from turns t
  union all
  select t.id, t.session_id, t.seq, cast(h.k - greatest(t.k - 10, 1) + 1 as integer) as pos, h.role, h.content
  from turns t join st h on h.session_id = t.session_id and h.k < t.k and h.k >= t.k - 10
  union all
  select t.id, t.session_id, t.seq, cast(least(t.k - 1, 10) + 1 as integer) as pos, 'user' as role,
         'Context:' || chr(10) || coalesce(x.context, '') || chr(10) || chr(10) || 'Question: ' || t.content
  from turns t left join ctx x on x.qid = t.id)
"""


@register("prompt_messages", W("messages", "corpus") + PROMPT_SQL + """
select session_id, seq, pos, role, content from msgs""")
def prompt_messages(td):
    """Every prompt message of every user turn, flattened by position."""
    p = prompts(td)
    return p.select("session_id", "seq", F.posexplode("messages").alias("pos", "m")) \
        .select("session_id", "seq", F.col("pos").cast("int").alias("pos"), F.col("m.role").alias("role"),
                F.col("m.content").alias("content"))


@register("answer_table", W("messages", "corpus") + PROMPT_SQL + """
, first_hit as (select qid, title from hits where rank = 1),
src as (select qid, string_agg(title, ', ' order by rank) as sources_text from hits group by qid),
ntok as (select id, cast(sum(len(regexp_extract_all(content, '[^ \\t\\n\\r\\f\\x0B]+'))) as integer) as n from msgs group by id)
select t.id as turn_id, t.session_id, t.trace_id,
       case when f.title is not null then 'See ' || f.title || '.' else 'I could not find this in the documents.' end as answer,
       'model-b' as model, coalesce(s.sources_text, 'none') as sources_text, n.n as input_tokens,
       cast(case when f.title is not null then len(regexp_extract_all('See ' || f.title || '.', '[^ \\t\\n\\r\\f\\x0B]+'))
            else 7 end as integer) as output_tokens
from turns t left join first_hit f on f.qid = t.id left join src s on s.qid = t.id join ntok n on n.id = t.id""")
def answer_table(td):
    """R6 (offline model) / R7 / A16 / J7: answer, sources and tokens per turn."""
    p = prompts(td).withColumn("model", F.lit(None).cast("string"))
    p = C.model_allowlist(p, MODEL_OPTIONS, "model")
    done = C.complete_batch(p, C.stub_chat, "messages", "resolved_model")
    return done.select(F.col("id").alias("turn_id"), "session_id", "trace_id", "answer",
                       F.col("resolved_model").alias("model"), "sources_text", "input_tokens", "output_tokens")


@register("assemble_deltas", W("token_deltas") + """
select turn_id, coalesce(string_agg(delta, '' order by seq) filter (where delta <> ''), '') as answer,
       coalesce(arg_max(prompt_tokens, seq) filter (where prompt_tokens is not null or completion_tokens is not null), 0) as input_tokens,
       coalesce(arg_max(completion_tokens, seq) filter (where prompt_tokens is not null or completion_tokens is not null), 0) as output_tokens
from token_deltas group by turn_id""")
def assemble_deltas(td):
    """Streamed deltas to answer text and usage."""
    return C.assemble_deltas(td["token_deltas"])


@register("model_allowlist", W("app_dependencies") + """
select event_id, model, case when model in ('model-b', 'model-a') then model else 'model-b' end as resolved_model
from app_dependencies where Name = 'llm-call'""")
def model_allowlist(td):
    """Requested model kept only when allowed, else the first option."""
    deps = td["app_dependencies"].filter(F.col("Name") == "llm-call").select("event_id", "model")
    return C.model_allowlist(deps, MODEL_OPTIONS, "model")


@register("history_append", W("messages") + """
, turns as (
  select u.session_id || '/' || cast(u.seq as varchar) as turn_key, u.session_id, u.trace_id,
         u.content as message, a.content as answer
  from messages u join messages a on a.session_id = u.session_id and a.seq = u.seq + 1
  where u.role = 'user' and a.role = 'assistant')
select substr(sha256(turn_key || '/' || cast(k as varchar)), 1, 32) as id, session_id,
       case when k = 0 then 'user' else 'assistant' end as role,
       case when k = 0 then message else answer end as content, trace_id, k as order_in_turn
from turns, (select unnest([0, 1]) as k)""")
def history_append(td):
    """Two stored rows per finished turn (user, then assistant), replay-safe ids."""
    m = td["messages"]
    u = m.filter(F.col("role") == "user").alias("u")
    a = m.filter(F.col("role") == "assistant").alias("a")
    t = u.join(a, (F.col("u.session_id") == F.col("a.session_id")) & (F.col("a.seq") == F.col("u.seq") + 1))
    turns = t.select(F.concat_ws("/", F.col("u.session_id"), F.col("u.seq").cast("string")).alias("turn_key"),
                     C.session_default(F.col("u.session_id")).alias("session_id"), F.col("u.trace_id").alias("trace_id"),
                     F.col("u.content").alias("message"), F.col("a.content").alias("answer"))
    return C.history_rows(turns).drop("created_at")


@register("chat_turns_no_index", W("messages") + """
, turns as (
  select 'q' || session_id as question_id, trace_id as ignored, content as message,
         case when cast(session_id as bigint) % 3 = 0 then substr(sha256('q' || session_id), 1, 32) else session_id end as session_id
  from messages where seq = 0 and content is not null)
select substr(sha256(question_id || '/' || cast(k as varchar)), 1, 32) as id, session_id,
       case when k = 0 then 'user' else 'assistant' end as role,
       case when k = 0 then message else 'I could not find this in the documents.' end as content,
       md5('turn:' || question_id) as trace_id, k as order_in_turn
from turns, (select unnest([0, 1]) as k)""")
def chat_turns_no_index(td):
    """A batch of chat turns before any index exists; the history rows to store.

    One question per conversation (its first message); a third of them without a session.
    """
    from docweave.plans.chat_turn import answer_questions
    from docweave.session import scratch_path

    m = td["messages"].filter((F.col("seq") == 0) & F.col("content").isNotNull())
    number = F.col("session_id").cast("bigint")
    questions = m.select(
        F.concat(F.lit("q"), "session_id").alias("question_id"),
        F.when(number % 3 != 0, F.col("session_id")).when(number % 2 == 0, F.lit("")).alias("session_id"),
        F.col("content").alias("message"), F.lit(None).cast("string").alias("model"))
    stored = td["messages"].withColumn("created_at", F.col("seq"))
    out = answer_questions(td.spark, questions, scratch_path(td.spark, "no-such-index"), stored, MODEL_OPTIONS)
    return out.history_rows.drop("created_at")
