"""Catalog entries: de-identification, piece-wise redaction, event scrubbing and erasure."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import redact as X
from docweave.plans.catalog import register
from docweave.plans.stand_ins import failing_service
from docweave.sources.testdata import duckdb_with

W = duckdb_with


def _chain_sql(expr: str) -> tuple[str, list[tuple[str, str]]]:
    """DuckDB: the regex chain over ``expr`` and the (kind, count expr) list."""
    cur = expr
    counts = []
    for kind, pat, rep in X.PII_PATTERNS:
        p = pat.replace("\\\"", "\"").replace("'", "''")
        counts.append((kind, f"cast(len(regexp_extract_all({cur}, '{p}')) as integer)"))
        cur = f"regexp_replace({cur}, '{p}', '{rep}', 'g')"
    return cur, counts


_RED, _COUNTS = _chain_sql("text")


@register("deidentify_corpus", "select doc_id, " + _RED + " as text, "
          + ", ".join(f"{c} as n_{k}" for k, c in _COUNTS) + " from documents")
def deidentify_corpus(td):
    """Every document with e-mail, secret, phone, card and IP values replaced, and counts."""
    d = X.deidentify_corpus(td["documents"].select("doc_id", "text"))
    return d.select("doc_id", "text", *[f"n_{k}" for k, _, _ in X.PII_PATTERNS])


@register("redact_text", f"select doc_id, {_chain_sql("coalesce(text, '')")[0]} as redacted from documents")
def redact_text(td):
    """Whole texts through the regex chain."""
    return X.redact_text(td["documents"], "doc_id", "text")


@register("redact_text_service", f"""
with pieces as (
  select doc_id, i, substring(coalesce(text, ''), i * {X.PIECE_CHARS} + 1, {X.PIECE_CHARS}) as piece
  from documents, unnest(range(cast(greatest(1, ceil(length(coalesce(text, '')) / {X.PIECE_CHARS})) as bigint))) as r(i))
select doc_id, case when bool_or(contains(piece, '@')) then '{X.WITHHELD}'
                    else string_agg('<' || replace(piece, 'e', '*') || '>', '' order by i) end as redacted
from pieces group by doc_id""")
def redact_text_service(td):
    """5,000-character pieces through a callable that marks its pieces and fails on any that holds an @."""
    return X.redact_text(td["documents"], "doc_id", "text", failing_service)


def _events(td):
    d = td["documents"]
    marker = F.when(F.col("lang") != "es", F.lit('["text"]'))
    content = F.to_json(F.struct(F.col("doc_id"), F.col("lang"), F.col("text")))
    attrs = F.map_filter(F.create_map(F.lit("content"), content, F.lit(X.SCRUB_KEYS_ATTR), marker),
                         lambda k, v: v.isNotNull())
    return d.select(F.col("doc_id").alias("event_key"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("span_id"),
                    F.lit("gen_ai.content.document").alias("name"), F.lit(None).cast("timestamp").alias("ts"),
                    attrs.alias("attributes"))


@register("scrub_events", f"""
select doc_id as event_key, case when lang <> 'es' then {_RED} else text end as text,
       lang <> 'es' as was_marked, false as has_marker
from documents""")
def scrub_events(td):
    """Content events of every document; marked keys redacted, marker dropped."""
    out = X.scrub_events(_events(td))
    content = F.element_at("attributes", F.lit("content"))
    return out.select("event_key", F.get_json_object(content, "$.text").alias("text"),
                      (F.get_json_object(content, "$.lang") != "es").alias("was_marked"),
                      F.map_contains_key("attributes", F.lit(X.SCRUB_KEYS_ATTR)).alias("has_marker"))


@register("scrub_events_edge", f"""
select doc_id as event_key, doc_id % 7 as kind,
       case when doc_id % 7 in (1, 2) then null
            when doc_id % 7 in (0, 3, 4) then text
            when contains(text, '@') then '{X.WITHHELD}'
            else (select string_agg('<' || replace(substring(text, i * {X.PIECE_CHARS} + 1, {X.PIECE_CHARS}), 'e', '*') || '>', '' order by i)
                  from unnest(range(cast(greatest(1, ceil(length(text) / {X.PIECE_CHARS})) as bigint))) as r(i)) end as text,
       case when doc_id % 7 in (1, 2) then '{X.WITHHELD}' end as withheld,
       doc_id % 7 = 0 as has_marker
from documents""")
def scrub_events_edge(td):
    """X1-X5 on awkward events, through a service that fails on some texts.

    Kinds: 0 no event name (left alone), 1 payload no JSON, 2 marker no JSON (both withheld), 3 the marked value is a
    number, 4 nothing marked (payload as it is), 5 and 6 a marked text, withheld where the service fails.
    """
    d, kind = td["documents"], F.col("doc_id") % 7
    payload = F.when(kind == 1, F.col("text")).otherwise(F.to_json(F.struct("doc_id", "lang", "text")))
    marker = F.when(kind == 2, F.lit("not a list")).when(kind == 3, F.lit('["doc_id", "absent"]')).when(kind == 4, F.lit("[]")) \
        .otherwise(F.lit('["text"]'))
    events = d.select(
        F.col("doc_id").alias("event_key"), kind.alias("kind"),
        F.when(kind != 0, F.lit("gen_ai.content.document")).alias("name"),
        F.create_map(F.lit("content"), payload, F.lit(X.SCRUB_KEYS_ATTR), marker).alias("attributes"))
    out = X.scrub_events(events, failing_service)
    content = F.element_at("attributes", F.lit("content"))
    return out.select("event_key", "kind", F.get_json_object(content, "$.text").alias("text"),
                      F.when(content == X.WITHHELD, content).alias("withheld"),
                      F.map_contains_key("attributes", F.lit(X.SCRUB_KEYS_ATTR)).alias("has_marker"))


@register("erase_subjects", W("messages") + """
select id, session_id, role from messages
where session_id not in (select distinct cast(user_id as varchar) from events
                         where event_type = 'signup' and value > 300)""")
def erase_subjects(td):
    """Erasure requests (derived: signup events with value > 300 name a subject) delete every stored message of that subject."""
    who = td["events"].filter((F.col("event_type") == "signup") & (F.col("value") > 300)) \
        .select(F.col("user_id").cast("string").alias("session_id"))
    return X.erase_subjects(td["messages"], who).select("id", "session_id", "role")


@register("erase_traces", W("messages", "app_requests", "app_dependencies") + """
, who as (select distinct cast(user_id as varchar) as session_id from events where event_type = 'signup' and value > 300),
doomed as (select distinct md5(m.session_id) as trace_id from messages m join who w on m.session_id = w.session_id),
s as (select OperationId, Id, Type from app_requests union all select OperationId, Id, Type from app_dependencies)
select OperationId, Id, Type from s where not exists (select 1 from doomed d where d.trace_id = s.OperationId)""")
def erase_traces(td):
    """The same requests delete every span of the subjects' traces (messages keyed by the trace numbered like their session)."""
    who = td["events"].filter((F.col("event_type") == "signup") & (F.col("value") > 300)).select(F.col("user_id").cast("string").alias("session_id"))
    messages = td["messages"].withColumn("trace_id", F.md5("session_id"))
    spans = td["app_requests"].unionByName(td["app_dependencies"], allowMissingColumns=True)
    return X.erase_traces(spans, messages, who).select("OperationId", "Id", "Type")
