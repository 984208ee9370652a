"""Catalog entries: trigger events (batch forms) and streaming panels/deltas run to completion.

The streaming entries read the events table as a file stream, run with
``availableNow`` into a parquet sink under the shared checkpoint folder, and return
the sink read back. Append mode only emits what the watermark has closed, so their
oracles keep the windows (turns) that end before ``max(ts) - delay``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docweave.plans.catalog import register
from docweave.session import scratch_path
from docweave.sources.testdata import AS_OF, SPAN_TABLES, duckdb_with, spans_from, token_deltas_sql
from docweave.streaming import arrivals as A
from docweave.streaming import deltas as DL
from docweave.streaming import panels as P
from docweave.streaming.runner import in_order, run_available_now

W = duckdb_with
DELAY_MIN = 10


@register("event_filter", W("blob_events") + """
select event_id, event_time, subject from blob_events
where event_type = 'Microsoft.Storage.BlobCreated'
  and starts_with(subject, '/blobServices/default/containers/documents/blobs/')""")
def event_filter(td):
    """W2 (batch form): created blobs under the documents container."""
    return A.event_filter(td["blob_events"]).select("event_id", "event_time", "subject")


@register("event_expiry", W("blob_events") + """
select distinct on (event_id) event_id, event_time, event_type, subject from blob_events
where event_time > timestamp '2024-01-24 00:00:00'""")
def event_expiry(td):
    """W4 (batch form): events within the 7-day lifetime at as_of, one per event id."""
    return A.event_expiry(td["blob_events"], AS_OF, 7, streaming=False) \
        .select("event_id", "event_time", "event_type", "subject")


@register("drained_count", W("blob_events") + """
select count(distinct subject) as subjects, count(*) as drained from blob_events
where event_type = 'Microsoft.Storage.BlobCreated'
  and starts_with(subject, '/blobServices/default/containers/documents/blobs/')""")
def drained_count(td):
    """A17 / W3 (batch form): events drained and distinct subjects one ingest pass covers."""
    e = A.event_filter(td["blob_events"])
    return e.agg(F.count_distinct("subject").alias("subjects"), F.count(F.lit(1)).alias("drained"))


def _run(td, name: str, stream_df, mode: str = "append"):
    spark = td.spark
    base = scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex}")
    run_available_now(stream_df, f"{base}/out", f"{base}/ckpt", mode)
    return spark.read.parquet(f"{base}/out")


PART_ROWS = 250_000
TRIGGERS = 4


def _event_stream(td):
    """The events as a stream of ``TRIGGERS`` micro-batches, whatever the table's size: written once, in files of about
    ``PART_ROWS`` rows in order of the event id, which is that of time; a trigger takes the next quarter of the files."""
    ev = td["events"]
    n, last = ev.agg(F.count(F.lit(1)), F.max("event_id")).first()
    files = TRIGGERS * max(1, -(-n // (TRIGGERS * PART_ROWS)))
    step = -(-((last or 0) + 1) // files // 10) * 10 + 10  # a turn's ten events stay in one file
    folder = scratch_path(td.spark, f"event-parts-{uuid.uuid4().hex}")
    numbered = ev.filter(F.col("event_id") >= 0).withColumn("part", F.floor(F.col("event_id") / step).cast("int"))
    numbered.repartition(files, "part").write.option("maxRecordsPerFile", 0).partitionBy("part").parquet(folder)
    in_order(td.spark, folder, "part")
    return td.spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", files // TRIGGERS).option("recursiveFileLookup", "true").parquet(folder)


def _span_stream(td, table: str):
    return spans_from(_event_stream(td)).filter(F.col("Type") == SPAN_TABLES[table])


CHAT_WHERE = "regexp_matches(Name, '(?i)/chat([^a-z0-9]|$)')"
LLM_WHERE = "Name = 'llm-call'"
INGEST_WHERE = "Name = 'ingest-doc'"
CLOSED = "(select max(TimeGenerated) - interval '{d} minutes' from {t} where {w})"


@register("stream_request_volume", W("app_requests") + f"""
select time_bucket(interval '5 minutes', TimeGenerated) as TimeGenerated,
       count(*) as Requests, count(*) filter (where Success = false) as Failures
from app_requests where regexp_matches(Name, '(?i)/chat([^a-z0-9]|$)')
group by 1 having time_bucket(interval '5 minutes', TimeGenerated) + interval '5 minutes' <= {CLOSED.format(d=DELAY_MIN, t='app_requests', w=CHAT_WHERE)}""")
def stream_request_volume(td):
    """Chat requests per 5-minute window, streamed with a 10-minute watermark."""
    s = P.stream_request_volume(_span_stream(td, "app_requests"), delay=f"{DELAY_MIN} minutes")
    return _run(td, "request_volume", s)


@register("stream_tokens_over_time", W("app_dependencies") + f"""
select time_bucket(interval '15 minutes', TimeGenerated) as TimeGenerated, model,
       cast(sum(in_tok + out_tok) as bigint) as Tokens
from app_dependencies where Name = 'llm-call'
group by 1, 2 having time_bucket(interval '15 minutes', TimeGenerated) + interval '15 minutes' <= {CLOSED.format(d=DELAY_MIN, t='app_dependencies', w=LLM_WHERE)}""")
def stream_tokens_over_time(td):
    """Token sums per 15-minute window and model, streamed."""
    s = P.stream_tokens_over_time(_span_stream(td, "app_dependencies"), delay=f"{DELAY_MIN} minutes")
    return _run(td, "tokens_over_time", s)


@register("stream_ingest_throughput", W("app_dependencies") + f"""
select time_bucket(interval '1 hour', TimeGenerated) as TimeGenerated,
       count(*) filter (where Success = true) as Ingested, count(*) filter (where Success = false) as Failed
from app_dependencies where Name = 'ingest-doc'
group by 1 having time_bucket(interval '1 hour', TimeGenerated) + interval '1 hour' <= {CLOSED.format(d=DELAY_MIN, t='app_dependencies', w=INGEST_WHERE)}""")
def stream_ingest_throughput(td):
    """Ingest outcomes per hour, streamed."""
    s = P.stream_ingest_throughput(_span_stream(td, "app_dependencies"), delay=f"{DELAY_MIN} minutes")
    return _run(td, "ingest_throughput", s)


IDLE_MIN = 30


@register("stream_deltas", f"""
with d as (
  select cast(floor(event_id / 10) as bigint) as turn_id, event_id % 10 as seq, ts,
         case when event_type = 'error' then null when event_type = 'signup' then '' else event_type || ' ' end as delta,
         case when event_id % 10 = 9 and event_id % 30 <> 9 then cast(regexp_extract(props, '([0-9]+)', 1) as int) end as prompt_tokens,
         case when event_id % 10 = 9 and event_id % 30 <> 9 then cast(floor(value) as int) end as completion_tokens
  from events),
wm as (select epoch_ms(max(ts)) - {DELAY_MIN} * 60000 as w from events),
t as (
  select turn_id,
         coalesce(string_agg(delta, '' order by seq) filter (where delta <> ''), '') as answer,
         coalesce(arg_max(prompt_tokens, seq) filter (where prompt_tokens is not null or completion_tokens is not null), 0) as input_tokens,
         coalesce(arg_max(completion_tokens, seq) filter (where prompt_tokens is not null or completion_tokens is not null), 0) as output_tokens,
         count(*) filter (where prompt_tokens is not null or completion_tokens is not null) = 0 as timed_out,
         epoch_ms(max(ts)) as last_ms
  from d group by turn_id)
select turn_id, answer, cast(input_tokens as integer) as input_tokens, cast(output_tokens as integer) as output_tokens,
       timed_out
from t, wm where last_ms + case when timed_out then {IDLE_MIN} * 60000 else 0 end < wm.w""")
def stream_deltas(td):
    """Token deltas assembled per turn with state; emitted once, after the watermark has passed the turn."""
    ev = _event_stream(td)
    sql = token_deltas_sql("spark").replace("as completion_tokens\nfrom", "as completion_tokens, ts\nfrom")
    d = td.spark.sql(sql, events=ev)
    s = DL.stream_deltas(d, delay=f"{DELAY_MIN} minutes", idle_ms=IDLE_MIN * 60 * 1000)
    return _run(td, "deltas", s)

