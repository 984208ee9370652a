"""Catalog entries: telemetry health, panels and traces over the spans fixture."""

from __future__ import annotations


from docweave.operators import telemetry as T
from docweave.operators import trace as TR
from docweave.plans.catalog import SINCE, WINDOW_START, register
from docweave.sources.testdata import AS_OF, duckdb_with

W = duckdb_with


@register("health_requests", W("app_requests") + f"""
select AppRoleName, Name, count(*) as Requests, count(*) filter (where Success = false) as Failures,
       round(quantile_cont(DurationMs, 0.5), 0) as P50,
       round(quantile_cont(DurationMs, 0.95), 0) as P95,
       round(avg(DurationMs), 0) as AvgMs,
       round(100.0 * (count(*) filter (where Success = false)) / count(*), 1) as ErrorRatePct
from app_requests where TimeGenerated > {WINDOW_START}
group by AppRoleName, Name""")
def health_requests(td):
    """A1: request health per role and operation over the whole fixture window."""
    return T.health_requests(td["app_requests"], AS_OF, SINCE)


@register("health_dependencies", W("app_dependencies") + f"""
select AppRoleName, Name, count(*) as Calls, count(*) filter (where Success = false) as Failures,
       round(quantile_cont(DurationMs, 0.5), 0) as P50,
       round(quantile_cont(DurationMs, 0.95), 0) as P95
from app_dependencies where TimeGenerated > {WINDOW_START}
group by AppRoleName, Name""")
def health_dependencies(td):
    """A2."""
    return T.health_dependencies(td["app_dependencies"], AS_OF, SINCE)


@register("token_usage", W("app_dependencies") + f"""
select model as Model, count(*) as Calls, cast(sum(in_tok) as bigint) as InTokens,
       cast(sum(out_tok) as bigint) as OutTokens
from app_dependencies
where TimeGenerated > {WINDOW_START} and (in_tok is not null or out_tok is not null)
group by model""")
def token_usage(td):
    """A3: property-bag token reads, null-skipping sums."""
    return T.token_usage(td["app_dependencies"], AS_OF, SINCE)


@register("exceptions_top", W("app_exceptions") + f"""
select ProblemId, AppRoleName, count(*) as Count
from app_exceptions where TimeGenerated > {WINDOW_START}
group by ProblemId, AppRoleName
order by Count desc, ProblemId, AppRoleName limit 10""")
def exceptions_top(td):
    """A4: top-10 report (the limit is the feature)."""
    return T.exceptions_top(td["app_exceptions"], AS_OF, SINCE)


@register("health_totals", W("app_requests") + f"""
select cast(count(*) as bigint) as total, count(*) filter (where Success = false) as failed,
       case when count(*) > 0 then round(100.0 * (count(*) filter (where Success = false)) / count(*), 1) end as rate_pct,
       case when count(*) > 0 then cast(round(100.0 * (count(*) filter (where Success = false)) / count(*), 1) as varchar) || '%'
            else 'n/a' end as rate
from app_requests where TimeGenerated > {WINDOW_START}""")
def health_totals(td):
    """A5: grand totals over the A1 rows."""
    return T.health_totals(T.request_counts(td["app_requests"], AS_OF, SINCE))


@register("recent_failures", W("app_requests", "app_dependencies") + f"""
select TimeGenerated, K, AppRoleName, Op, ResultCode, TraceId from (
  select TimeGenerated, 'request' as K, AppRoleName, Name as Op, ResultCode, OperationId as TraceId, Id
  from app_requests where TimeGenerated > {WINDOW_START} and Success = false
  union all
  select TimeGenerated, 'dependency' as K, AppRoleName, Name as Op, ResultCode, OperationId as TraceId, Id
  from app_dependencies where TimeGenerated > {WINDOW_START} and Success = false)
order by TimeGenerated desc, Id limit 20""")
def recent_failures(td):
    """Newest failures over both span tables (top-20 report)."""
    return T.recent_failures(td["app_requests"], td["app_dependencies"], AS_OF, SINCE)


@register("recent_requests", W("app_requests") + f"""
select TimeGenerated, AppRoleName, Name, Success, DurationMs, ResultCode, OperationId
from app_requests where TimeGenerated > {WINDOW_START}
order by TimeGenerated desc, Id limit 50""")
def recent_requests(td):
    """Newest 50 requests."""
    return T.recent_requests(td["app_requests"], AS_OF, SINCE)


@register("recent_request_failures", W("app_requests") + f"""
select TimeGenerated, AppRoleName, Name, Success, DurationMs, ResultCode, OperationId
from app_requests where TimeGenerated > {WINDOW_START} and Success = false
order by TimeGenerated desc, Id limit 50""")
def recent_request_failures(td):
    """P11 variation: failures only."""
    return T.recent_requests(td["app_requests"], AS_OF, SINCE, failures_only=True)


@register("latency_profile", W("app_requests") + f"""
select Name, AppRoleName, count(*) as count_, avg(DurationMs) as avg_DurationMs,
       quantile_cont(DurationMs, 0.95) as p95
from app_requests where TimeGenerated > {WINDOW_START}
group by Name, AppRoleName""")
def latency_profile(td):
    """A6."""
    return T.latency_profile(td["app_requests"], AS_OF, SINCE)


@register("stage_latency", W("app_dependencies") + f"""
select Name, quantile_cont(DurationMs, 0.5) as p50, quantile_cont(DurationMs, 0.95) as p95
from app_dependencies where Name in ('retrieve', 'llm-call')
group by Name""")
def stage_latency(td):
    """A7."""
    return T.stage_latency(td["app_dependencies"])


@register("request_volume", W("app_requests") + """
select time_bucket(interval '5 minutes', TimeGenerated) as TimeGenerated,
       count(*) as Requests, count(*) filter (where Success = false) as Failures
from app_requests where regexp_matches(Name, '(?i)/chat([^a-z0-9]|$)')
group by 1""")
def request_volume(td):
    """Chat requests per 5-minute bin."""
    return T.request_volume(td["app_requests"])


@register("tokens_over_time", W("app_dependencies") + """
select time_bucket(interval '15 minutes', TimeGenerated) as TimeGenerated, model,
       cast(sum(in_tok + out_tok) as bigint) as Tokens
from app_dependencies where Name = 'llm-call'
group by 1, 2""")
def tokens_over_time(td):
    """Null-propagating token sum per 15-minute bin and model."""
    return T.tokens_over_time(td["app_dependencies"])


@register("gateway_codes", W("app_requests") + """
select ResultCode, AppRoleName, count(*) as Count
from app_requests
where regexp_matches(Name, '(?i)(^|[^a-z0-9])chat([^a-z0-9]|$)')
   or regexp_matches(Name, '(?i)(^|[^a-z0-9])embeddings([^a-z0-9]|$)')
group by ResultCode, AppRoleName""")
def gateway_codes(td):
    """A10."""
    return T.gateway_codes(td["app_requests"])


@register("failed_read_path", W("app_dependencies") + """
select TimeGenerated, Name, ResultCode, DurationMs, OperationId
from app_dependencies where Name in ('llm-call', 'retrieve') and Success = false
order by TimeGenerated desc, Id limit 100""")
def failed_read_path(td):
    """K2: newest 100 failed read-path spans."""
    return T.failed_read_path(td["app_dependencies"])


@register("ingest_throughput", W("app_dependencies") + """
select time_bucket(interval '1 hour', TimeGenerated) as TimeGenerated,
       count(*) filter (where Success = true) as Ingested, count(*) filter (where Success = false) as Failed
from app_dependencies where Name = 'ingest-doc'
group by 1""")
def ingest_throughput(td):
    """A11."""
    return T.ingest_throughput(td["app_dependencies"])


@register("ingest_failures", W("app_dependencies") + """
select TimeGenerated, prop_doc_id as docId, ResultCode, OperationId
from app_dependencies where Name = 'ingest-doc' and Success = false
order by TimeGenerated desc, Id limit 100""")
def ingest_failures(td):
    """K3: bag read of doc.id."""
    return T.ingest_failures(td["app_dependencies"])


@register("change_feed", W("activity_log") + """
select TimeGenerated, OperationNameValue, ActivityStatusValue, Caller
from activity_log
where CategoryValue = 'Administrative'
  and (regexp_matches(OperationNameValue, '(?i)(^|[^a-z0-9])deployments/write([^a-z0-9]|$)')
    or regexp_matches(OperationNameValue, '(?i)(^|[^a-z0-9])containerapps/write([^a-z0-9]|$)')
    or regexp_matches(OperationNameValue, '(?i)(^|[^a-z0-9])jobs/start/action([^a-z0-9]|$)')
    or regexp_matches(OperationNameValue, '(?i)(^|[^a-z0-9])restart([^a-z0-9]|$)'))
  and ActivityStatusValue in ('Success', 'Succeeded', 'Accepted', 'Started')
order by TimeGenerated desc, event_id limit 100""")
def change_feed(td):
    """K4: has_any over operation names."""
    return T.change_feed(td["activity_log"])


@register("trace_timeline", W("app_requests", "app_dependencies") + """
select OperationId, TimeGenerated, Type as Kind, AppRoleName, Name as Op, Success, DurationMs,
       ResultCode, Id, ParentId
from (select * from app_requests union all select * from app_dependencies)""")
def trace_timeline(td):
    """K5: every trace's spans in time order."""
    return T.trace_timeline(td["app_requests"], td["app_dependencies"])


@register("union_telemetry", W("app_requests", "app_dependencies", "app_traces") + """
select OperationId, TimeGenerated, Type as Kind, AppRoleName, coalesce(Name, Message) as Op,
       Success, DurationMs, ResultCode, Id, ParentId
from (select * from app_requests union all select * from app_dependencies
      union all select * from app_traces)""")
def union_telemetry(td):
    """Requests, dependencies and logs under one shape."""
    return T.union_telemetry(td["app_requests"], td["app_dependencies"], td["app_traces"])


@register("trace_logs", W("app_requests", "app_dependencies", "app_traces") + """
select OperationId, TimeGenerated, AppRoleName, coalesce(Name, Message) as Op
from (select * from app_requests union all select * from app_dependencies
      union all select * from app_traces)
where Id is null or Id = ''""")
def trace_logs(td):
    """R2."""
    u = T.union_telemetry(td["app_requests"], td["app_dependencies"], td["app_traces"])
    return T.trace_logs(u)


@register("trace_content", W("app_traces") + """
select OperationId, TimeGenerated, Message as Kind, case when event_id % 3 <> 0 then 'payload ' || cast(event_id as varchar) end as content
from app_traces where starts_with(lower(Message), 'gen_ai.content')""")
def trace_content(td):
    """Content events with their payload (two of three fixture rows carry one)."""
    from pyspark.sql import functions as F

    payload = F.create_map(F.lit("content"), F.concat(F.lit("payload "), F.col("event_id").cast("string")))
    traces = td["app_traces"].withColumn("Properties", F.when(F.col("event_id") % 3 != 0, F.map_concat("Properties", payload))
                                         .otherwise(F.col("Properties")))
    return T.trace_content(traces)


@register("retention", W("spans") + """
select event_id, TimeGenerated, Type, Name from spans
where TimeGenerated >= timestamp '2024-01-24 00:00:00'""")
def retention(td):
    """Rows a 7-day retention keeps at as_of."""
    return T.retention(td.spans(), AS_OF, days=7).select("event_id", "TimeGenerated", "Type", "Name")


@register("span_parent", W("app_requests", "app_dependencies") + """
, s as (select * from app_requests union all select * from app_dependencies)
select c.OperationId, c.Id, c.ParentId, p.Id as parent_key
from s c left join (select distinct OperationId, Id from s) p
  on c.OperationId = p.OperationId and c.ParentId = p.Id
where c.Id is not null and c.Id <> ''""")
def span_parent(td):
    """J6."""
    spans = TR.span_rows(td["app_requests"], td["app_dependencies"])
    return TR.span_parent(spans).select("OperationId", "Id", "ParentId", "parent_key")


@register("span_tree", (W("app_requests", "app_dependencies") + """
, s as (select * from app_requests union all select * from app_dependencies where Id is not null),
e as (select c.OperationId, c.Id, p.Id as parent_key, c.TimeGenerated, c.Name, c.AppRoleName,
             c.DurationMs, c.Success, c.ResultCode
      from s c left join (select distinct OperationId, Id from s) p
        on c.OperationId = p.OperationId and c.ParentId = p.Id),
walk as (
  select OperationId, Id, parent_key, 0 as depth, Id as path from e where parent_key is null
  union all
  select e.OperationId, e.Id, e.parent_key, w.depth + 1, w.path || '/' || e.Id
  from e join walk w on e.OperationId = w.OperationId and e.parent_key = w.Id)
select w.OperationId, w.Id, w.parent_key, cast(w.depth as integer) as depth, w.path, e.TimeGenerated,
       e.Name as Op, e.AppRoleName, e.DurationMs,
       case when e.Success = true then 'ok' else coalesce(nullif(e.ResultCode, ''), 'FAIL') end as status
from walk w join e on w.OperationId = e.OperationId and w.Id = e.Id""").replace(
    "with spans", "with recursive spans", 1))
def span_tree(td):
    """Span forest of every trace with depth (recursive query)."""
    spans = TR.span_rows(td["app_requests"], td["app_dependencies"])
    return TR.span_tree(spans)


@register("trace_to_history", W("messages", "app_requests") + """
select r.OperationId as trace_id, m.session_id, m.id, m.role, m.content, r.TimeGenerated as trace_time, r.Name as root_op
from messages m join app_requests r on md5(m.session_id) = r.OperationId
where r.ParentId is null""")
def trace_to_history(td):
    """Stored exchange per trace (every message keyed by the trace numbered like its session, so that keys meet)."""
    from pyspark.sql import functions as F

    return TR.trace_to_history(td["messages"].withColumn("trace_id", F.md5("session_id")), td["app_requests"])


MID_MONTH = "2024-01-15 12:00:00"


@register("time_windows", W("app_requests") + " union all ".join([f"""
select '{label}' as window, count(*) as requests, count(*) filter (where Success = false) as failures
from app_requests where TimeGenerated > timestamp '{MID_MONTH}' - interval {span}""" for label, span in (
    ("15m", "15 minutes"), ("1h", "1 hour"), ("4h", "4 hours"), ("24h", "24 hours"), ("7d", "7 days"))]))
def time_windows(td):
    """Requests and failures after the start of each panel window, counted from mid-month."""
    from pyspark.sql import functions as F

    out = None
    for since in ("15m", "1h", "4h", "24h", "7d"):
        part = T.time_range(td["app_requests"], MID_MONTH, since).agg(
            F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("Success")).alias("failures")).select(
            F.lit(since).alias("window"), "requests", "failures")
        out = part if out is None else out.unionByName(part)
    return out


ONE_TRACE = "eccbc87e4b5ce2fe28308fd9f2a7baf3"  # md5 of "3": the fixture's trace number 3


@register("trace_by_id", W("app_requests", "app_dependencies") + f"""
, s as (select * from app_requests union all select * from app_dependencies)
select 'one' as asked, OperationId, Id, Name as Op from s where OperationId = '{ONE_TRACE}'
union all
select 'many' as asked, OperationId, Id, Name as Op from s
where OperationId in (select md5(cast(value as varchar)) from (select distinct cast(floor(value) as bigint) as value from events))""")
def trace_by_id(td):
    """The spans of one trace by id, and of a table of trace ids."""
    from pyspark.sql import functions as F

    req, deps = td["app_requests"], td["app_dependencies"]
    ids = td["events"].select(F.md5(F.floor("value").cast("bigint").cast("string")).alias("trace"))
    one, many = T.trace_timeline(req, deps, ONE_TRACE.upper()), T.trace_timeline(req, deps, ids)
    cols = ["OperationId", "Id", "Op"]
    return one.select(F.lit("one").alias("asked"), *cols).unionByName(many.select(F.lit("many").alias("asked"), *cols))


def _health_report(td):
    """The whole stats result as one JSON document (checked by tests)."""
    return T.health_report(td["app_requests"], td["app_dependencies"], td["app_exceptions"], AS_OF, SINCE)


register("health_report")(_health_report)


@register("health_report_requests", W("app_requests") + f"""
select '{SINCE}' as window, AppRoleName, Name, count(*) as Requests,
       count(*) filter (where Success = false) as Failures
from app_requests where TimeGenerated > {WINDOW_START}
group by AppRoleName, Name""")
def health_report_requests(td):
    """S14 checked by value: the requests section read back from the one-document JSON report."""
    from pyspark.sql import functions as F

    rep = _health_report(td)
    schema = ("struct<window:string, requests:array<struct<AppRoleName:string, Name:string, "
              "Requests:bigint, Failures:bigint>>>")
    doc = rep.select(F.from_json("report", schema).alias("d"))
    return doc.select(F.col("d.window").alias("window"), F.explode("d.requests").alias("r")).select(
        "window", "r.AppRoleName", "r.Name", "r.Requests", "r.Failures")


@register("telemetry_days", W("spans") + """
select 'kept' as part, Type, count(*) as n, min(TimeGenerated) as first from spans
where TimeGenerated > timestamp '2024-01-28 00:00:00' group by Type
union all
select 'expired days' as part, strftime(TimeGenerated, '%Y-%m-%d') as Type, count(*) as n, min(TimeGenerated) as first from spans
where TimeGenerated < timestamp '2024-01-08 00:00:00' group by 2""")
def telemetry_days(td):
    """Spans stored by day, a three-day window read back, and the day folders a 23-day retention drops."""
    import uuid

    from pyspark.sql import functions as F

    from docweave.session import scratch_path
    from docweave.sources import telemetry_store as TS

    root = scratch_path(td.spark, f"telemetry-{uuid.uuid4().hex}")
    TS.write_by_day(td["spans"], root)
    stats = [F.count(F.lit(1)).alias("n"), F.min("TimeGenerated").alias("first")]
    kept = TS.read_window(td.spark, root, AS_OF, "3d").groupBy("Type").agg(*stats)
    days = [d.removeprefix("day=") for d in TS.retention_days(td.spark, root, AS_OF, 23)]
    old = td.spark.read.parquet(root).filter(F.col("day").cast("string").isin(days)).groupBy(F.col("day").cast("string").alias("Type")).agg(*stats)
    return kept.select(F.lit("kept").alias("part"), "*").unionByName(old.select(F.lit("expired days").alias("part"), "*"))
