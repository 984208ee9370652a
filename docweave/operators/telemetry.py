"""Telemetry analytics over span tables (health, tokens, failures, panels).

Every log query of the reference is a DataFrame here. ``ago(x)`` becomes an
``as_of`` argument so results are reproducible; the bound is exclusive
(``TimeGenerated > as_of - since``). All filters are plain column predicates on
``TimeGenerated``/``Name``/``Success`` so Catalyst pushes them into the scan (and
prunes date partitions when the tables are written partitioned by date).

Percentiles are exact, with linear interpolation, and found by histogram refinement
(``operators.percentiles``): no group is ever gathered or sorted. ``sketch=True`` takes ``percentile_approx`` instead (a
mergeable sketch that returns a value of the data near the rank), for dashboards that
prefer one pass over exactness.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.text import has_any, has_term, prop_int, prop_string, starts_with_ci
from docweave.operators.percentiles import group_percentiles

SINCE_RE = re.compile(r"^(\d+)([mhd])$")
TRACE_RE = re.compile(r"^[0-9a-f]{32}$")

# Workbook panel choices and defaults.
PANEL_RANGES = ("1h", "4h", "24h", "7d")
CHAT_TERM = "/chat"
READ_PATH_STAGES = ("retrieve", "llm-call")
CHANGE_FEED_TERMS = ("deployments/write", "containerApps/write", "jobs/start/action", "restart")
CHANGE_FEED_STATUSES = ("Success", "Succeeded", "Accepted", "Started")


# --- time and identity filters (P7, P8, P12) -------------------------------------------

def parse_since(since: str) -> timedelta:
    m = SINCE_RE.match(since or "")
    if not m:
        raise ValueError(f"not a time span (a number and m, h or d): {since!r}")
    n, unit = int(m.group(1)), m.group(2)
    return {"m": timedelta(minutes=n), "h": timedelta(hours=n), "d": timedelta(days=n)}[unit]


def _ts_literal(df: DataFrame, value: datetime, col: str = "TimeGenerated") -> Column:
    """A literal cast to the column's own timestamp type so the predicate pushes down."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(df.schema[col].dataType)


def time_range(df: DataFrame, as_of: str | datetime, since: str, col: str = "TimeGenerated") -> DataFrame:
    """``where TimeGenerated > ago(since)`` evaluated at ``as_of``."""
    start = _as_datetime(as_of) - parse_since(since)
    return df.filter(F.col(col) > _ts_literal(df, start, col))


def retention(df: DataFrame, as_of: str | datetime, days: int = 30, col: str = "TimeGenerated") -> DataFrame:
    """Rows kept by a ``days``-day retention at ``as_of``."""
    start = _as_datetime(as_of) - timedelta(days=days)
    return df.filter(F.col(col) >= _ts_literal(df, start, col))


def _as_datetime(v: str | datetime) -> datetime:
    return v if isinstance(v, datetime) else datetime.fromisoformat(str(v))


def check_trace_id(trace_id: str) -> str:
    tid = trace_id.strip().lower()
    if not TRACE_RE.match(tid):
        raise ValueError(f"not a trace id (32 hex digits): {trace_id!r}")
    return tid


def trace_filter(df: DataFrame, trace_ids: str | DataFrame) -> DataFrame:
    """One trace by equality (pushed to the scan), or many by a semi join with a trace-id table."""
    if isinstance(trace_ids, DataFrame):
        ids = trace_ids.select(F.col(trace_ids.columns[0]).alias("OperationId")).distinct()
        return df.join(ids, "OperationId", "left_semi")
    return df.filter(F.col("OperationId") == check_trace_id(trace_ids))


def term_filter(df: DataFrame, terms: str | list[str], col: str = "Name") -> DataFrame:
    """``Name has t`` or ``Name has_any (...)``."""
    return df.filter(has_term(col, terms) if isinstance(terms, str) else has_any(col, terms))


def name_in(df: DataFrame, names: list[str] | tuple[str, ...], col: str = "Name") -> DataFrame:
    return df.filter(F.col(col).isin(list(names)))


def failed(df: DataFrame) -> DataFrame:
    """``Success == false``: null Success is not a failure."""
    return df.filter(F.col("Success") == F.lit(False))


# --- aggregates helpers --------------------------------------------------------------

def failures() -> Column:
    return F.count_if(F.col("Success") == F.lit(False))


# --- stats mode (A1-A5, K1) -----------------------------------------------------------

def _ones() -> dict[str, Column]:
    return {"Requests": F.lit(1), "Failures": F.when(F.col("Success") == F.lit(False), 1).otherwise(0)}


def health_requests(requests: DataFrame, as_of, since: str = "1h", sketch: bool = False) -> DataFrame:
    """Server spans per role and name: count, failures, p50/p95/avg ms, error rate (A1)."""
    keys, ms = ["AppRoleName", "Name"], F.col("DurationMs").cast("double")
    sums = _ones() | {"_ms": ms, "_timed": ms.isNotNull().cast("long")}
    agg = group_percentiles(time_range(requests, as_of, since), keys, "DurationMs", {"P50": 0.5, "P95": 0.95}, sketch, sums)
    return agg.select(*keys, "Requests", "Failures", F.round("P50", 0).alias("P50"), F.round("P95", 0).alias("P95"),
                      F.round(F.col("_ms") / F.nullif("_timed", F.lit(0)), 0).alias("AvgMs"),
                      F.round(F.lit(100.0) * F.col("Failures") / F.col("Requests"), 1).alias("ErrorRatePct")) \
        .orderBy(F.desc("Requests"), "AppRoleName", "Name")


def request_counts(requests: DataFrame, as_of, since: str = "1h") -> DataFrame:
    """Requests and failures per role and name: the counts of A1 without its percentiles."""
    return time_range(requests, as_of, since).groupBy("AppRoleName", "Name").agg(
        F.count(F.lit(1)).alias("Requests"), failures().alias("Failures"))


def health_dependencies(deps: DataFrame, as_of, since: str = "1h", sketch: bool = False) -> DataFrame:
    """Client spans per role and name: calls, failures, p50/p95 (A2)."""
    keys = ["AppRoleName", "Name"]
    agg = group_percentiles(time_range(deps, as_of, since), keys, "DurationMs", {"P50": 0.5, "P95": 0.95}, sketch, _ones())
    return agg.select(*keys, F.col("Requests").alias("Calls"), "Failures", F.round("P50", 0).alias("P50"), F.round("P95", 0).alias("P95")) \
        .orderBy(F.desc("Calls"), "AppRoleName", "Name")


def with_token_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "inTok": prop_int("Properties", "gen_ai.usage.input_tokens"),
        "outTok": prop_int("Properties", "gen_ai.usage.output_tokens"),
        "model": prop_string("Properties", "gen_ai.request.model"),
    })


def token_usage(deps: DataFrame, as_of, since: str = "1h") -> DataFrame:
    """Calls and token sums per model where either count is present (A3); sums skip nulls."""
    t = with_token_columns(time_range(deps, as_of, since)) \
        .filter(F.col("inTok").isNotNull() | F.col("outTok").isNotNull())
    return t.groupBy(F.col("model").alias("Model")).agg(
        F.count(F.lit(1)).alias("Calls"),
        F.sum("inTok").alias("InTokens"),
        F.sum("outTok").alias("OutTokens"),
    ).orderBy(F.desc("Calls"), "Model")


def exceptions_top(exceptions: DataFrame, as_of, since: str = "1h", top: int = 10) -> DataFrame:
    """Most frequent problems per role, top ``top`` (A4). Ties broken by the group key."""
    return time_range(exceptions, as_of, since).groupBy("ProblemId", "AppRoleName") \
        .agg(F.count(F.lit(1)).alias("Count")) \
        .orderBy(F.desc("Count"), "ProblemId", "AppRoleName").limit(top)


def health_totals(requests_summary: DataFrame) -> DataFrame:
    """Grand total requests, failures and rate over the rows of A1 or ``request_counts``; ``n/a`` when no requests (A5)."""
    tot = requests_summary.agg(
        F.coalesce(F.sum(F.coalesce("Requests", F.lit(0))), F.lit(0)).cast("bigint").alias("total"),
        F.coalesce(F.sum(F.coalesce("Failures", F.lit(0))), F.lit(0)).cast("bigint").alias("failed"),
    )
    rate = F.when(F.col("total") > 0, F.round(F.lit(100.0) * F.col("failed") / F.col("total"), 1))
    return tot.withColumn("rate_pct", rate).withColumn(
        "rate", F.when(F.col("total") > 0, F.concat(F.format_number(F.col("rate_pct"), 1), F.lit("%")))
        .otherwise(F.lit("n/a")))


def union_spans(requests: DataFrame, deps: DataFrame) -> DataFrame:
    """Requests and dependencies, each tagged with its kind."""
    return requests.withColumn("K", F.lit("request")).unionByName(
        deps.withColumn("K", F.lit("dependency")), allowMissingColumns=True)


def recent_failures(requests: DataFrame, deps: DataFrame, as_of, since: str = "1h", limit: int = 20) -> DataFrame:
    """Newest failures over requests and dependencies (K1)."""
    u = failed(time_range(union_spans(requests, deps), as_of, since))
    return u.select("TimeGenerated", "K", "AppRoleName", F.col("Name").alias("Op"), "ResultCode",
                    F.col("OperationId").alias("TraceId"), "Id") \
        .orderBy(F.desc("TimeGenerated"), "Id").limit(limit).drop("Id")


# --- overview queries (P11, A6) -----------------------------------------------------------

def recent_requests(requests: DataFrame, as_of, since: str = "1h", limit: int = 50,
                    failures_only: bool = False) -> DataFrame:
    r = time_range(requests, as_of, since)
    if failures_only:
        r = failed(r)
    return r.select("TimeGenerated", "AppRoleName", "Name", "Success", "DurationMs", "ResultCode",
                    "OperationId", "Id").orderBy(F.desc("TimeGenerated"), "Id").limit(limit).drop("Id")


def latency_profile(requests: DataFrame, as_of, since: str = "1h", sketch: bool = False) -> DataFrame:
    """count, avg and p95 by Name, AppRoleName."""
    keys, ms = ["Name", "AppRoleName"], F.col("DurationMs").cast("double")
    sums = {"count_": F.lit(1), "_ms": ms, "_timed": ms.isNotNull().cast("long")}
    return group_percentiles(time_range(requests, as_of, since), keys, "DurationMs", {"p95": 0.95}, sketch, sums).select(
        *keys, "count_", (F.col("_ms") / F.nullif("_timed", F.lit(0))).alias("avg_DurationMs"), "p95")


# --- workbook panels (A7-A11, K2-K4) -------------------------------------------------------

def stage_latency(deps: DataFrame, sketch: bool = False) -> DataFrame:
    """p50/p95 of the read-path stages."""
    return group_percentiles(name_in(deps, READ_PATH_STAGES), ["Name"], "DurationMs", {"p50": 0.5, "p95": 0.95}, sketch)


def request_volume(requests: DataFrame, term: str = CHAT_TERM, width: str = "5 minutes") -> DataFrame:
    """Requests and failures per time bin for names matching ``term`` (A8). Empty bins are absent."""
    return term_filter(requests, term).groupBy(F.window("TimeGenerated", width).start.alias("TimeGenerated")).agg(
        F.count(F.lit(1)).alias("Requests"), failures().alias("Failures")).orderBy("TimeGenerated")


def tokens_over_time(deps: DataFrame, width: str = "15 minutes") -> DataFrame:
    """``sum(inTok + outTok)`` per bin and model for llm-call (A9): a row with one null adds nothing."""
    t = with_token_columns(deps.filter(F.col("Name") == "llm-call"))
    return t.groupBy(F.window("TimeGenerated", width).start.alias("TimeGenerated"), "model") \
        .agg(F.sum(F.col("inTok") + F.col("outTok")).alias("Tokens")).orderBy("TimeGenerated", "model")


def gateway_codes(requests: DataFrame, terms: tuple[str, ...] = ("chat", "embeddings")) -> DataFrame:
    """Result codes per role for chat/embeddings operations (A10)."""
    return term_filter(requests, list(terms)).groupBy("ResultCode", "AppRoleName") \
        .agg(F.count(F.lit(1)).alias("Count")).orderBy(F.desc("Count"), "ResultCode", "AppRoleName")


def failed_read_path(deps: DataFrame, limit: int = 100) -> DataFrame:
    """Newest failed retrieve/llm-call spans (K2)."""
    return failed(name_in(deps, READ_PATH_STAGES)) \
        .select("TimeGenerated", "Name", "ResultCode", "DurationMs", "OperationId", "Id") \
        .orderBy(F.desc("TimeGenerated"), "Id").limit(limit).drop("Id")


def ingest_throughput(deps: DataFrame, width: str = "1 hour") -> DataFrame:
    """Ingested and failed documents per bin."""
    return deps.filter(F.col("Name") == "ingest-doc") \
        .groupBy(F.window("TimeGenerated", width).start.alias("TimeGenerated")).agg(
            F.count_if(F.col("Success") == F.lit(True)).alias("Ingested"),
            failures().alias("Failed")).orderBy("TimeGenerated")


def ingest_failures(deps: DataFrame, limit: int = 100) -> DataFrame:
    """Newest failed ingest-doc spans with the document id property (K3)."""
    return failed(deps.filter(F.col("Name") == "ingest-doc")) \
        .select("TimeGenerated", prop_string("Properties", "doc.id").alias("docId"), "ResultCode",
                "OperationId", "Id") \
        .orderBy(F.desc("TimeGenerated"), "Id").limit(limit).drop("Id")


def change_feed(activity: DataFrame, limit: int = 100, key: str = "event_id") -> DataFrame:
    """Administrative deploy/start/restart activity, newest first (K4)."""
    a = activity.filter(F.col("CategoryValue") == "Administrative")
    a = term_filter(a, list(CHANGE_FEED_TERMS), "OperationNameValue")
    a = a.filter(F.col("ActivityStatusValue").isin(list(CHANGE_FEED_STATUSES)))
    cols = ["TimeGenerated", "OperationNameValue", "ActivityStatusValue", "Caller"]
    cols += [c for c in ("ResourceGroup", "_ResourceId") if c in activity.columns]
    order = [F.desc("TimeGenerated")] + ([key] if key in activity.columns else [])
    return a.select(*cols, *([key] if key in activity.columns else [])).orderBy(*order).limit(limit) \
        .drop(*([key] if key in activity.columns else []))


# --- trace mode (U2, K5, R2, R3) -----------------------------------------------------------

def _by_trace(df: DataFrame, *order: str) -> DataFrame:
    """The rows of a trace together and in order; traces are in no order among themselves (no sort of the whole table)."""
    return df.repartition("OperationId").sortWithinPartitions("OperationId", *order)


def union_telemetry(requests: DataFrame, deps: DataFrame, traces: DataFrame) -> DataFrame:
    """Requests, dependencies and logs under one shape: ``Op = coalesce(Name, Message)``, ``Kind = Type``."""
    u = requests.unionByName(deps, allowMissingColumns=True).unionByName(traces, allowMissingColumns=True)
    return u.select("OperationId", "TimeGenerated", F.col("Type").alias("Kind"), "AppRoleName",
                    F.coalesce("Name", "Message").alias("Op"), "Success", "DurationMs", "ResultCode",
                    "Id", "ParentId")


def trace_timeline(requests: DataFrame, deps: DataFrame, trace_ids: str | DataFrame | None = None) -> DataFrame:
    """Spans of one trace (or of every trace) in time order (K5)."""
    u = requests.unionByName(deps, allowMissingColumns=True)
    if trace_ids is not None:
        u = trace_filter(u, trace_ids)
    return u.select("OperationId", "TimeGenerated", F.col("Type").alias("Kind"), "AppRoleName",
                    F.col("Name").alias("Op"), "Success", "DurationMs", "ResultCode", "Id", "ParentId") \
        .transform(_by_trace, "TimeGenerated", "Id")


def trace_logs(rows: DataFrame) -> DataFrame:
    """Rows without a span id (logs), listed apart in time order (R2)."""
    return rows.filter(F.col("Id").isNull() | (F.col("Id") == "")) \
        .select("OperationId", "TimeGenerated", "AppRoleName", "Op") \
        .transform(_by_trace, "TimeGenerated")


def trace_content(traces: DataFrame, trace_ids: str | DataFrame | None = None) -> DataFrame:
    """``gen_ai.content*`` events and their payload."""
    t = traces if trace_ids is None else trace_filter(traces, trace_ids)
    t = t.filter(starts_with_ci("Message", "gen_ai.content"))
    return t.select("OperationId", "TimeGenerated", F.col("Message").alias("Kind"),
                    prop_string("Properties", "content").alias("content")) \
        .transform(_by_trace, "TimeGenerated")


# --- whole stats result as one JSON document (S14) ---------------------------------------

def _json_array(df: DataFrame, order: list[tuple[str, bool]], name: str) -> DataFrame:
    """One row ``(part, json)``: a small, already aggregated frame as a JSON array text.

    Rows are ordered by sorting the collected list on ``order`` keys (``(column, desc)``;
    numeric and timestamp keys are negated for descending), so no single-partition window
    is needed.
    """
    def key(c: str, desc: bool) -> Column:
        col = F.col(c)
        if not desc:
            return col
        if isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType)):
            return -F.unix_micros(col.cast("timestamp"))
        return -col

    item = F.struct(*[key(c, d).alias(f"_k{i}") for i, (c, d) in enumerate(order)],
                    F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("j"))
    arr = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["j"])
    return df.agg(F.concat(F.lit("["), F.array_join(arr, ","), F.lit("]")).alias("json")) \
        .select(F.lit(name).alias("part"), "json")


def health_report(requests: DataFrame, deps: DataFrame, exceptions: DataFrame, as_of,
                  since: str = "1h", limit: int = 20) -> DataFrame:
    """One row, one JSON column: window, requests, dependencies, tokens, exceptions, recent failures.

    Every part is already an aggregate or a top-n, so each collected list is bounded;
    parts are stacked by ``union`` and folded by one global aggregate (no join).
    """
    parts = [
        ("requests", health_requests(requests, as_of, since),
         [("Requests", True), ("AppRoleName", False), ("Name", False)]),
        ("dependencies", health_dependencies(deps, as_of, since),
         [("Calls", True), ("AppRoleName", False), ("Name", False)]),
        ("tokens", token_usage(deps, as_of, since), [("Calls", True), ("Model", False)]),
        ("exceptions", exceptions_top(exceptions, as_of, since),
         [("Count", True), ("ProblemId", False), ("AppRoleName", False)]),
        ("recent_failures", recent_failures(requests, deps, as_of, since, limit),
         [("TimeGenerated", True), ("TraceId", False), ("Op", False)]),
    ]
    stacked = None
    for name, df, order in parts:
        j = _json_array(df, order, name)
        stacked = j if stacked is None else stacked.unionByName(j)
    folded = stacked.agg(*[F.max(F.when(F.col("part") == n, F.col("json"))).alias(n) for n, _, _ in parts])
    body = [F.concat(F.lit('{"window":"'), F.lit(since), F.lit('"'))]
    for n, _, _ in parts:
        body.append(F.concat(F.lit(f',"{n}":'), F.coalesce(F.col(n), F.lit("[]"))))
    body.append(F.lit("}"))
    return folded.select(F.concat(*body).alias("report"))
