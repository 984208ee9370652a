"""Adapters from the synthetic test tables to the reference's record shapes.

The test tables (``documents``, ``events``, ``conversations`` ...) are not shaped
like the reference's corpus, state, message and telemetry records. The views
below derive those shapes. The SQL text is shared by Spark (``spark.sql`` with
DataFrame arguments) and by the DuckDB oracle (as CTEs), so both sides start
from identical inputs. Only two spellings differ between the dialects: the
SHA-256 function and table references.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed evaluation time of the fixtures (FIXTURES.md): every "ago(x)" is as_of - x.
AS_OF = "2024-01-31 00:00:00"


def _sha256(dialect: str, expr: str) -> str:
    return f"sha2({expr}, 256)" if dialect == "spark" else f"sha256({expr})"


def _ref(dialect: str, name: str) -> str:
    return "{" + name + "}" if dialect == "spark" else name


def corpus_sql(d: str) -> str:
    return f"""
select doc_id, source || ':' || cast(doc_id as string) as id,
       source || '/' || cast(doc_id as string) || '.txt' as uri, source, text
from {_ref(d, 'documents')}"""


def ingest_state_sql(d: str) -> str:
    c = _ref(d, "corpus")
    return f"""
select id as doc_id, source,
       case when doc_id % 10 = 7 then 'stale' else {_sha256(d, 'text')} end as content_hash,
       1 + doc_id % 5 as n_chunks
from {c} where doc_id % 10 < 8
union all
select source || ':' || cast(1000000 + doc_id as string) as doc_id, source,
       'gone' as content_hash, 1 + doc_id % 5 as n_chunks
from {c} where doc_id % 50 = 0"""


def messages_sql(d: str) -> str:
    return f"""
select cast(conv_id as string) || '-' || cast(turn as string) as id,
       cast(conv_id as string) as session_id, role, text as content, turn as seq,
       md5(cast(conv_id as string) || '-' || cast(cast(floor(turn / 2) as bigint) as string)) as trace_id
from {_ref(d, 'conversations')}"""


def spans_sql(d: str) -> str:
    return f"""
select event_id, event_id % 5 as pos, ts as TimeGenerated,
       md5(cast(cast(floor(event_id / 5) as bigint) as string)) as OperationId,
       case when event_id % 5 = 4 then null else 's' || cast(event_id as string) end as Id,
       case when event_id % 5 = 0 then null
            when event_id % 35 = 3 then 's-gone'
            when event_id % 105 = 2 then 's' || cast(event_id as string)
            when event_id % 5 in (1, 2) then 's' || cast(event_id - event_id % 5 as string)
            else 's' || cast(event_id - 1 as string) end as ParentId,
       case when event_id % 5 in (0, 3) then 'AppRequests'
            when event_id % 5 in (1, 2) then 'AppDependencies' else 'AppTraces' end as Type,
       case when event_id % 5 = 3 then 'gateway'
            when event_id % 5 = 1 and event_type = 'signup' then 'rag-ingestion' else 'rag-app' end as AppRoleName,
       case when event_id % 5 = 0 then case when event_type = 'view' then 'GET /models'
                                            when event_type = 'signup' then 'GET /' else 'POST /chat' end
            when event_id % 5 = 1 then case when event_type = 'signup' then 'ingest-doc' else 'retrieve' end
            when event_id % 5 = 2 then 'llm-call'
            when event_id % 5 = 3 then case when event_id % 2 = 0 then 'POST /ai/v1/chat/completions'
                                            else 'POST /ai/v1/embeddings' end end as Name,
       case when event_id % 5 = 4 then case when event_type in ('click', 'view') then 'gen_ai.content.retrieval'
                                            else 'search.index_missing' end end as Message,
       case when event_id % 97 = 0 then null when event_id % 55 = 1 then false
            else event_type <> 'error' end as Success,
       value as DurationMs,
       case when event_id % 55 = 1 then '503' when event_type <> 'error' then '200'
            when event_id % 2 = 0 then '429' else '500' end as ResultCode,
       case when event_id % 5 = 2 then case when user_id % 3 = 0 then 'model-a'
                                            when user_id % 3 = 1 then 'model-b' else 'model-c' end end as model,
       case when event_id % 5 = 2 and event_id % 13 <> 0 then cast(regexp_extract(props, '([0-9]+)', 1) as int) end as in_tok,
       case when event_id % 5 = 2 and event_id % 17 <> 0 then cast(floor(value) as int) end as out_tok,
       case when event_id % 5 = 1 and event_type = 'signup' then 'blob:' || cast(user_id as string) end as prop_doc_id
from {_ref(d, 'events')}"""


def app_exceptions_sql(d: str) -> str:
    return f"""
select ts as TimeGenerated, 'rag-app' as AppRoleName,
       'E' || cast(user_id % 15 as string) as ProblemId, event_id
from {_ref(d, 'events')} where event_type = 'error'"""


def activity_log_sql(d: str) -> str:
    return f"""
select ts as TimeGenerated, event_id,
       case when event_id % 4 = 0 then 'Policy' else 'Administrative' end as CategoryValue,
       case when user_id % 5 = 0 then 'MICROSOFT.RESOURCES/DEPLOYMENTS/WRITE'
            when user_id % 5 = 1 then 'microsoft.app/containerApps/write'
            when user_id % 5 = 2 then 'microsoft.app/jobs/start/action'
            when user_id % 5 = 3 then 'microsoft.app/containerApps/restart/action'
            else 'microsoft.storage/listKeys/action' end as OperationNameValue,
       case when event_type = 'error' then 'Failed' when event_type = 'view' then 'Accepted' else 'Succeeded' end as ActivityStatusValue,
       'user' || cast(user_id as string) as Caller
from {_ref(d, 'events')} where event_type in ('signup', 'error', 'view')"""


def blob_events_sql(d: str) -> str:
    return f"""
select event_id, ts as event_time,
       case when event_type in ('click', 'view', 'purchase') then 'Microsoft.Storage.BlobCreated'
            else 'Microsoft.Storage.BlobDeleted' end as event_type,
       '/blobServices/default/containers/' || case when user_id % 4 = 0 then 'other' else 'documents' end
         || '/blobs/' || cast(user_id as string) || '.md' as subject
from {_ref(d, 'events')}"""


def token_deltas_sql(d: str) -> str:
    return f"""
select cast(floor(event_id / 10) as bigint) as turn_id, event_id % 10 as seq,
       case when event_type = 'error' then null when event_type = 'signup' then '' else event_type || ' ' end as delta,
       case when event_id % 10 = 9 and event_id % 30 <> 9 then cast(regexp_extract(props, '([0-9]+)', 1) as int) end as prompt_tokens,
       case when event_id % 10 = 9 and event_id % 30 <> 9 then cast(floor(value) as int) end as completion_tokens
from {_ref(d, 'events')}"""


# view name -> (sql builder, names of views it reads)
VIEWS = {
    "corpus": (corpus_sql, ("documents",)),
    "ingest_state": (ingest_state_sql, ("corpus",)),
    "messages": (messages_sql, ("conversations",)),
    "spans": (spans_sql, ("events",)),
    "app_exceptions": (app_exceptions_sql, ("events",)),
    "activity_log": (activity_log_sql, ("events",)),
    "blob_events": (blob_events_sql, ("events",)),
    "token_deltas": (token_deltas_sql, ("events",)),
}

# Telemetry tables are filters of the one spans view.
SPAN_TABLES = {
    "app_requests": "AppRequests",
    "app_dependencies": "AppDependencies",
    "app_traces": "AppTraces",
}


def duckdb_with(*names: str) -> str:
    """A ``WITH`` clause defining the named fixture views (and what they read) for DuckDB."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order or n in BASE_TABLES:
            return
        if n in SPAN_TABLES:
            visit("spans")
        else:
            for dep in VIEWS[n][1]:
                visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    parts = []
    for n in order:
        if n in SPAN_TABLES:
            parts.append(f"{n} as (select * from spans where Type = '{SPAN_TABLES[n]}')")
        else:
            parts.append(f"{n} as ({VIEWS[n][0]('duckdb')})")
    return "with " + ",\n".join(parts) + "\n"


class TestData:
    """Loads the base tables of one scale-factor folder and derives the fixture views lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in BASE_TABLES:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in SPAN_TABLES:
                df = self.spans().filter(F.col("Type") == SPAN_TABLES[name])
            else:
                builder, deps = VIEWS[name]
                df = self.spark.sql(builder("spark"), **{d: self.table(d) for d in deps})
            self._cache[name] = df
        return self._cache[name]

    __getitem__ = table

    def spans(self) -> DataFrame:
        """The spans view plus the ``Properties`` bag the telemetry operators read."""
        if "_spans_props" not in self._cache:
            self._cache["_spans_props"] = with_properties(self.table("spans"))
        return self._cache["_spans_props"]


def with_properties(spans: DataFrame) -> DataFrame:
    """Add the ``Properties`` bag (absent keys left out) from the fixture's typed columns."""
    bag = F.map_filter(
        F.create_map(
            F.lit("gen_ai.request.model"), F.col("model"),
            F.lit("gen_ai.usage.input_tokens"), F.col("in_tok").cast("string"),
            F.lit("gen_ai.usage.output_tokens"), F.col("out_tok").cast("string"),
            F.lit("doc.id"), F.col("prop_doc_id"),
        ),
        lambda k, v: v.isNotNull(),
    )
    return spans.withColumn("Properties", bag)


def spans_from(events: DataFrame) -> DataFrame:
    """The spans view (with Properties) over any events frame, batch or streaming."""
    return with_properties(events.sparkSession.sql(spans_sql("spark"), events=events))
