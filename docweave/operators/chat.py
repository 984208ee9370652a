"""Chat tables: history, prompts, completions, answers.

One chat turn of the reference becomes one row of a *questions* table; every
operator here works on all questions at once. History windows use bounded ROWS
frames or ``row_number() <= n`` (planned as a partial ``WindowGroupLimit`` before
the shuffle), so per-session lists never exceed ``n`` elements.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.text import distinct_options
from docweave.session import staged

HISTORY_DEPTH = 10  # fixed value: messages of history per turn
STORED_ROLES = ("user", "assistant")

MESSAGE_TYPE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])


# --- history (H1) -----------------------------------------------------------------------------

def history_last_n(messages: DataFrame, n: int = HISTORY_DEPTH, order_col: str = "created_at",
                   id_col: str = "id", session_col: str = "session_id") -> DataFrame:
    """Newest ``n`` messages of every session, returned oldest first: ``session_id, pos, role, content``."""
    w = Window.partitionBy(session_col).orderBy(F.desc(order_col), F.desc(id_col))
    last = messages.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    cnt = Window.partitionBy(session_col)
    return last.select(session_col, (F.count(F.lit(1)).over(cnt) - F.col("_rn")).cast("int").alias("pos"),
                       "role", "content")


def history_window(messages: DataFrame, n: int = HISTORY_DEPTH, order_col: str = "seq",
                   id_col: str = "id", session_col: str = "session_id") -> DataFrame:
    """Each stored message with the ``n`` stored messages before it: ``history`` oldest first.

    Evaluated on a user row, this is the history as it was before that turn was saved.
    Messages are range-partitioned by session, order and id, whatever the order's type and
    spacing, so a session with a third of all rows lies in many tasks. Each part gets the
    last ``n`` rows that precede it in its session (from at most ``n`` earlier parts), and
    the bounded ROWS frame runs within the part. Lists hold ``n`` entries at most, and one
    session's summary has a row for each part it lies in.
    """
    stored = messages.filter(F.col("role").isin(*STORED_ROLES))
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored.repartitionByRange(parts, session_col, order_col, id_col).withColumn("_b", F.spark_partition_id())
    rows = staged(ranged, "history-rows").withColumn("_carry", F.lit(False))
    item = F.struct(F.col(order_col).alias("o"), F.col(id_col).alias("i"), "role", "content")

    # last n rows of every (session, part): a row_number limit, planned with a partial limit
    w_last = Window.partitionBy(session_col, "_b").orderBy(F.desc(order_col), F.desc(id_col))
    last = rows.withColumn("_r", F.row_number().over(w_last)).filter(F.col("_r") <= n)
    summ = last.groupBy(session_col, "_b").agg(F.collect_list(item).alias("_items"))
    # the rows that precede part b: the newest n among the n previous parts of the session
    w_prev = Window.partitionBy(session_col).orderBy("_b").rowsBetween(-n, -1)
    summ = summ.withColumn("_prev", F.flatten(F.collect_list("_items").over(w_prev)))
    newest = F.slice(F.reverse(F.array_sort("_prev")), 1, n)
    carry = summ.select(session_col, "_b", F.explode(newest).alias("_c")).select(
        session_col, "_b", F.col("_c.o").alias(order_col), F.col("_c.i").alias(id_col),
        F.col("_c.role").alias("role"), F.col("_c.content").alias("content"), F.lit(True).alias("_carry"))

    both = rows.unionByName(carry, allowMissingColumns=True)
    w = Window.partitionBy(session_col, "_b").orderBy(order_col, id_col).rowsBetween(-n, -1)
    return both.withColumn("history", F.collect_list(F.struct("role", "content")).over(w)) \
        .filter(~F.col("_carry")).drop("_b", "_carry")


# --- prompt pieces (F7, F8, A16) ---------------------------------------------------------------

def hit_summary(hits: DataFrame, qid: str = "question_id") -> DataFrame:
    """Context block (F7) and sources line (A16) of every question in one aggregation."""
    item = F.struct("rank", "title", "content")
    g = hits.groupBy(qid).agg(F.array_sort(F.collect_list(item)).alias("_h"))
    return g.select(
        qid,
        F.array_join(F.transform("_h", lambda x: F.concat(F.lit("["), x["title"], F.lit("]\n"), x["content"])),
                     "\n\n").alias("context"),
        F.when(F.size("_h") > 0, F.array_join(F.transform("_h", lambda x: x["title"]), ", "))
        .otherwise(F.lit("none")).alias("sources_text"))


def user_turn_text(context: Column, message: Column) -> Column:
    return F.concat(F.lit("Context:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), message)


def build_messages(system_prompt: str, history: Column, context: Column, message: Column) -> Column:
    """System, then history, then the user turn with context (F8)."""
    sys_msg = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")))
    user = F.array(F.struct(F.lit("user").alias("role"), user_turn_text(context, message).alias("content")))
    hist = F.coalesce(history, F.array().cast(T.ArrayType(MESSAGE_TYPE)))
    return F.concat(sys_msg, hist.cast(T.ArrayType(MESSAGE_TYPE)), user)


# --- sessions and models (F11, J7, U4) ---------------------------------------------------------

def session_default(session_id: Column | str, key: Column | None = None) -> Column:
    """Empty or missing session id -> a new id; deterministic when ``key`` is given."""
    s = F.col(session_id) if isinstance(session_id, str) else session_id
    fresh = F.expr("uuid()") if key is None else F.sha2(key.cast("string"), 256).substr(1, 32)
    return F.coalesce(F.nullif(s, F.lit("")), fresh)


def model_allowlist(requests: DataFrame, options_csv: str, requested: str = "model") -> DataFrame:
    """Keep the requested model if allowed, else the default = first option.

    The options are a constant column expression, folded once by the optimizer.
    """
    if not options_csv or not options_csv.replace(",", " ").strip():
        raise ValueError("the list of chat models is empty")
    options = distinct_options(F.lit(options_csv))
    return requests.withColumn("resolved_model", F.when(F.array_contains(options, F.col(requested)), F.col(requested))
                               .otherwise(F.element_at(options, 1)))


# --- completions (R6) and answers (R7) -------------------------------------------------------

COMPLETION_FIELDS = [T.StructField("answer", T.StringType()), T.StructField("input_tokens", T.IntegerType()),
                     T.StructField("output_tokens", T.IntegerType())]

ChatFn = Callable[[list[list[dict]], list[str]], list[tuple[str, int, int]]]


_RUN = re.compile(r"[^ \t\n\r\f\x0b]+")


def stub_chat(prompts: list[list[dict]], models: list[str]) -> list[tuple[str, int, int]]:
    """Offline default model: cites the first context block, counts white-space-free runs as tokens."""
    def n_tokens(text):
        return len(_RUN.findall(text or ""))

    out = []
    for msgs in prompts:
        context = (msgs[-1]["content"] if msgs else "").split("\n\nQuestion: ")[0]
        lead = "Context:\n["
        title = context[len(lead):].split("]", 1)[0] if context.startswith(lead) else ""
        answer = f"See {title}." if title else "I could not find this in the documents."
        out.append((answer, sum(n_tokens(m.get("content")) for m in msgs), n_tokens(answer)))
    return out


def complete_batch(prompts: DataFrame, chat_fn: ChatFn = stub_chat, messages_col: str = "messages",
                   model_col: str = "model", batch_size: int = 16) -> DataFrame:
    """One model call per prompt via ``mapInPandas``; adds answer and token counts."""
    schema = T.StructType(prompts.schema.fields + COMPLETION_FIELDS)

    def run(batches):
        for pdf in batches:
            msgs = [[{"role": m["role"], "content": m["content"]} for m in row] for row in pdf[messages_col]]
            models = pdf[model_col].tolist() if model_col in pdf else [None] * len(pdf)
            res: list = []
            for s in range(0, len(msgs), batch_size):
                res.extend(chat_fn(msgs[s:s + batch_size], models[s:s + batch_size]))
            out = pdf.copy()
            out["answer"] = [r[0] for r in res]
            out["input_tokens"] = pd.array([r[1] for r in res], dtype="Int32")
            out["output_tokens"] = pd.array([r[2] for r in res], dtype="Int32")
            yield out

    return prompts.mapInPandas(run, schema)


# --- streamed deltas (A15) -------------------------------------------------------------------

def assemble_deltas(deltas: DataFrame, turn: str = "turn_id", seq: str = "seq") -> DataFrame:
    """Answer text from non-empty deltas in arrival order; tokens from the last usage chunk, else 0."""
    part = F.when(F.col("delta").isNotNull() & (F.col("delta") != ""), F.struct(seq, "delta"))
    usage_at = F.when(F.col("prompt_tokens").isNotNull() | F.col("completion_tokens").isNotNull(), F.col(seq))
    g = deltas.groupBy(turn).agg(
        F.array_sort(F.collect_list(part)).alias("_parts"),
        F.max_by(F.struct("prompt_tokens", "completion_tokens"), usage_at).alias("_usage"),
        F.max(usage_at).alias("_has"))
    usage = F.when(F.col("_has").isNotNull(), F.col("_usage"))
    return g.select(turn, F.array_join(F.transform("_parts", lambda x: x["delta"]), "").alias("answer"),
                    F.coalesce(usage["prompt_tokens"], F.lit(0)).alias("input_tokens"),
                    F.coalesce(usage["completion_tokens"], F.lit(0)).alias("output_tokens"))


# --- persistence (S12) -------------------------------------------------------------------------

def history_rows(turns: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Two stored rows per finished turn, user then assistant.

    ``turns``: ``turn_key, session_id, message, answer, trace_id``. Ids are derived from
    the turn key so a replayed batch writes the same rows.
    """
    ts = created_at if created_at is not None else F.current_timestamp()
    pair = F.array(
        F.struct(F.lit(0).alias("k"), F.lit("user").alias("role"), F.col("message").alias("content")),
        F.struct(F.lit(1).alias("k"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    x = turns.select("turn_key", "session_id", "trace_id", F.inline(pair))
    return x.select(
        F.sha2(F.concat_ws("/", F.col("turn_key").cast("string"), F.col("k").cast("string")), 256)
        .substr(1, 32).alias("id"),
        "session_id", "role", "content", "trace_id", ts.alias("created_at"), F.col("k").alias("order_in_turn"))
