"""A batch of chat turns end to end.

``questions``: ``question_id, session_id (nullable), message, model (nullable)``.
Every question is answered in the same batch: model allowlist, session default,
embedding, top-k retrieval over the index (no index: no hits, every question still
answered), history read before the turn is stored, prompt, batched model call, answer
row, and the two history rows to append. All per-question lists are bounded (k hits,
10 history messages).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import chat as C
from docweave.operators import retrieve as R
from docweave.operators.embed import EmbedFn, embed_questions
from docweave.session import staged
from docweave.sources import index_store

DEFAULT_SYSTEM_PROMPT = "Answer from the context below and name the titles of the sources you used."


@dataclass
class TurnResult:
    answers: DataFrame       # question_id, session_id, trace_id, answer, sources, sources_text, model, tokens
    history_rows: DataFrame  # rows to append to the messages table (user, then assistant)


def answer_questions(spark: SparkSession, questions: DataFrame, index_root: str, messages: DataFrame,
                     model_options: str, embed_fn: EmbedFn | None = None, chat_fn: C.ChatFn = C.stub_chat,
                     k: int = R.DEFAULT_K, system_prompt: str = DEFAULT_SYSTEM_PROMPT,
                     created_at=None) -> TurnResult:
    q = C.model_allowlist(questions, model_options, "model")
    q = q.withColumn("session_id", C.session_default("session_id", F.col("question_id")))
    q = q.withColumn("trace_id", F.md5(F.concat(F.lit("turn:"), F.col("question_id").cast("string"))))

    index = index_store.load_index(spark, index_root)
    if index is None:  # P5: no index yet, answer without retrieval
        hits = R.empty_hits(spark, questions.schema["question_id"].dataType)
    else:
        qv = staged(embed_questions(q.select("question_id", "message"), "message", "qvec", embed_fn), "question-vectors")
        hits = R.hit_projection(R.vector_topk(index, qv, k), index)
    ctx = C.hit_summary(hits)
    src = hits.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("_s")) \
        .select("question_id", F.transform("_s", lambda x: x["title"]).alias("sources"))

    asked = messages.join(q.select("session_id").distinct(), "session_id", "left_semi")  # only the sessions asked about
    last = C.history_last_n(asked.filter(F.col("role").isin(*C.STORED_ROLES)))
    hist = last.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))).alias("_h")) \
        .select("session_id", F.transform("_h", lambda x: F.struct(x["role"].alias("role"),
                                                                   x["content"].alias("content"))).alias("history"))

    p = q.join(ctx, "question_id", "left").join(src, "question_id", "left").join(hist, "session_id", "left")
    p = p.withColumn("messages", C.build_messages(system_prompt, F.col("history"), F.col("context"), F.col("message")))
    done = staged(C.complete_batch(p.drop("history"), chat_fn, "messages", "resolved_model"), "completions")
    answers = done.select(
        "question_id", "session_id", "trace_id", "answer",
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
        F.coalesce("sources_text", F.lit("none")).alias("sources_text"),
        F.col("resolved_model").alias("model"), "input_tokens", "output_tokens")
    turns = done.select(F.col("question_id").alias("turn_key"), "session_id", "trace_id", "message", "answer")
    ts = F.lit(created_at).cast("timestamp") if created_at is not None else None
    return TurnResult(answers, C.history_rows(turns, ts))
