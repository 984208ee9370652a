"""Streamed answer deltas assembled per turn with state.

A stateful processor keyed by turn: the parts seen so far are a list state that only grows by
appends, what is known of the turn (last event, newest usage chunk, timer) is a value state. A
turn is emitted once, when the watermark has passed its last event (with a usage chunk) or its
last event plus ``idle`` (without one: the stream of that turn stopped). So parts that arrive
late, in a later micro-batch than the usage chunk, still belong to the turn, and the result
equals the batch form on every closed turn. State per turn is bounded by the answer's length
and removed on emission. An event-time timer is moved only when it has to fire earlier; one
that fires before the turn is due is set again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT_SCHEMA = "turn_id long, answer string, input_tokens int, output_tokens int, timed_out boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """List state and timers need the RocksDB state store; a session that names a store of its own kind keeps it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key):
        spark.conf.set(key, ROCKSDB)
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class Turns(StatefulProcessor):
    """Parts and usage of one turn."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "seq long, delta string")
        self.known = handle.getValueState("known", "last_ms long, usage_seq long, prompt long, completion long, timer_ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, usage, timer = 0, (None, None, None), None
        known = self.known.get()
        if known is not None:
            last, *usage, timer = known
        parts = []
        for r in rows:
            if r.delta:
                parts.append((r.seq, r.delta))
            last = max(last, r.ms)
            if (r.prompt_tokens is not None or r.completion_tokens is not None) and (usage[0] is None or r.seq >= usage[0]):
                usage = (r.seq, r.prompt_tokens, r.completion_tokens)
        if parts:
            self.parts.appendList(parts)
        due = max(self._due(last, usage[0]), timerValues.getCurrentWatermarkInMs() + 1)
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.known.update((last, *usage, timer))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, usage_seq, prompt, completion, timer = self.known.get()
        due = self._due(last, usage_seq)
        if due > timer:
            self.handle.registerTimer(due)
            self.known.update((last, usage_seq, prompt, completion, due))
            return
        text = "".join(delta for _, delta in sorted(self.parts.get()))
        self.parts.clear()
        self.known.clear()
        yield Row(turn_id=key[0], answer=text, input_tokens=prompt or 0, output_tokens=completion or 0, timed_out=usage_seq is None)

    def _due(self, last_ms: int, usage_seq: int | None) -> int:
        return last_ms + (self.idle_ms if usage_seq is None else 0)


def stream_deltas(deltas: DataFrame, delay: str = "10 minutes", idle_ms: int = 30 * 60 * 1000,
                  ts: str = "ts") -> DataFrame:
    """``deltas``: streaming ``turn_id, seq, delta, prompt_tokens, completion_tokens, ts``."""
    use_rocksdb(deltas.sparkSession)
    d = deltas
    if d.schema[ts].dataType.typeName() == "timestamp_ntz":
        d = d.withColumn(ts, F.col(ts).cast("timestamp"))
    d = d.withWatermark(ts, delay).select(
        F.col("turn_id").cast("long").alias("turn_id"), F.col("seq").cast("long").alias("seq"), "delta",
        "prompt_tokens", "completion_tokens", ts, F.unix_millis(ts).alias("ms"))
    return d.groupBy("turn_id").transformWithState(Turns(idle_ms), OUT_SCHEMA, "append", "eventTime")
