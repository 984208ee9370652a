"""Redaction of personal data.

* ``deidentify``: a chain of ``regexp_replace`` (JVM, codegen) with per-kind counts.
* ``redact_text``: the regex chain over the whole text, or a scrubber callable that
  gets 5,000-character pieces, 5 per call, inside ``mapInPandas``; pieces are joined
  back in order. Any piece that fails (exception, missing result) withholds the
  **whole** field (fail closed); an exception never fails the task, so a retry can
  never emit raw text.
* ``scrub_events``: span events whose ``scrub_keys`` marker names top-level string
  keys of the JSON ``content`` attribute; those values are redacted, everything else
  passes through, and the marker attribute is dropped. A projection: payloads are opened
  as maps of variants, values replaced by column expressions, and only a scrubber callable
  needs Python, one Arrow stage over the marked values alone. No shuffle, and no event can
  get lost between parts.

Every pattern is linear in the text: an address has a local part of at most 64 characters
and 127 labels at most (the standards' own limits), so of a longer run of letters before an
``@`` the last 64 are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.session import spread

# Fixed values of the redaction contract.
CONTENT_EVENT_PREFIX = "gen_ai.content"
SCRUB_KEYS_ATTR = "scrub_keys"
WITHHELD = "[content withheld: PII redaction unavailable]"
PIECE_CHARS = 5_000
PIECES_PER_CALL = 5

# Our regex scrubber: kind, pattern, replacement; applied in this order. Patterns use
# only constructs shared by Java regex and RE2 (no look-around, no word boundaries).
PII_PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+){1,126}", "[EMAIL]"),
    ("secret", r"(?i)(api[_-]?key|secret|token|password) *[=:] *\"[^\"]*\"", "[SECRET]"),
    ("phone", r"\+[0-9]{1,3} ?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}", "[PHONE]"),
    ("card", r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", "[CARD]"),
    ("ip", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[IP]"),
]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def deidentify(text: Column | str) -> tuple[Column, dict[str, Column]]:
    """Redacted text and a count per kind (counted on the text as left by earlier kinds)."""
    cur = _c(text)
    counts = {}
    for kind, pat, rep in PII_PATTERNS:
        counts[kind] = F.coalesce(F.regexp_count(cur, F.lit(pat)), F.lit(0))
        cur = F.regexp_replace(cur, F.lit(pat), F.lit(rep))
    return cur, counts


def deidentify_corpus(corpus: DataFrame, text_col: str = "text", out_col: str = "text") -> DataFrame:
    """De-identified text plus ``n_<kind>`` replacement counts per document."""
    red, counts = deidentify(text_col)
    cols = {f"n_{k}": v.cast("int") for k, v in counts.items()}
    return spread(corpus).withColumns(cols).withColumn(out_col, red)


def regex_scrubber(texts: list[str]) -> list[str]:
    """Default scrubber callable: the same patterns, applied in Python per piece."""
    import re

    compiled = [(re.compile(p), r) for _, p, r in PII_PATTERNS]
    out = []
    for t in texts:
        for rx, rep in compiled:
            t = rx.sub(rep.replace("\\", "\\\\"), t)
        out.append(t)
    return out


Scrubber = Callable[[list[str]], list[str | None] | None]


# --- pieces and fail-closed joins (X3, X4) ------------------------------------------------------

def text_pieces(df: DataFrame, key: str, text_col: str, size: int = PIECE_CHARS) -> DataFrame:
    """``key, piece_no, piece``: the text cut every ``size`` characters (at least one, possibly empty)."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text_col) / F.lit(size)).cast("int"))
    return spread(df).select(key, F.posexplode(F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.coalesce(F.col(text_col), F.lit("")),
                                                           i * size + 1, size))).alias("piece_no", "piece"))


def _answers(scrubber: Scrubber, texts: list[str]) -> list[str | None]:
    """One call; any failure yields null for all its texts and never fails the task."""
    try:
        got = scrubber(texts)
    except Exception:  # noqa: BLE001 - fail closed
        got = None
    return got if got is not None and len(got) == len(texts) else [None] * len(texts)


def scrub_pieces(pieces: DataFrame, key: str, scrubber: Scrubber, per_call: int = PIECES_PER_CALL) -> DataFrame:
    """Run the scrubber over consecutive pieces of the same text, ``per_call`` at a time.

    A failed call yields null for each of its pieces; the caller withholds the whole text.
    """
    schema = T.StructType([pieces.schema[key], T.StructField("piece_no", T.IntegerType()),
                           T.StructField("redacted", T.StringType())])

    def run(batches):
        for pdf in batches:
            # pieces of one text stay adjacent in a partition: explode keeps them together
            call = pd.DataFrame({"k": pdf[key].ne(pdf[key].shift()), "c": (pdf["piece_no"] % per_call).eq(0)}).any(axis=1).cumsum()
            got = [a for _, texts in pdf["piece"].groupby(call, sort=False) for a in _answers(scrubber, texts.tolist())]
            yield pd.DataFrame({key: pdf[key], "piece_no": pdf["piece_no"], "redacted": pd.Series(got, index=pdf.index, dtype=object)})

    return pieces.mapInPandas(run, schema)


def scrub_lists(df: DataFrame, col: str, scrubber: Scrubber, size: int = PIECE_CHARS, per_call: int = PIECES_PER_CALL) -> DataFrame:
    """``df`` with the texts of its list column ``col`` scrubbed in pieces (X3); a text with a failed piece is withheld.
    Null texts stay null.

    One Arrow stage, no shuffle: the texts of a batch are cut as a column, a call takes
    consecutive pieces of one text.
    """
    names = df.columns
    at = names.index(col)

    def run(batches):
        for batch in batches:
            lists = batch.column(at)
            texts = lists.flatten()
            valid = texts.is_valid().to_numpy(zero_copy_only=False)
            lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
            pieces = [pc.utf8_slice_codeunits(texts, n * size, (n + 1) * size) for n in range(-(-max([1, *lengths]) // size))]
            done = []
            for i, length in enumerate(lengths):
                if not valid[i]:
                    done.append(None)
                    continue
                mine = [p[i].as_py() for p in pieces[:max(1, -(-int(length) // size))]]
                answers = [a for n in range(0, len(mine), per_call) for a in _answers(scrubber, mine[n:n + per_call])]
                done.append(WITHHELD if None in answers else "".join(answers))
            offsets = pa.array(np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))), pa.int32())
            columns = list(batch.columns)
            columns[at] = pa.ListArray.from_arrays(offsets, pa.array(done, pa.string())).cast(lists.type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, df.schema)


def join_pieces(scrubbed: DataFrame, key: str, out_col: str = "redacted") -> DataFrame:
    """Ordered join of the pieces; any missing piece withholds the whole field."""
    g = scrubbed.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("piece_no", "redacted"))).alias("_p"),
        F.max(F.col("redacted").isNull().cast("int")).alias("_bad"))
    return g.select(key, F.when(F.col("_bad") == 1, F.lit(WITHHELD))
                    .otherwise(F.array_join(F.transform("_p", lambda x: x["redacted"]), "")).alias(out_col))


def redact_text(df: DataFrame, key: str, text_col: str, scrubber: Scrubber | None = None,
                out_col: str = "redacted") -> DataFrame:
    """X3 + X4 for a text column; returns ``key, out_col``.

    ``scrubber=None`` applies the regex chain to the whole text as JVM expressions (no
    service limit, so nothing is cut and no entity can hide at a cut; null: empty); a
    callable (e.g. an NER service client) runs per Arrow batch, 5 pieces per call, and any
    failed piece withholds the whole text.
    """
    if scrubber is None:
        red, _ = deidentify(F.coalesce(F.col(text_col), F.lit("")))
        return spread(df).select(key, red.alias(out_col))
    return join_pieces(scrub_pieces(text_pieces(df, key, text_col), key, scrubber), key, out_col)


# --- span events (X1, X2, X5, F10) ---------------------------------------------------------------

def marked_events(events: DataFrame) -> Column:
    """Events whose payload must be scrubbed (X1): a content event with a marker and a payload. Never null."""
    keys = F.element_at("attributes", F.lit(SCRUB_KEYS_ATTR))
    return F.coalesce(F.col("name").startswith(CONTENT_EVENT_PREFIX) & keys.isNotNull() & (keys != "")
                      & F.map_contains_key("attributes", F.lit("content")), F.lit(False))


def _opened(src: DataFrame) -> DataFrame:
    """``_data``: the payload as a map of variants, ``_keys``: the marked names, both null where they can't be read."""
    marker, content = (F.when(F.col("_marked"), F.element_at("attributes", F.lit(k))) for k in (SCRUB_KEYS_ATTR, "content"))
    names = F.from_json(marker, "array<variant>")
    src = src.withColumns({"_data": F.from_json(content, "map<string,variant>"), "_keys": F.transform(
        F.filter(names, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: x.cast("string"))})
    once = F.size(F.array_distinct(F.map_keys("_data"))) == F.size(F.map_keys("_data"))
    return src.withColumn("_data", F.when(once, F.col("_data")))


def _marked_text(key: Column, value: Column) -> Column:
    return F.array_contains("_keys", key) & (F.schema_of_variant(value) == "STRING")


def scrub_events(events: DataFrame, scrubber: Scrubber | None = None, strict: bool = True) -> DataFrame:
    """Redact marked events (X1-X5). ``events`` carry at least ``name`` and ``attributes``; all columns pass through.

    ``scrubber=None`` runs the regex chain over whole values (JVM expressions), a callable
    gets pieces. Values that are no strings, and keys that are absent, are left alone.
    ``strict`` withholds a marked payload that is no JSON object or holds a key twice, or
    whose marker is no JSON list; ``strict=False`` passes such a payload through raw. What
    follows a payload's object is cut off. The marker is dropped from every event that was
    marked and readable or withheld; other events are left unchanged.
    """
    src = events.withColumn("_marked", marked_events(events))
    if scrubber is None:
        src = _opened(src)
        values = F.transform_values("_data", lambda k, v: F.when(
            _marked_text(k, v), deidentify(v.cast("string"))[0].cast("variant")).otherwise(v))
    else:  # a list with a place for every entry of the payload goes through the scrubber; variants do not travel through Arrow
        texts = F.transform(F.map_entries("_data"), lambda e: F.when(_marked_text(e["key"], e["value"]), e["value"].cast("string")))
        asked = _opened(src).withColumn("_texts", texts).select(*events.columns, "_marked", "_texts")
        src = _opened(scrub_lists(asked, "_texts", scrubber))
        values = F.map_from_arrays(F.map_keys("_data"), F.transform(
            F.map_values("_data"), lambda v, i: F.coalesce(F.get("_texts", i).cast("variant"), v)))
    readable, withheld = F.col("_data").isNotNull() & F.col("_keys").isNotNull(), F.lit(WITHHELD)
    raw = withheld if strict else F.element_at("attributes", F.lit("content"))
    src = src.withColumn("_new", F.when(readable, F.to_json(values)).otherwise(raw))
    drop = F.lit(True) if strict else F.col("_keys").isNotNull()
    bag = F.map_filter(F.transform_values("attributes", lambda k, v: F.when(k == "content", F.col("_new")).otherwise(v)),
                       lambda k, v: ~(drop & (k == SCRUB_KEYS_ATTR)))
    return src.withColumn("attributes", F.when(F.col("_marked"), bag).otherwise(F.col("attributes"))).select(*events.columns)


# --- erasure (P13) ----------------------------------------------------------------------------------

def erase_subjects(table: DataFrame, identities: DataFrame, key: str = "session_id") -> DataFrame:
    """Rows left after deleting every row of the given identities."""
    return table.join(identities.select(key).distinct(), key, "left_anti")


def erase_traces(telemetry: DataFrame, messages: DataFrame, identities: DataFrame, key: str = "session_id") -> DataFrame:
    """Telemetry rows left after deleting every trace that a message of the given identities belongs to.

    ``messages`` (``key``, ``trace_id``) tells whose traces they are, so it is read before its
    own rows are erased. Rows without a trace stay.
    """
    doomed = messages.join(identities.select(key).distinct(), key, "left_semi").select(F.col("trace_id").alias("OperationId")).distinct()
    return telemetry.join(doomed, "OperationId", "left_anti")
