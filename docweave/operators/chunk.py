"""Blocks to chunks.

Chunk definition (the reference delegates this to a library; this is ours):

* A token is a maximal run of characters other than space, tab, CR, LF, FF and VT.
  The token count is a pluggable Column function of the text.
* Blocks with no token are dropped (P2). A block longer than ``limit`` tokens is
  first cut into windows of ``limit`` tokens (window text = its tokens joined by
  single spaces); shorter blocks keep their text unchanged.
* Pieces are folded in order. A new chunk opens at the first piece, when the
  heading path changes, or when the current chunk is non-empty and adding the
  piece would pass ``limit``. Heading tokens count against the limit because the
  stored text is the heading path followed by the pieces (E4).
* Chunk text = heading path lines, then piece texts, joined by newlines.

Everything but the greedy fold runs as JVM array expressions on the document row
(no shuffle: a document is one row). The fold is a reset-on-overflow scan that SQL
cannot express without recursion; it runs as a vectorized pandas UDF over the
per-document array of token counts (ints only cross to Python) and returns the
chunk start offsets, from which Spark slices the texts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.text import contextualize

DEFAULT_LIMIT = 1024  # fixed value: chunk limit in tokens
# Token characters exclude these six ASCII whitespace characters (fixed definition).
TOKEN_PATTERN = r"[^ \t\n\r\f\x0B]+"


def token_count(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.size(F.regexp_extract_all(t, F.lit(TOKEN_PATTERN), 0)), F.lit(0))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _fold_starts(tokens: pd.Series, new_section: pd.Series, head_tokens: pd.Series, limit: pd.Series) -> pd.Series:
    """Greedy packing: 0-based start offset of every chunk of each document."""
    out = []
    for toks, brk, heads, lim in zip(tokens, new_section, head_tokens, limit):
        starts = []
        used = 0
        for i in range(len(toks)):
            t = int(toks[i])
            h = int(heads[i])
            if i == 0 or bool(brk[i]) or (used > h and used + t > lim):
                starts.append(i)
                used = h + t
            else:
                used += t
        out.append(starts)
    return pd.Series(out)


_FOLD = _fold_starts.asNondeterministic()


def _pieces(blocks: Column, limit: int, tokens_fn) -> Column:
    """``array<struct<text, headings, tokens>>`` with long blocks cut into windows."""
    def cut(b):
        toks = F.regexp_extract_all(b["text"], F.lit(TOKEN_PATTERN), 0)
        n = tokens_fn(b["text"])
        whole = F.array(F.struct(b["text"].alias("text"), b["headings"].alias("headings"), n.alias("tokens")))
        windows = F.transform(
            F.sequence(F.lit(0), F.ceil(n / F.lit(limit)).cast("int") - 1),
            lambda w: F.struct(
                F.array_join(F.slice(toks, w * limit + 1, F.lit(limit)), " ").alias("text"),
                b["headings"].alias("headings"),
                F.least(F.lit(limit), n - w * limit).alias("tokens")))
        return F.when(n > limit, windows).otherwise(whole)

    kept = F.filter(blocks, lambda b: tokens_fn(b["text"]) > 0)
    return F.flatten(F.transform(kept, cut))


def chunk_blocks(docs: DataFrame, blocks_col: str = "blocks", limit: int = DEFAULT_LIMIT,
                 tokens_fn=token_count) -> DataFrame:
    """Documents with ``blocks: array<struct<text, headings: array<string>>>`` to one row per chunk.

    Output keeps the document columns and adds ``chunk_index`` (0-based, E5),
    ``headings``, ``text`` (contextualised, E4) and ``n_tokens``.
    """
    keep = [c for c in docs.columns if c != blocks_col]
    p = docs.withColumn("_p", _pieces(F.col(blocks_col), limit, tokens_fn)).drop(blocks_col)
    p = p.withColumn("_tok", F.transform("_p", lambda x: x["tokens"]))
    p = p.withColumn("_hd", F.transform("_p", lambda x: F.coalesce(x["headings"], F.array().cast("array<string>"))))
    p = p.withColumn("_brk", F.transform("_hd", lambda h, i: (i > 0) & (h != F.col("_hd")[i - 1])))
    p = p.withColumn("_htok", F.transform("_hd", lambda h: F.aggregate(
        h, F.lit(0), lambda acc, x: acc + tokens_fn(x))))
    # The fold result is read inside array lambdas below. Marked non-deterministic so the
    # optimizer keeps it in its own projection (an Arrow-evaluated node) instead of inlining
    # the Python call into those lambdas, where it could not be evaluated.
    p = p.withColumn("_starts", _FOLD("_tok", "_brk", "_htok", F.lit(limit)))
    ends = F.concat(F.slice("_starts", 2, F.greatest(F.size("_starts") - 1, F.lit(0))), F.array(F.size("_p")))
    p = p.withColumn("_ends", ends)
    chunks = F.transform("_starts", lambda s, i: F.struct(
        i.alias("chunk_index"),
        F.slice("_p", s + 1, F.col("_ends")[i] - s).alias("members")))
    first_h = F.coalesce(F.element_at("_p", 1)["headings"], F.array().cast("array<string>"))
    p = p.select(*keep, first_h.alias("first_headings"), F.explode(chunks).alias("_c"))
    members = F.col("_c.members")
    heads = F.element_at(members, 1)["headings"]
    body = F.array_join(F.transform(members, lambda m: m["text"]), "\n")
    n_tok = F.aggregate(members, F.lit(0), lambda acc, m: acc + m["tokens"]) + \
        F.aggregate(F.coalesce(heads, F.array().cast("array<string>")), F.lit(0), lambda a, x: a + tokens_fn(x))
    return p.select(
        *keep,
        "first_headings",
        F.col("_c.chunk_index").alias("chunk_index"),
        F.coalesce(heads, F.array().cast("array<string>")).alias("headings"),
        contextualize(heads, body).alias("text"),
        n_tok.alias("n_tokens"),
    )


def drop_blank_chunks(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """Keep a chunk only if its text has a non-space character."""
    return chunks.filter(F.col(text_col).rlike(r"(?U)\S"))
