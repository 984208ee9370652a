"""Embeddings.

The default embedder is deterministic and fully JVM-side: lower-cased word tokens,
feature hashing into ``dim`` buckets (``HashingTF``) and L2 normalisation, so equal
texts always get equal unit vectors and no Python worker is involved.

A model embedder is a user callable ``fn(list[str]) -> list[list[float]]`` run by
``mapInPandas``; each Arrow batch is cut into calls of ``batch_size`` texts (64 by
default) and vectors are paired with texts by position (J4), with a length check.
Embedding calls cost money: write the result once (``ingest_run`` stages it) so a
retried downstream stage never repeats them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.session import spread

DEFAULT_DIM = 256
EMBED_BATCH = 64  # fixed value: texts per embedding call
WORD_PATTERN = r"[\p{L}\p{N}]+"

EmbedFn = Callable[[list[str]], list[list[float]]]


def hashing_embed(df: DataFrame, text_col: str = "text", out_col: str = "vector", dim: int = DEFAULT_DIM) -> DataFrame:
    """Feature-hashing embedder on the JVM (HashingTF + L2 norm), ``array<float>`` output."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD_PATTERN), 0)
    tmp = df.withColumn("_words", F.coalesce(words, F.array().cast("array<string>")))
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim).transform(tmp)
    normed = Normalizer(inputCol="_tf", outputCol="_vec", p=2.0).transform(tf)
    return normed.withColumn(out_col, vector_to_array("_vec", "float32")).drop("_words", "_tf", "_vec")


def embed_chunks(df: DataFrame, text_col: str = "text", out_col: str = "vector",
                 embed_fn: EmbedFn | None = None, batch_size: int = EMBED_BATCH,
                 dim: int = DEFAULT_DIM) -> DataFrame:
    """Vectors for a text column."""
    df = spread(df)
    if embed_fn is None:
        return hashing_embed(df, text_col, out_col, dim)
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.FloatType(), False), True)])

    def run(batches):
        for pdf in batches:
            texts = pdf[text_col].fillna("").tolist()
            vecs: list = []
            for start in range(0, len(texts), batch_size):
                part = texts[start:start + batch_size]
                got = embed_fn(part)
                if len(got) != len(part):  # positional pairing must be exact (J4)
                    raise ValueError(f"embedder returned {len(got)} vectors for {len(part)} texts")
                vecs.extend(np.asarray(v, dtype=np.float32) for v in got)
            out = pdf.copy()
            out[out_col] = pd.Series(vecs, index=pdf.index, dtype=object)
            yield out

    return df.mapInPandas(run, schema)


def dimension_probe(embed_fn: EmbedFn | None = None, dim: int = DEFAULT_DIM) -> int:
    """Width of the embedder's vectors (E7), from one probe string."""
    if embed_fn is None:
        return dim
    return len(embed_fn(["how wide is a vector"])[0])


def embed_questions(questions: DataFrame, text_col: str = "message", out_col: str = "qvec",
                    embed_fn: EmbedFn | None = None, dim: int = DEFAULT_DIM) -> DataFrame:
    """Question vectors with the same embedder as the chunks (V4)."""
    return embed_chunks(questions, text_col, out_col, embed_fn, dim=dim)
