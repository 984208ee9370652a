"""Corpus sources (S1-S4, S15): file trees, tables and pluggable connectors.

Every source yields the same frame: ``id, uri, source, content BINARY`` (plus
optional ``length``/``modificationTime`` for a cheap pre-filter). The id prefix
before ``:`` names the source, so several sources can share one index.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.hashing import content_hash
from docweave.functions.text import content_type, source_of

CORPUS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("uri", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("content", T.BinaryType(), True),
])


def corpus_from_files(spark: SparkSession, root: str, source: str = "blob", container: str | None = None,
                      glob: str | None = None) -> DataFrame:
    """List every file under ``root`` (S1) with its bytes.

    ``id = source + ':' + name`` and ``uri = container/name`` where ``name`` is the path
    below ``root``. ``content`` is read lazily by the file scan, so it is pruned when
    a plan only needs the listing (length, modification time).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(root)
    base = root.rstrip("/")
    base = base if "://" in base else "file:" + base
    name = F.regexp_replace(F.col("path"), "^" + _regex_quote(base) + "/?", "")
    cont = container or base.rsplit("/", 1)[-1]
    return df.select(
        F.concat(F.lit(source + ":"), name).alias("id"),
        F.concat(F.lit(cont + "/"), name).alias("uri"),
        F.lit(source).alias("source"),
        F.col("content"),
        F.col("length"),
        F.col("modificationTime"),
        F.col("path"),
    )


def reread_files(spark: SparkSession, corpus_root: str, paths: list[str], source: str = "blob",
                 container: str | None = None) -> DataFrame:
    """The same corpus frame, reading only the given files (a bounded list of paths)."""
    df = corpus_from_files(spark, corpus_root, source, container)
    if not paths:
        return df.limit(0)
    reader = spark.read.format("binaryFile")
    raw = reader.load(paths)
    base = corpus_root.rstrip("/")
    base = base if "://" in base else "file:" + base
    name = F.regexp_replace(F.col("path"), "^" + _regex_quote(base) + "/?", "")
    cont = container or base.rsplit("/", 1)[-1]
    return raw.select(F.concat(F.lit(source + ":"), name).alias("id"), F.concat(F.lit(cont + "/"), name).alias("uri"),
                      F.lit(source).alias("source"), "content", "length", "modificationTime", "path")


def corpus_from_table(df: DataFrame, id_col: str, text_col: str, source: str | None = None,
                      source_col: str | None = None, uri_col: str | None = None) -> DataFrame:
    """A table of texts as a corpus: content is the UTF-8 of the text."""
    src = F.col(source_col) if source_col else F.lit(source or "table")
    ident = F.concat(src, F.lit(":"), F.col(id_col).cast("string"))
    uri = F.col(uri_col) if uri_col else F.concat(src, F.lit("/"), F.col(id_col).cast("string"), F.lit(".txt"))
    return df.select(ident.alias("id"), uri.alias("uri"), src.alias("source"),
                     F.encode(F.col(text_col), "UTF-8").alias("content"))


def corpus_union(*corpora: DataFrame) -> DataFrame:
    """Several sources in one corpus."""
    out = corpora[0]
    for c in corpora[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def with_fingerprint(corpus: DataFrame, config_fingerprint: str | None = None) -> DataFrame:
    """Add ``content_hash`` (F1), ``source`` from the id (F4) and ``content_type``.

    With ``config_fingerprint`` (e.g. chunk limit + embedding model) the hash also covers
    the processing settings, so changing them re-ingests (trap T2; off by default).
    """
    h = content_hash("content")
    if config_fingerprint:
        h = F.sha2(F.concat(h, F.lit(":" + config_fingerprint)), 256)
    return corpus.withColumns({
        "content_hash": h,
        "source": F.coalesce(F.col("source"), source_of("id")) if "source" in corpus.columns else source_of("id"),
        "content_type": content_type("uri"),
    })


def _regex_quote(s: str) -> str:
    return "".join("\\" + ch if ch in ".^$*+?()[]{}|\\" else ch for ch in s)


# --- pluggable connectors (S3) -----------------------------------------------------------

class Source(Protocol):
    """A connector: a name, a listing split into shards, and a fetch.

    ``shards()`` returns a small list of shard keys (prefixes, table ranges, site
    sections). Each shard is listed and fetched inside its own Spark task, so
    neither the listing nor the bytes pass through the driver.
    """

    name: str

    def shards(self) -> list[str]: ...

    def list(self, shard: str) -> Iterable[tuple[str, str]]:
        """Yield ``(doc_key, uri)`` of every document in the shard."""
        ...

    def fetch(self, uri: str) -> bytes: ...


def corpus_from_source(spark: SparkSession, source: Source) -> DataFrame:
    """Run a :class:`Source` as a Python data source, one partition per shard."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class _Reader(DataSourceReader):
        def __init__(self, src: Source):
            self.src = src

        def partitions(self):
            return [InputPartition(s) for s in self.src.shards()]

        def read(self, partition) -> Iterator[tuple]:
            for key, uri in self.src.list(partition.value):
                yield (f"{self.src.name}:{key}", uri, self.src.name, self.src.fetch(uri))

    class _Connector(DataSource):
        @classmethod
        def name(cls):
            return "docweave_source"

        def schema(self):
            return CORPUS_SCHEMA

        def reader(self, schema):
            return _Reader(source)

    spark.dataSource.register(_Connector)
    return spark.read.format("docweave_source").load()
