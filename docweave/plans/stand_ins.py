"""Callables that stand in for external services in catalog entries (workers import this module alone)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.session import scratch_path


PART_ROWS = 2000


def _files(path: str):
    """(file system, path in it) of a local path or a URI, as tasks open it."""
    from pyarrow import fs

    local = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(local) if "://" in local else (fs.LocalFileSystem(), local)


class PagesSource:
    """A connector (S3) over a table of pages: rows by number, read in the task that lists them.

    ``path`` is a parquet file, or a folder whose files hold the rows in order of their names; ``over``
    writes such a folder from whatever Spark can read. ``arrivals`` makes the change listing
    grow to its full length in so many looks at it.
    """

    name = "made"

    def __init__(self, path: str, arrivals: int = 1, n_shards: int = 4):
        import pyarrow.parquet as pq
        from pyarrow import fs

        self.path, self.arrivals, self.looks = path, arrivals, 0
        files, at = _files(path)
        names = [at] if files.get_file_info(at).is_file else sorted(
            f.path for f in files.get_file_info(fs.FileSelector(at)) if f.is_file and f.base_name.endswith(".parquet"))
        self.n, self.parts = 0, []  # (file, number of its first row, rows)
        for name in names:
            with files.open_input_file(name) as fh:
                rows = pq.read_metadata(fh).num_rows
            self.parts.append((name, self.n, rows))
            self.n += rows
        self.n_shards = max(n_shards, len(self.parts))

    @classmethod
    def over(cls, pages: DataFrame, **settings) -> PagesSource:
        """The rows of a table read by Spark, numbered in order of its files and written under the shared folder in parts of bounded size."""
        spark = pages.sparkSession
        place = pages.select("page_id", "url", "html", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        parts = max(1, -(-pages.count() // PART_ROWS))
        path = scratch_path(spark, f"made-pages-{uuid.uuid4().hex}")
        place.repartitionByRange(parts, "file", "row").sortWithinPartitions("file", "row").drop("file", "row").write.parquet(path)
        return cls(path, **settings)

    def shards(self):
        return [f"{self.n * i // self.n_shards}-{self.n * (i + 1) // self.n_shards}" for i in range(self.n_shards)]

    def _rows(self, start, end):
        import pyarrow.parquet as pq

        files, _ = _files(self.path)
        for name, at, rows in self.parts:
            if at >= end or at + rows <= start:
                continue
            with files.open_input_file(name) as fh:
                for batch in pq.ParquetFile(fh).iter_batches(256, columns=["page_id", "url", "html"]):
                    if at < end and at + batch.num_rows > start:
                        part = batch.slice(max(0, start - at), min(end, at + batch.num_rows) - max(at, start))
                        yield from zip(range(max(at, start), end), *(c.to_pylist() for c in part.columns))
                    at += batch.num_rows

    def list(self, shard):
        self.held = {}
        for _, key, url, html in self._rows(*map(int, shard.split("-"))):
            self.held = {url: html}  # fetched right after it is listed
            yield str(key), url

    def fetch(self, uri):
        return (self.held[uri] or "").encode()

    def last(self):
        self.looks += 1
        return min(self.n, -(-self.n * self.looks // self.arrivals))

    def changes(self, start, end):
        return ((number, str(key), url, (html or "").encode()) for number, key, url, html in self._rows(start, end))


def failing_service(texts):
    """A stand-in for a redaction service that is down for some of its input."""
    if any("@" in t for t in texts):
        raise RuntimeError("unavailable")
    return ["<" + t.replace("e", "*") + ">" for t in texts]


def letter_counts(texts):
    """An embedder for checks: length, and how often a, e and the line break occur."""
    return [[float(len(t)), float(t.count("a")), float(t.count("e")), float(t.count("\n"))] for t in texts]
