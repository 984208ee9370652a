"""A connector's change listing as a stream (S3, W1): a Python data source with offsets.

A connector that numbers its changes (every added or edited document takes the next number) is
read as a Structured Streaming source: an offset is a number of changes, a trigger takes what
has been listed since the last one, cut into partitions, and each partition lists and fetches its
own changes in its task. Neither the listing nor the bytes pass through the driver, which
only asks how many changes there are. After a failure the trigger is replayed from its offsets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

CHANGE_SCHEMA = "id string, uri string, source string, content binary, seq long"


class ChangeSource(Protocol):
    """A connector with numbered changes."""

    name: str

    def last(self) -> int:
        """How many changes there are by now; never falls."""
        ...

    def changes(self, start: int, end: int) -> Iterable[tuple[int, str, str, bytes]]:
        """``(number, doc_key, uri, content)`` of the changes ``start`` .. ``end - 1``."""
        ...


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


def connector_stream(spark: SparkSession, source: ChangeSource, changes_per_task: int = 1000) -> DataFrame:
    """The changes of ``source`` as a streaming corpus (``id, uri, source, content``) with their numbers (``seq``)."""
    class _Reader(DataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"changes": 0}

        def latestOffset(self) -> dict:
            return {"changes": source.last()}

        def partitions(self, start: dict, end: dict):
            return [_Range(lo, min(lo + changes_per_task, end["changes"])) for lo in range(start["changes"], end["changes"], changes_per_task)]

        def read(self, partition) -> Iterator[tuple]:
            for number, key, uri, content in source.changes(partition.start, partition.end):
                yield (f"{source.name}:{key}", uri, source.name, content, number)

        def commit(self, end: dict) -> None:
            pass  # nothing is held for a trigger

    class _Connector(DataSource):
        @classmethod
        def name(cls):
            return f"docweave_changes_{source.name}"

        def schema(self):
            return CHANGE_SCHEMA

        def streamReader(self, schema):
            return _Reader()

    spark.dataSource.register(_Connector)
    return spark.readStream.format(f"docweave_changes_{source.name}").load()
