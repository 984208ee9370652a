"""The query catalog behind ``__spark_entry__``.

Each entry reads the test tables of one scale-factor folder (through the shared
fixture views) and runs one operator, or a composition, over the whole tables.
``ORACLES`` holds the DuckDB SQL that computes the same rows from the same
parquet files; entries without an oracle are checked by tests instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweave.sources.testdata import TestData

# The fixture month is 2024-01-01 .. 2024-01-30 and as_of is 2024-01-31, so a
# 30-day window reads every telemetry row.
SINCE = "30d"
WINDOW_START = "timestamp '2024-01-01 00:00:00'"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Callable[[TestData], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(TestData(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return run

    return deco


# Import the modules that fill the catalog.
from docweave.plans import (  # noqa: E402,F401
    q_chat,
    q_ingest,
    q_paths,
    q_redact,
    q_retrieve,
    q_stream,
    q_telemetry,
)
