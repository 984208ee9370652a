"""docweave: document-QA data work as PySpark DataFrame operators.

Sub-packages:
  sources    scans, state and index stores, telemetry tables, test fixtures
  functions  Column-level scalar functions (hashing, text, telemetry helpers)
  operators  DataFrame -> DataFrame operators (diff, chunk, embed, retrieve, chat,
             redact, telemetry health/panels/trace)
  plans      compositions of operators (ingest run, chat turn, health report) and the
             query catalog used by ``__spark_entry__``
  streaming  Structured Streaming forms of the arrival, panel and delta operators
"""

__version__ = "0.1.0"
