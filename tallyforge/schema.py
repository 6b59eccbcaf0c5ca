"""Canonical schemas: one row per model request, one row per session."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()

#: What every reader returns. Text that the log does not state is ``''``; ``log_cost`` null means the log is silent.
EVENT = T.StructType([
    T.StructField("harness", _S), T.StructField("instance_id", _S), T.StructField("dedup_key", _S), T.StructField("session_id", _S),
    T.StructField("parent_id", _S), T.StructField("project", _S), T.StructField("ts", _TS), T.StructField("model", _S), T.StructField("provider", _S),
    T.StructField("base_url", _S), T.StructField("input", _L), T.StructField("output", _L), T.StructField("cache_read", _L), T.StructField("cache_write", _L),
    T.StructField("cache_write_1h", _L), T.StructField("reasoning", _L), T.StructField("log_cost", _D), T.StructField("request_id", _S),
    T.StructField("boundary", _S), T.StructField("bill_amount", _D), T.StructField("bill_unit", _S), T.StructField("decode_ms", _L), T.StructField("git_branch", _S),
])
SESSION = T.StructType([
    T.StructField("harness", _S), T.StructField("instance_id", _S), T.StructField("session_id", _S), T.StructField("parent_id", _S),
    T.StructField("title", _S), T.StructField("project", _S), T.StructField("started_at", _TS), T.StructField("updated_at", _TS),
])
KEY = ("harness", "instance_id", "dedup_key")
SESSION_KEY = ("harness", "instance_id", "session_id")
TOKENS = ("input", "output", "cache_read", "cache_write", "reasoning")
