"""Streaming jobs run to the end of the given tables, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.usage import estimate_tokens
from ..session import scratch_path
from ..streaming import jobs
from .answer_queries import chat_entries, model_calls
from .registry import query

RATES = """
    c AS (SELECT event_type AS model, ts, greatest(1, CAST(floor(floor(value * 300) / 3) AS BIGINT)) AS tokens FROM events),
    w AS (SELECT model, tokens, time_bucket(INTERVAL 10 SECOND, ts) - to_seconds(10 * k) AS window_start
      FROM c, (SELECT unnest(range(0, 6)) AS k)),
    r AS (SELECT model, window_start, window_start + INTERVAL 60 SECOND AS window_end, CAST(sum(tokens) AS BIGINT) AS used_tokens,
        count(*) AS n_calls, sum(tokens) > 7200 AS over_budget FROM w GROUP BY model, window_start)
"""
RATE_COLUMNS = """SELECT model, epoch_us(window_start) AS window_start, epoch_us(window_end) AS window_end,
      used_tokens, n_calls, over_budget FROM r"""


def in_micros(rates):
    return rates.withColumns(
        {c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("window_start", "window_end")}
    )


@query("token_rate", f"WITH {RATES} {RATE_COLUMNS}")
def token_rate(t):
    return in_micros(jobs.token_rate(model_calls(t)))


def stream_of(t, name):
    """A table, one file or a folder of files, read as a stream.

    The path is written as a glob because a stream's plain path must be a
    folder.
    """
    return (
        t.spark.readStream.schema(getattr(t, name).schema)
        .option("maxFilesPerTrigger", 64)
        .parquet(f"{t.folder}/{name}.parque[t]")
    )


@query(
    "token_rate_stream",
    f"""WITH {RATES} {RATE_COLUMNS}""",
)
def token_rate_stream(t):
    """All windows of the calls, added up from a stream's batches; no call is too late for it."""
    calls = stream_of(t, "events").select(
        F.col("event_type").alias("model"), F.col("ts").cast("timestamp").alias("ts"),
        estimate_tokens(F.floor(F.col("value") * 300)).alias("tokens"),
    )
    out, checkpoint = scratch_path(t.spark, "rates"), scratch_path(t.spark, "rates-state")
    jobs.start_token_rate(calls, out, checkpoint).awaitTermination()
    return in_micros(jobs.latest_rates(t.spark.read.parquet(out)))


@query(
    "ingest_stream",
    "SELECT md5(text) AS text_md5 FROM documents GROUP BY text",
)
def ingest_stream(t):
    """Documents of a stream, each content once, however often it arrives."""
    out, checkpoint = scratch_path(t.spark, "ingest"), scratch_path(t.spark, "ingest-state")
    jobs.start_ingest(stream_of(t, "documents"), out, checkpoint).awaitTermination()
    return t.spark.read.parquet(out).select(F.md5("text").alias("text_md5"))


@query(
    "chat_log_stream",
    "SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS id, role <> 'system' AS readable FROM conversations",
)
def chat_log_stream(t):
    entries = chat_entries(_Streamed(t))
    out, checkpoint = scratch_path(t.spark, "chat"), scratch_path(t.spark, "chat-state")
    jobs.start_chat_log(entries, out, checkpoint).awaitTermination()
    return t.spark.read.parquet(out).select(
        "session_id", "id", F.try_parse_json("entry_json").isNotNull().alias("readable")
    )


@query(
    "session_counts_stream",
    """SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS n_entries, max(turn) AS last_id
    FROM conversations GROUP BY conv_id""",
)
def session_counts_stream(t):
    entries = chat_entries(_Streamed(t))
    out, checkpoint = scratch_path(t.spark, "counts"), scratch_path(t.spark, "counts-state")
    jobs.start_session_counts(entries, out, checkpoint).awaitTermination()
    return jobs.latest_counts(t.spark.read.parquet(out))


class _Streamed:
    """The conversations table as a stream, for functions that take tables."""

    def __init__(self, t):
        self.conversations = stream_of(t, "conversations")
