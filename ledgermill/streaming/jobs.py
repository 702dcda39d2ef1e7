"""Structured Streaming jobs. Each transformation also runs on a batch table."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as C
from ..operators.incremental import fingerprint


def token_rate(
    calls: DataFrame,
    limit: int = C.MAIN_MODEL_TOKENS_PER_MINUTE,
    *,
    window: str = "60 seconds",
    slide: str = "10 seconds",
    late: str = "2 minutes",
    margin: float = C.RATE_SAFETY_MARGIN,
) -> DataFrame:
    """Tokens and calls per model in sliding windows, flagged when too many.

    ``calls(model, ts, tokens)``, batch or stream.
    """
    if calls.isStreaming:
        calls = calls.withWatermark("ts", late)
    return (
        calls.groupBy(F.window("ts", window, slide).alias("w"), "model")
        .agg(F.sum("tokens").alias("used_tokens"), F.count(F.lit(1)).alias("n_calls"))
        .select(
            "model",
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "used_tokens",
            "n_calls",
            (F.col("used_tokens") > F.lit(limit * margin)).alias("over_budget"),
        )
    )


def start_token_rate(calls: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """What each batch adds to its windows, in a Parquet table; ``latest_rates`` adds it up.

    The stream keeps no state and needs no watermark: a batch writes one row
    per model and window it has calls of, so a call counts however late it
    comes and nothing waits for a window to close.
    """
    run, number = _run_id(checkpoint), _run_number(calls.sparkSession, path, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_batch(token_rate(batch, **options).drop("over_budget"), path, run, batch_id, number)

    return (
        calls.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def latest_rates(
    updates: DataFrame, limit: int = C.MAIN_MODEL_TOKENS_PER_MINUTE, margin: float = C.RATE_SAFETY_MARGIN
) -> DataFrame:
    """The windows as of all written batches; of several runs over one window the newest counts."""
    window = ["model", "window_start", "window_end"]
    sums = updates.groupBy(*window, "run_no").agg(F.sum("used_tokens").alias("used_tokens"), F.sum("n_calls").alias("n_calls"))
    newest = sums.groupBy(*window).agg(F.max_by(F.struct("used_tokens", "n_calls"), "run_no").alias("_v"))
    return newest.select(*window, "_v.*").withColumn("over_budget", F.col("used_tokens") > F.lit(limit * margin))


def _run_id(checkpoint: str) -> str:
    """Names the rows of one checkpoint; another checkpoint never replaces them."""
    return hashlib.md5(checkpoint.encode()).hexdigest()


def _run_number(spark: SparkSession, path: str, checkpoint: str) -> int:
    """The place of a checkpoint among those that have written to the table."""
    runs = _stored(spark, path, "run_no long, run_id string").select("run_no", "run_id").distinct().collect()
    known = {r["run_id"]: r["run_no"] for r in runs}  # one row per checkpoint
    return known.get(_run_id(checkpoint), max(known.values(), default=0) + 1)


def _write_batch(rows: DataFrame, path: str, run: str, batch_id: int, number: int = 0) -> None:
    """Write a batch to its own folder; the same batch of the same run replaces it."""
    (
        rows.withColumn("run_no", F.lit(number).cast("long"))
        .withColumn("run_id", F.lit(run)).withColumn("batch_id", F.lit(batch_id).cast("long"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id", "batch_id").parquet(path)
    )


def _start_updates(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    run, number = _run_id(checkpoint), _run_number(changes.sparkSession, path, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, path, run, batch_id, number)

    return (
        changes.writeStream.foreachBatch(write).outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _latest(updates: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    when = F.struct("run_no", "batch_id")
    return updates.groupBy(*key).agg(F.max_by(F.struct(*values), when).alias("_v")).select(*key, "_v.*")


def _stored(spark, path: str, schema: str) -> DataFrame:
    """What a table holds so far; empty before its first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def start_ingest(docs: DataFrame, path: str, checkpoint: str, *, text: str = "text") -> StreamingQuery:
    """Append documents whose fingerprint is new.

    Copies inside a batch collapse by their fingerprint; older ones by an
    anti-join with all that the table holds, whichever run wrote it. No
    document is too late. A batch that runs again after a failure replaces its
    own folder, so it is written once.
    """
    run = _run_id(checkpoint)
    fresh = docs.withColumn("fingerprint", fingerprint(F.col(text)))

    def append(batch: DataFrame, batch_id: int) -> None:
        stored = _stored(batch.sparkSession, path, "fingerprint string, run_id string, batch_id long")
        own = (F.col("run_id") == run) & (F.col("batch_id") == batch_id)
        known = stored.filter(~own).select("fingerprint")
        rows = batch.dropDuplicates(["fingerprint"]).join(known, "fingerprint", "left_anti")
        _write_batch(rows, path, run, batch_id)

    return (
        fresh.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def session_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_entries"), F.max("id").alias("last_id")
    )


def start_chat_log(entries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append chat entries as they arrive."""
    return (
        entries.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def start_session_counts(entries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Running counts per session: each batch writes the sessions it changed."""
    return _start_updates(session_counts(entries), path, checkpoint)


def latest_counts(updates: DataFrame) -> DataFrame:
    """Current count per session from the written updates."""
    return _latest(updates, ["session_id"], ["n_entries", "last_id"])
