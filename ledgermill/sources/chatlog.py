"""The append-only chat log.

Entries are Parquet files in a folder per batch and buckets of sessions; a
cleared session is a row in a second, equally append-only table that names the
last id it covers. An append replaces the folder of its own batch and touches
no other, so one that runs again after a failure stores its entries once.
Nothing else is rewritten, so a lost executor cannot leave a half-deleted log.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import strip_legacy_notes

ENTRY_SCHEMA = "session_id string, id long, entry_json string, created_at double"
CLEARED_SCHEMA = "session_id string, up_to long"
BUCKETS = 64


def _bucket(session: Column) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(BUCKETS)).cast("int")


def append_entries(entries: DataFrame, path: str, batch: str | None = None) -> None:
    """Store entries as one batch; the same batch again takes the place of the first.

    Without a name the batch is a new one.
    """
    (
        entries.select("session_id", "id", "entry_json", "created_at")
        .withColumn("bucket", _bucket(F.col("session_id")))
        .write.mode("overwrite").partitionBy("bucket")
        .parquet(f"{path}/entries/batch={batch or uuid.uuid4().hex}")
    )


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """Entries with their bucket, as of the batches that are complete now."""
    return spark.read.schema(ENTRY_SCHEMA + ", batch string, bucket int").parquet(f"{path}/entries").drop("batch")


def _cleared(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(CLEARED_SCHEMA).parquet(f"{path}/cleared")
    except Exception as error:  # no session has been cleared yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], CLEARED_SCHEMA)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return drop_cleared(_stored(spark, path).drop("bucket"), _cleared(spark, path))


def drop_cleared(entries: DataFrame, cleared: DataFrame) -> DataFrame:
    last = cleared.groupBy("session_id").agg(F.max("up_to").alias("up_to"))
    return (
        entries.join(last, "session_id", "left")
        .filter(F.col("up_to").isNull() | (F.col("id") > F.col("up_to")))
        .drop("up_to")
    )


def readable(entries: DataFrame) -> DataFrame:
    """Entries whose JSON parses; others are skipped without a message."""
    return entries.filter(F.try_parse_json("entry_json").isNotNull())


def load_history(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """One session in order of id; only its bucket is read."""
    mine = _stored(spark, path).filter(
        (F.col("bucket") == _bucket(F.lit(session_id))) & (F.col("session_id") == session_id)
    ).drop("bucket")
    return readable(
        drop_cleared(mine, _cleared(spark, path).filter(F.col("session_id") == session_id))
    ).orderBy("id")


def load_all_history(spark: SparkSession, path: str) -> DataFrame:
    return readable(read_log(spark, path)).orderBy("session_id", "id")


def clear_sessions(sessions: DataFrame, path: str) -> None:
    """Hide all that the log holds so far of ``sessions(session_id)``; later entries show again."""
    last = (
        read_log(sessions.sparkSession, path).join(sessions.select("session_id"), "session_id", "left_semi")
        .groupBy("session_id").agg(F.max("id").alias("up_to"))
    )
    last.write.mode("append").parquet(f"{path}/cleared")


def clear_session(spark: SparkSession, path: str, session_id: str) -> None:
    clear_sessions(spark.createDataFrame([(session_id,)], "session_id string"), path)


def _text(name: str) -> Column:
    return F.get_json_object("entry_json", f"$.{name}")


def last_turns(entries: DataFrame, k: int = C.HISTORY_TURNS) -> DataFrame:
    """The last k turns per session, oldest first, question and answer only.

    The filter on the row number lets every task keep k rows per session
    before the shuffle.
    """
    newest = Window.partitionBy("session_id").orderBy(F.desc("id"))
    return (
        entries.withColumn("_back", F.row_number().over(newest))
        .filter(F.col("_back") <= k)
        .select(
            "session_id", "id",
            F.coalesce(_text("question"), F.lit("")).alias("question"),
            strip_legacy_notes(_text("answer")).alias("answer"),
        )
    )


def export_records(entries: DataFrame) -> DataFrame:
    """Chat entries as evaluation records; chunks win over pages as context."""
    chunks, pages = _text("source_chunks"), _text("source_pages")
    return entries.select(
        "session_id", "id",
        F.coalesce(_text("question"), F.lit("")).alias("question"),
        F.coalesce(_text("answer"), F.lit("")).alias("generated_answer"),
        chunks.alias("source_chunks"),
        F.when(chunks.isNull(), pages).alias("retrieved_context"),
        _text("reference_answer").alias("reference_answer"),
    )
