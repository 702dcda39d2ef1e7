"""Skipping inputs that were already processed."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..session import cut_lineage

CONFIGURATION = json.dumps(
    {
        "chunk_size": C.CHUNK_SIZE,
        "chunk_overlap": C.CHUNK_OVERLAP,
        "chunking_version": C.CHUNKING_VERSION,
        "embedding_model": C.EMBEDDING_MODEL,
    },
    sort_keys=True,
)
#: Ids (about 50 bytes each with their fingerprint) that may go to every task.
BROADCAST_IDS = 1_000_000
#: Hexadecimal digits of a fingerprint that name its partition of the manifest.
PREFIX_DIGITS = 1
MANIFEST_SCHEMA = "fingerprint string, run string, batch long, prefix string"


def fingerprint(content: Column, configuration: str = CONFIGURATION) -> Column:
    """MD5 of the content and of the settings it is processed with."""
    return F.md5(F.concat_ws("\n", F.md5(content), F.lit(configuration)))


def new_fingerprints(docs: DataFrame, manifest: DataFrame, text: str = "content") -> DataFrame:
    """Distinct fingerprints that the manifest lacks.

    Copies collapse before the shuffle, so a text with very many copies is one
    row per task.
    """
    return (
        docs.select(fingerprint(F.col(text)).alias("fingerprint"))
        .distinct()
        .join(manifest.select("fingerprint"), "fingerprint", "left_anti")
    )


def incremental_new(
    docs: DataFrame, manifest: DataFrame, key: str = "doc_id", text: str = "content", broadcast_ids: int = BROADCAST_IDS
) -> DataFrame:
    """One document (the lowest id) per fingerprint that is new.

    The shuffles that find them carry ids and fingerprints. Up to
    ``broadcast_ids`` survivors go to every task, which picks their texts
    where it reads them, so no text is exchanged; beyond, where most of the
    input is new, the documents are joined by id.
    """
    chosen = cut_lineage(
        docs.select(key, fingerprint(F.col(text)).alias("fingerprint"))
        .groupBy("fingerprint")
        .agg(F.min(key).alias(key))
        .join(manifest.select("fingerprint"), "fingerprint", "left_anti"),
        "new-ids",
    )
    marked = docs.withColumn("fingerprint", fingerprint(F.col(text)))
    few = chosen.count() <= broadcast_ids
    return marked.join(F.broadcast(chosen) if few else chosen, [key, "fingerprint"]).select(*docs.columns, "fingerprint")


# --------------------------------------------------------------------------
# the stored manifest
# --------------------------------------------------------------------------

def _prefix(c: Column) -> Column:
    return F.substring(c, 1, PREFIX_DIGITS)


def read_manifest(spark: SparkSession, path: str, prefixes: list[str] | None = None) -> DataFrame:
    """``fingerprint, run, batch, prefix`` of all that was processed; empty before the first batch.

    With ``prefixes`` only the partitions of these are read.
    """
    try:
        stored = spark.read.schema(MANIFEST_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return stored if prefixes is None else stored.filter(F.col("prefix").isin(prefixes))


def append_manifest(fingerprints: DataFrame, path: str, run: str, batch: int) -> None:
    """Record a batch. Its folder is replaced as a whole, so a batch that runs
    again after a failure is recorded once, and no other batch is touched.

    Files are partitioned by prefix and carry Bloom filters, by which a look-up
    of single fingerprints skips the files that cannot hold them.
    """
    (
        fingerprints.select("fingerprint", _prefix(F.col("fingerprint")).alias("prefix"))
        .repartition("prefix").sortWithinPartitions("prefix", "fingerprint")
        .write.mode("overwrite").partitionBy("prefix")
        .option("parquet.bloom.filter.enabled#fingerprint", "true")
        .parquet(f"{path}/run={run}/batch={int(batch)}")
    )


def process_new(
    docs: DataFrame, path: str, run: str, batch: int, key: str = "doc_id", text: str = "content"
) -> DataFrame:
    """The documents that no other batch has processed, recorded in the manifest.

    The result is written before it is recorded. Run again, the same batch
    gives the same documents and leaves the same manifest.
    """
    spark = docs.sparkSession
    # at most 16 ** PREFIX_DIGITS values
    prefixes = [r[0] for r in docs.select(_prefix(fingerprint(F.col(text)))).distinct().collect()]
    known = read_manifest(spark, path, prefixes)
    known = known.filter(~((F.col("run") == run) & (F.col("batch") == batch)))
    fresh = cut_lineage(incremental_new(docs, known, key, text), "fresh")
    append_manifest(fresh, path, run, batch)
    return fresh.drop("fingerprint")
