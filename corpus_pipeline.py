"""From ``documents`` to shards of a training corpus, in five stages.

Each stage takes all rows that its predecessor kept, written as Parquet and
read again. All but the last return the columns of ``documents``.

Every stage carries a row's columns along as one value beside those it works
on, so extra columns stay as they are, whatever their names. Without rows each
stage gives none. What each does with nulls, empty texts and repeated rows is
in its text; a null or empty text is never a reason to fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.llm import decontaminate, language, mixing, near_dups, sharding
from ledgermill.session import cut_lineage


def _carried(docs: DataFrame, *needed: str) -> DataFrame:
    """The text, the columns a stage needs, and all others as one value."""
    rest = [c for c in docs.columns if c != "text"]
    return docs.select("text", *needed, F.struct(*rest).alias("whole"))


def _restored(found: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` from carried rows."""
    of = lambda c: F.col("text") if c == "text" else F.col("whole")[c]
    return found.select(*[changed.get(c, of(c)).alias(c) for c in docs.columns])


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that the language model rejects.

    A null text, and one without letters, has no language and is dropped;
    equal texts stay or go together. Without labelled rows all are dropped.
    """
    model = language.fit(docs)
    found = language.identify(_carried(docs, "doc_id"), model)
    return _restored(found.filter("not rejected"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: 5-word shingles, 80 % alike.

    Rows without words or without an id stay. Repeated rows are one document.
    """
    return near_dups.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; texts of which no word is left go.

    Null and empty texts hold no passage and stay; equal texts are cut alike.
    """
    bench = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found = decontaminate.benchmark_hits(_carried(docs, "doc_id"), bench, remove=True)
    left = found.filter((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words")))
    if "n_chars" not in docs.columns:
        return _restored(left, docs)
    length = F.when(F.col("n_hit") > 0, F.length("text")).otherwise(F.col("whole")["n_chars"])
    return _restored(left, docs, n_chars=length.cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated to their target rates, in one random order.

    A null source is a source; texts do not matter. Rows of one id and source
    have the same number of copies.
    """
    mixed = mixing.mix(_carried(docs, "doc_id", "source"), mixing.source_rates(docs))
    return _restored(mixed, docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contiguous shards of near-equal bytes; a null text has none but its row's overhead.

    Adds ``size, text_crc32, shard, slot``, in place of extra columns of these names.
    """
    return sharding.contiguous_shards(docs)


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("source_mixing", mix_sources),
    ("sharding", cut_shards),
]

#: SQL has no words for the language model; the tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs, name)
    return docs
