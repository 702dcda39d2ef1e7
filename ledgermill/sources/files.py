"""Files: tables, manifests, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C

FILE_TYPES = (
    ("PDF", C.PDF_EXTENSIONS),
    ("Excel", C.EXCEL_EXTENSIONS),
    ("CSV", C.CSV_EXTENSIONS),
    ("Image", C.IMAGE_EXTENSIONS),
)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"[^.]\.([^.]*)$", 1))


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """CSV rows with their file name (``_source``) and place in the file.

    ``_block`` is the offset of the split a row came from and ``_seq`` grows
    inside a split, so ``(_block, _seq)`` is the file order however many
    splits a file has. Give a schema for large inputs; without one Spark reads
    the files once more to infer types.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return (
        reader.csv(path)
        .withColumn("_source", F.col("_metadata.file_name"))
        .withColumn("_block", F.col("_metadata.file_block_start"))
        .withColumn("_seq", F.monotonically_increasing_id())
    )


def classify_path(path: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, extensions in FILE_TYPES:
        kind = F.when(extension(path).isin(*extensions), F.lit(name)).otherwise(kind)
    return kind


def file_manifest(paths: DataFrame, path: str = "path") -> DataFrame:
    """File name, extension, type and status per path; nothing is dropped."""
    kind = classify_path(F.col(path))
    return paths.select(
        "*",
        file_name(F.col(path)).alias("source"),
        extension(F.col(path)).alias("extension"),
        kind.alias("file_type"),
        F.coalesce(kind.isin("Excel", "CSV"), F.lit(False)).alias("is_structured"),
        F.when(kind.isNull(), F.lit("unsupported")).otherwise(F.lit("supported")).alias("status"),
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and time of the files below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length", "modificationTime")
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as ``(entry_id, entry_json)``; blank and broken lines and
    values that are not objects are skipped."""
    lines = spark.read.text(path)
    whole = F.try_parse_json("value")
    return lines.filter(F.schema_of_variant(whole).startswith("OBJECT")).select(
        F.monotonically_increasing_id().alias("entry_id"),
        F.col("value").alias("entry_json"),
    )


def write_results(df: DataFrame, path: str, fmt: str = "json") -> None:
    """JSON lines, or CSV with sorted columns and nested values as JSON."""
    if fmt == "json":
        df.write.mode("overwrite").json(path)
        return
    if fmt != "csv":
        raise ValueError(f"unknown format {fmt}")
    flat_rows(df).write.mode("overwrite").option("header", True).option(
        "escape", '"'
    ).csv(path)


def flat_rows(df: DataFrame) -> DataFrame:
    nested = (T.ArrayType, T.StructType, T.MapType, T.VariantType)
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in sorted(df.schema.fields, key=lambda f: f.name)
        ]
    )
