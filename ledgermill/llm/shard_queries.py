"""Shards of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, table
from .sharding import contiguous_shards
from .sql import crc32

OP2 = f"""
WITH r AS MATERIALIZED (
  SELECT doc_id, coalesce(strlen(text), 0) + 16 AS size, {crc32("coalesce(text, '')")} AS text_crc32 FROM documents
), p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before,
    sum(size) OVER () AS total
  FROM r
), s AS (SELECT *, (before * 40 // total)::INTEGER AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  NULL::INTEGER AS grown_shard
FROM s
"""


@query("op2_sharding", OP2)
def op2_sharding(spark, folder):
    """All documents in 40 contiguous shards of near-equal bytes."""
    placed = contiguous_shards(table(spark, folder, "documents"), keep=False)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
