"""Benchmark passages in ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .decontaminate import benchmark_hits
from .registry import query, table
from .sql import alnum_words, lower_ascii

OP6 = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce({alnum_words(lower_ascii('text'))}, []) AS w FROM documents
), b AS MATERIALIZED (
  SELECT item_id, {alnum_words(lower_ascii('text'))} AS w FROM benchmark WHERE text IS NOT NULL
), bw AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS m,
    unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS win
  FROM b WHERE len(w) > 0
), dw AS MATERIALIZED (
  SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i,
    unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS win
  FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m
), o AS MATERIALIZED (SELECT doc_id, item_id, i, dw.m FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win
), h AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM o) GROUP BY doc_id
), n AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s
  FROM o GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query("op6_benchmark_decontamination", OP6)
def op6_benchmark_decontamination(spark, folder):
    """Words of every document inside occurrences of benchmark windows."""
    found = benchmark_hits(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"), keep=False
    )
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
