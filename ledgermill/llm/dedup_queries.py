"""Near duplicates over ``documents``."""

from __future__ import annotations

from .near_dups import near_duplicates
from .registry import query, table
from .sql import lower_ascii, blank_words

OP10 = f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, coalesce({blank_words(lower_ascii('text'))}, []) AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE
    WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM w
), g AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c USING (doc_id)
"""


@query("op10_minhash_near_dedup", OP10)
def op10_minhash_near_dedup(spark, folder):
    """Components of documents whose 4-word shingle sets are at least 80 % alike."""
    found = near_duplicates(table(spark, folder, "documents"), width=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")
