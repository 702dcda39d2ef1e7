"""Filters of ``documents`` in every order."""

from __future__ import annotations

from itertools import permutations

from .filter_audit import audit
from .registry import query, table
from .sql import blank_words

OP11 = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {blank_words("coalesce(text, '')")} AS w FROM documents
), f AS MATERIALIZED (
  SELECT t, min(doc_id) AS first FROM d GROUP BY t
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), m AS MATERIALIZED (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
     100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
     coalesce(d.doc_id > first, false)] AS fails
  FROM d JOIN f USING (t) LEFT JOIN l USING (doc_id)
), c AS MATERIALIZED (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails
), o AS (
  SELECT unnest([{", ".join(f"'{''.join(p)}'" for p in permutations("ABCDE"))}]) AS filter_order
), s AS MATERIALIZED (
  SELECT filter_order, step, ascii(filter_order[step]) - 64 AS f,
    list_transform(string_split(filter_order[1:step - 1], ''), lambda x: ascii(x) - 64) AS done
  FROM o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, step, f, fails, n, good, toxic, fails[f] AS now,
    len(list_filter(done, lambda i: i > 0 AND fails[i])) > 0 AS gone
  FROM c, s
), a AS MATERIALIZED (
  SELECT part, filter_order, step, f, sum(CASE WHEN NOT now AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN now AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN now AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN now AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN now AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN now AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM a
"""


@query("op11_filter_audit", OP11)
def op11_filter_audit(spark, folder):
    """What each of five filters removes from ``documents`` in all 120 orders, per language."""
    return audit(table(spark, folder, "documents").select("doc_id", "lang", "text"), table(spark, folder, "labels"))
