"""``documents`` mixed to target weights."""

from __future__ import annotations

from .mixing import BITS, SEED, TEMPERATURE, mix, source_rates
from .registry import query, table


def _hash(seed: int, *parts: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"coalesce(({p})::VARCHAR, 'null')" for p in parts]])
    return f"('0x' || substr(md5({text}), 1, {BITS // 4}))::BIGINT"


OP9 = f"""
WITH z AS (
  SELECT source, sum(greatest(coalesce(strlen(text), 0), 1))::DOUBLE AS bytes FROM documents GROUP BY source
), r AS (
  SELECT source, pow(bytes, {TEMPERATURE}) / (SELECT sum(pow(bytes, {TEMPERATURE})) FROM z)
    * (SELECT sum(bytes) FROM z) / bytes AS rate FROM z
), p AS (
  SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT)) AS k FROM r
), c AS MATERIALIZED (
  SELECT source, floor(least(sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k), 1.0)
    * pow(2.0, {BITS}))::BIGINT AS cut FROM p
), n AS (
  SELECT d.doc_id, d.source, count(*) FILTER (WHERE c.cut <= {_hash(SEED, "d.doc_id")}) AS n_copies
  FROM documents d JOIN c ON d.source IS NOT DISTINCT FROM c.source GROUP BY ALL
), e AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM n)
SELECT doc_id, source, copy::BIGINT AS copy, n_copies::BIGINT AS n_copies, {_hash(SEED + 1, "doc_id", "copy")} AS order_key
FROM e
"""


@query("op9_source_mixing", OP9)
def op9_source_mixing(spark, folder):
    """Copies of documents by Poisson replication, in their global random order."""
    docs = table(spark, folder, "documents")
    mixed = mix(docs.select("doc_id", "source"), source_rates(docs))
    return mixed.select("doc_id", "source", "copy", "n_copies", "order_key")
