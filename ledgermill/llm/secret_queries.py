"""Secrets in ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, table
from .secret_scan import find_secrets


def _told(spans):
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


@query("op1_secret_scan")
def op1_secret_scan(spark, folder):
    """Spans of secrets in every document."""
    found = find_secrets(table(spark, folder, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(_told(base), 256).alias("base_sha256"), _told("spans").alias("spans"),
    )
