"""Languages of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .language import fit, fold, identify
from .registry import query, table


@query("op8_language_id")
def op8_language_id(spark, folder):
    """Language of every document, learned from three quarters of them."""
    docs = table(spark, folder, "documents").withColumn(
        "held_out", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    )
    model = fit(docs.filter("not held_out"))
    return identify(docs, model, keep=False, also=("doc_id", "held_out")).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected"
    )
