"""Quality scores of ``documents``."""

from __future__ import annotations

from .registry import query, table
from .weak_labels import fit, score


@query("op5_quality_classifier")
def op5_quality_classifier(spark, folder):
    """Score and verdict of every document, learned from weak labels."""
    docs = table(spark, folder, "documents")
    return score(docs, fit(docs))
