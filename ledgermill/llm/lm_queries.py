"""Language-model scores of ``documents``."""

from __future__ import annotations

from .lm_scoring import score_texts
from .registry import query, table


@query("op7_lm_scoring")
def op7_lm_scoring(spark, folder):
    """Base and model scores of every document, learned from six of seven folds."""
    return score_texts(table(spark, folder, "documents"))
