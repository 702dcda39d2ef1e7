"""Quality rules over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, table
from .rules import RULES, STOP_WORDS, SYMBOL, WINDOW, WORD, apply_rules


def _fails() -> str:
    parts = []
    for _, measure, least, most in RULES:
        parts += [f"{measure} < {least}"] if least is not None else []
        parts += [f"{measure} > {most}"] if most is not None else []
    return " OR ".join(parts)


def _ratio(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {part} / {whole} ELSE 0.0 END"


OP4 = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l
  FROM documents
), g AS MATERIALIZED (
  SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i,
    unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS g
  FROM d
), r AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (
    SELECT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM g
    WHERE (doc_id, g) IN (SELECT (doc_id, g) FROM g GROUP BY doc_id, g HAVING count(*) > 1)
  ) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(t, '{SYMBOL}')) AS n_symbols, len(l) AS n_lines,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{s}'" for s in sorted(set(STOP_WORDS)))}))) AS n_stop,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter,
    len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullets,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipses
  FROM d LEFT JOIN r USING (doc_id)
), x AS (
  SELECT *, {_ratio("word_chars", "n_words")} AS mean_word_length, {_ratio("n_symbols", "n_words")} AS symbol_ratio,
    {_ratio("n_stop", "n_words")} AS stop_ratio, {_ratio("n_dup_lines", "n_lines")} AS dup_line_ratio,
    {_ratio("n_bullets", "n_lines")} AS bullet_ratio, {_ratio("n_ellipses", "n_lines")} AS ellipsis_ratio,
    {_ratio("n_letter", "n_words")} AS letter_ratio, {_ratio("n_repeat_words", "n_words")} AS repeat_ratio
  FROM m
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT ({_fails()}) AS kept
FROM b
"""


@query("op4_quality_rules", OP4)
def op4_quality_rules(spark, folder):
    """Measures of every document, what the base rules say and the verdict of all rules."""
    ruled = apply_rules(table(spark, folder, "documents").select("doc_id", "text"))
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return ruled.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & F.col("kept")).alias("kept"),
    )
