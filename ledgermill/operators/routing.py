"""Classifying and routing questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import WORD, answer_language, contains_any, normalize_arabic, strip


def wants_chart(c: Column) -> Column:
    """Latin keywords count as whole words, others anywhere in the text."""
    latin = [k for k in C.CHART_KEYWORDS if k.isascii()]
    other = [k for k in C.CHART_KEYWORDS if not k.isascii()]
    words = "|".join(k + (f"[{WORD}]*" if k.endswith("iz") else "") for k in latin)
    text = F.lower(c)
    return text.rlike(rf"(?<![{WORD}])(?:{words})(?![{WORD}])") | contains_any(text, other)


def aggregation_type(c: Column) -> Column:
    text = F.lower(c)
    return (
        F.when(~contains_any(text, C.AGGREGATION_KEYWORDS), F.lit("none"))
        .when(contains_any(text, C.VARIANCE_KEYWORDS), F.lit("variance_pct"))
        .when(contains_any(text, C.NET_KEYWORDS), F.lit("net"))
        .when(contains_any(text, C.DIFFERENCE_KEYWORDS), F.lit("difference"))
        .otherwise(F.lit("sum"))
    )


def asks_improvement(c: Column) -> Column:
    return contains_any(normalize_arabic(F.lower(c)), C.IMPROVEMENT_PHRASES)


def asks_table(c: Column) -> Column:
    return contains_any(F.lower(c), C.TABLE_KEYWORDS)


def classify_queries(queries: DataFrame, text: str = "text") -> DataFrame:
    c = F.col(text)
    kind = aggregation_type(c)
    return queries.withColumns(
        {
            "wants_chart": wants_chart(c),
            "needs_aggregation": kind != "none",
            "aggregation_type": kind,
            "language": answer_language(c),
            "asks_improvement": asks_improvement(c),
            "asks_table": asks_table(c),
        }
    )


def route_queries(queries: DataFrame, sources: DataFrame, hits: DataFrame) -> DataFrame:
    """Action per question.

    ``sources(source, is_structured, is_small)`` is reduced to three flags of
    one row; ``hits`` only says which questions found something.
    """
    small = F.col("is_structured") & F.col("is_small")
    # one row with three flags, read as scalars
    any_small = sources.agg(F.coalesce(F.max(small), F.lit(False))).scalar()
    all_small = sources.agg(F.coalesce(F.min(small), F.lit(False))).scalar()
    n_small = sources.agg(F.count_if(small)).scalar()
    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    full = any_small & (all_small | asks_table(F.col("text")))
    joined = queries.join(found, "query_id", "left")
    n = F.coalesce("_n", F.lit(0))
    action = (
        F.when(full, F.lit("ANSWER_FROM_FULL_TABLE"))
        .when(n > 0, F.lit("ANSWER_FROM_CONTEXT"))
        .otherwise(F.lit("REPORT_NOT_FOUND"))
    )
    return joined.select(
        *queries.columns,
        action.alias("action"),
        F.when(full | (n > 0), F.lit("verified")).otherwise(F.lit("not_found")).alias("context_status"),
        F.when(full, n_small).otherwise(n).cast("long").alias("n_documents"),
    )


def dedupe_variants(variants: DataFrame) -> DataFrame:
    """First occurrence of each phrasing per question, the original first.

    ``variants(query_id, pos, text)`` with the original at the lowest ``pos``.
    """
    first = (
        variants.withColumn("_key", F.lower(strip(F.col("text"))))
        .filter(F.col("_key") != "")
        .groupBy("query_id", "_key")
        .agg(F.min(F.struct("pos", "text")).alias("_f"))
        .select("query_id", "_f.pos", "_f.text")
    )
    order = Window.partitionBy("query_id").orderBy("pos")
    return first.withColumn("variant", (F.row_number().over(order) - 1).cast("long")).drop("pos")
