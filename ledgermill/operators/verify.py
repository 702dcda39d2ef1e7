"""Checking answers against their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import has_digit, let, matches, settle, strip


def _name_tokens(c: Column) -> Column:
    return F.array_except(
        matches(c, r"[a-z0-9\u0600-\u06ff]+"),
        F.array(*[F.lit(w) for w in C.SOURCE_NAME_NOISE]),
    )


def sources_conflict(claimed: Column, actual: Column) -> Column:
    """True when an answer names another source than the one that matched."""
    names = F.struct(
        F.lower(strip(F.coalesce(claimed, F.lit("")))).alias("said"),
        F.lower(strip(F.coalesce(actual, F.lit("")))).alias("real"),
    )

    def within(tokens: Column, others: Column) -> Column:
        return F.size(F.array_except(tokens, others)) == 0

    def differ(n: Column) -> Column:
        tokens = F.struct(_name_tokens(n.said).alias("mine"), _name_tokens(n.real).alias("theirs"))

        def by_token(t: Column) -> Column:
            same = (F.size(t.mine) > 0) & within(t.mine, t.theirs)
            for phrase, words in C.SOURCE_ALIASES:
                alias = F.array(*[F.lit(w) for w in words])
                same = same | (n.said.contains(phrase) & within(alias, t.theirs))
            return ~same

        plain = (
            (n.said == "") | (n.real == "") | n.real.contains(n.said) | n.said.contains(n.real)
        )
        return ~plain & let(tokens, by_token)

    return let(names, differ)


def is_not_found(label: Column) -> Column:
    return F.upper(strip(F.coalesce(label, F.lit("")))) == C.NOT_FOUND_LABEL


def check_outcomes(checks: DataFrame) -> DataFrame:
    """Adds ``conflict``, ``is_bad`` and the note of each number check."""
    conflict = sources_conflict(F.col("source_file_claimed"), F.col("source_file_actual"))
    note = F.when(
        F.col("conflict"),
        F.concat(
            F.coalesce("number_in_answer", F.lit("None")), F.lit(" claimed from source '"),
            F.col("source_file_claimed"), F.lit("' but matched source '"),
            F.col("source_file_actual"), F.lit("'"),
        ),
    ).otherwise(
        F.concat(
            F.coalesce("number_in_answer", F.lit("None")), F.lit(" attributed to '"),
            F.coalesce("row_label_in_source", F.lit("None")),
            F.lit("' which does not match the question's intent"),
        )
    )
    bad = (
        ~F.coalesce("matches_question_intent", F.lit(False))
        | is_not_found(F.col("row_label_in_source"))
        | F.col("conflict")
    )
    return settle(settle(checks, conflict=conflict), is_bad=bad).withColumn(
        "note", F.when(F.col("is_bad"), note)
    )


def verification_rollup(verifications: DataFrame, checks: DataFrame) -> DataFrame:
    """Final rating, pass flag and missing references per answer and attempt.

    Checks are reduced to their distinct notes before the join.
    """
    key = ["answer_id", "attempt"]
    bad = (
        check_outcomes(checks)
        .filter("is_bad")
        .groupBy(*key)
        .agg(F.array_sort(F.collect_set("note")).alias("_notes"))
    )
    any_bad = F.col("_notes").isNotNull()
    refs = F.coalesce("missing_refs", F.array().cast("array<string>"))
    return verifications.join(bad, key, "left").select(
        *key,
        F.when(any_bad, F.least("rating", F.lit(C.BAD_CHECK_MAX_RATING)))
        .otherwise(F.col("rating")).alias("rating"),
        (F.col("passed") & ~any_bad).alias("passed"),
        F.when(any_bad, F.concat(refs, F.array_except("_notes", refs)))
        .otherwise(refs).alias("missing_refs"),
    )


def confidence(rating: Column) -> Column:
    return (
        F.when(rating.isNull(), F.lit("N/A"))
        .when(rating >= C.HIGH_RATING, F.lit("High"))
        .when(rating >= C.MEDIUM_RATING, F.lit("Medium"))
        .otherwise(F.lit("Low"))
    )


def best_attempt(attempts: DataFrame) -> DataFrame:
    """Best-rated attempt per answer (the first on ties); whether the last
    attempt passed; the confidence label."""
    value = F.struct("attempt", "rating", "answer") if "answer" in attempts.columns else F.struct("attempt", "rating")
    best = attempts.groupBy("answer_id").agg(
        F.max_by(value, F.struct("rating", -F.col("attempt"))).alias("_b"),
        F.max_by("passed", "attempt").alias("converged"),
        F.count(F.lit(1)).alias("attempts_made"),
    )
    fields = ["_b.attempt", "_b.rating"] + (["_b.answer"] if "answer" in attempts.columns else [])
    return best.select(
        "answer_id", *fields, "converged", "attempts_made",
    ).withColumn("confidence", confidence(F.col("rating")))


def needs_number_check(answer: Column) -> Column:
    return has_digit(F.coalesce(answer, F.lit("")))


def split_for_checking(answers: DataFrame) -> DataFrame:
    """Answers without a digit skip checking with rating 8, passed."""
    need = needs_number_check(F.col("answer"))
    return answers.withColumns(
        {
            "needs_check": need,
            "rating": F.when(~need, F.lit(C.SKIPPED_RATING)),
            "passed": F.when(~need, F.lit(True)),
        }
    )


def remove_unverified_numbers(answers: DataFrame, checks: DataFrame) -> DataFrame:
    """Drop the lines that contain a number no source has, and say so.

    ``checks(answer_id, pos, number_in_answer, row_label_in_source)``: the
    numbers of one answer are gathered, its lines are filtered in place.
    """
    number = strip(F.col("number_in_answer"))
    missing = (
        checks.filter(is_not_found(F.col("row_label_in_source")) & (number != ""))
        .groupBy("answer_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", number.alias("n")))).alias("_c"))
        .select("answer_id", F.col("_c.n").alias("_numbers"))
    )
    lines = F.split(F.regexp_replace("answer", r"\r\n?", "\n"), "\n", -1)
    kept = strip(
        F.array_join(
            F.filter(lines, lambda l: ~F.exists("_numbers", lambda n: l.contains(n))), "\n"
        )
    )
    opening, closing = C.NOT_FOUND_STATEMENT
    said = F.array_join(
        F.transform("_numbers", lambda n: F.concat(F.lit(opening), n, F.lit(closing))), "\n"
    )
    cleaned = let(
        kept, lambda t: F.when(t != "", F.concat(t, F.lit("\n\n"), said)).otherwise(said)
    )
    return answers.join(missing, "answer_id", "left").withColumn(
        "answer", F.when(F.col("_numbers").isNotNull(), cleaned).otherwise(F.col("answer"))
    ).drop("_numbers")


def conflicting_claims(claims: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Entities that one answer gives different values: ``claims(answer_id,
    entity, attribute, value)``. Extremes decide, so no value list is kept."""
    keys = keys or ["answer_id", "entity", "attribute"]
    return (
        claims.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_claims"),
            F.min("value").alias("lowest"),
            F.max("value").alias("highest"),
        )
        .filter(F.col("lowest") != F.col("highest"))
    )


def source_list(hits: DataFrame, label: str = "label") -> DataFrame:
    """Distinct sorted source labels and document count per question."""
    per_label = hits.groupBy("query_id", label).agg(F.count(F.lit(1)).alias("_n"))
    return per_label.groupBy("query_id").agg(
        F.array_sort(F.collect_list(label)).alias("sources"),
        F.sum("_n").alias("relevant_docs_count"),
    )


def verification_sources(hits: DataFrame) -> DataFrame:
    """The first 8 sources of each answer, 6000 characters each."""
    return hits.filter(F.col("rank") < C.VERIFICATION_MAX_SOURCES).withColumn(
        "content", F.substring("content", 1, C.VERIFICATION_SNIPPET_CHARS)
    )


def grading_snippet(content: Column) -> Column:
    return F.substring(content, 1, C.GRADING_SNIPPET_CHARS)
