"""Scoring answer logs: item matching, grounding, judge replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions import jsonvals as J
from ..functions.numbers import (
    describe,
    describe_both,
    describe_plain,
    item_has_no_data,
    meaningful_words,
    normalize_item,
)
from ..functions.text import clean_words, let, redact_models, settle, strip
from . import plain_entries as P
from .ordering import number_rows

RETRIEVED, RELEVANT = "retrieved", "relevant"


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def round_even(c: Column, digits: int) -> Column:
    """Rounding in which a tie goes to the even digit."""
    return F.bround(c.cast("double"), digits)


# --------------------------------------------------------------------------
# precision, recall, F1, accuracy
# --------------------------------------------------------------------------

def match_items(items: DataFrame, normalize: bool = True) -> DataFrame:
    """Outcome (TP, FP, FN) per entry and distinct item key.

    ``items(entry_id, side, item)``. One grouping on (entry, key) replaces a
    full outer join, combines before the shuffle, and spreads an entry with
    very many items over all tasks.
    """
    key = normalize_item(F.col("item")) if normalize else F.col("item")
    mine = F.col("side") == RETRIEVED
    return (
        items.withColumn("key", key)
        .groupBy("entry_id", "key")
        .agg(
            F.min(F.when(mine, F.col("item"))).alias("retrieved_item"),
            F.min(F.when(~mine, F.col("item"))).alias("relevant_item"),
        )
        .withColumn(
            "outcome",
            F.when(F.col("retrieved_item").isNull(), F.lit("FN"))
            .when(F.col("relevant_item").isNull(), F.lit("FP"))
            .otherwise(F.lit("TP")),
        )
    )


def with_metrics(counts: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    scored = counts.withColumns(
        {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)}
    )
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1_score", ratio(F.lit(2.0) * p * r, p + r)).withColumn(
        "accuracy", ratio(tp, tp + fp + fn)
    )


def evaluate(
    items: DataFrame, entries: DataFrame | None = None, normalize: bool = True
) -> DataFrame:
    """Counts and metrics per entry and, micro-averaged, in total.

    The total is the row with ``is_total``. ``entries(entry_id)`` adds entries
    that have no items, which score zero.
    """
    outcome = F.col("outcome")
    per_entry = (
        match_items(items, normalize)
        .groupBy("entry_id")
        .agg(
            *[
                F.count_if(outcome == name).alias(name.lower())
                for name in ("TP", "FP", "FN")
            ]
        )
    )
    if entries is not None:
        per_entry = entries.select("entry_id").join(per_entry, "entry_id", "left").fillna(
            0, ["tp", "fp", "fn"]
        )
    return with_metrics(_with_total(per_entry))


def _with_total(per_entry: DataFrame) -> DataFrame:
    return per_entry.rollup("entry_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")],
        (F.grouping("entry_id") == 1).alias("is_total"),
        F.count(F.lit(1)).alias("n_entries"),
    )


def categorized_errors(items: DataFrame) -> DataFrame:
    """One row per mismatch: textual difference, false positive, false negative."""
    differs = (F.col("outcome") == "TP") & (
        F.col("retrieved_item") != F.col("relevant_item")
    )
    category = (
        F.when(differs, F.lit("matching/normalization"))
        .when(F.col("outcome") == "FP", F.lit("retrieval/extraction false positive"))
        .when(F.col("outcome") == "FN", F.lit("retrieval/chunking false negative"))
    )
    return (
        match_items(items)
        .withColumn("category", category)
        .filter(F.col("category").isNotNull())
        .select(
            "entry_id", "category", "key",
            F.coalesce("retrieved_item", F.lit("")).alias("retrieved_item"),
            F.coalesce("relevant_item", F.lit("")).alias("relevant_item"),
        )
    )


def error_analysis(items: DataFrame) -> DataFrame:
    """Exact and normalized error counts per entry with the likely cause."""

    def counts(normalize: bool, prefix: str) -> DataFrame:
        outcome = F.col("outcome")
        return match_items(items, normalize).groupBy("entry_id").agg(
            F.count_if(outcome == "FP").alias(f"{prefix}_fp"),
            F.count_if(outcome == "FN").alias(f"{prefix}_fn"),
        )

    joined = counts(False, "exact").join(counts(True, "normalized"), "entry_id")
    cause = (
        F.when((F.col("exact_fp") == 0) & (F.col("exact_fn") == 0), F.lit("no_error"))
        .when(
            (F.col("normalized_fp") == 0) & (F.col("normalized_fn") == 0),
            F.lit("matching/normalization"),
        )
        .otherwise(F.lit("retrieval_or_extraction"))
    )
    return joined.withColumn("likely_cause", cause)


def exact_errors(items: DataFrame) -> DataFrame:
    """The items that only one side has, letter by letter."""
    return (
        match_items(items, normalize=False)
        .filter(F.col("outcome") != "TP")
        .select("entry_id", "outcome", F.col("key").alias("item"))
    )


def dedupe_items(items: DataFrame) -> DataFrame:
    """Per entry and key keep the shortest, then first, spelling."""
    return (
        items.withColumn("key", normalize_item(F.col("item")))
        .groupBy("entry_id", "key")
        .agg(F.min(F.struct(F.length("item").alias("n"), "item")).alias("_m"))
        .select("entry_id", "key", F.col("_m.item").alias("item"))
    )


def token_overlap(answer: Column, target: Column) -> Column:
    """Struct of token precision, recall and F1 on distinct words."""
    pair = F.struct(
        clean_words(F.coalesce(answer, F.lit(""))).alias("a"),
        clean_words(F.coalesce(target, F.lit(""))).alias("c"),
    )

    def body(p: Column) -> Column:
        hits = F.size(F.array_intersect(p.a, p.c)).cast("double")
        parts = F.struct(
            ratio(hits, F.size(p.a)).alias("p"), ratio(hits, F.size(p.c)).alias("r")
        )
        return let(
            parts,
            lambda m: F.struct(
                round_even(m.p, 2).alias("token_precision"),
                round_even(m.r, 2).alias("token_recall"),
                round_even(ratio(F.lit(2.0) * m.p * m.r, m.p + m.r), 2).alias("token_f1"),
            ),
        )

    return let(pair, body)


def _as_text(records: DataFrame, name: str) -> Column:
    """A field as text; the texts of a list one after the other."""
    if isinstance(records.schema[name].dataType, T.ArrayType):
        return F.array_join(name, " ", "None")
    return F.col(name).cast("string")


def overlap_target(records: DataFrame) -> Column:
    """The text an answer is compared with: its reference, else its context, else its chunks.

    Each may be absent, text or a list of texts.
    """
    fields = ("reference_answer", "retrieved_context", "source_chunks")
    present = [_as_text(records, name) for name in fields if name in records.columns]
    return F.coalesce(*present, F.lit(""))


def chunk_text(records: DataFrame, name: str = "source_chunks") -> Column:
    """Source chunks as one numbered text; plain text stays as it is."""
    if isinstance(records.schema[name].dataType, T.ArrayType):
        numbered = F.transform(
            name, lambda c, i: F.concat(F.lit("[Chunk "), (i + 1).cast("string"), F.lit("]\n"), F.coalesce(c, F.lit("None")))
        )
        return F.coalesce(F.array_join(numbered, "\n\n"), F.lit(""))
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def judge_texts(records: DataFrame) -> DataFrame:
    """Question, sources and answer of each record without model names."""
    plain = lambda c: redact_models(F.coalesce(c, F.lit("")))
    return records.withColumns({
        "question_text": plain(F.col("question")),
        "source_text": plain(chunk_text(records)),
        "answer_text": plain(F.col("generated_answer")),
    })


# --------------------------------------------------------------------------
# grounding of single items
# --------------------------------------------------------------------------

def _share(found: Column, wanted: Column) -> Column:
    return ratio(
        F.size(F.array_intersect(wanted, found)).cast("double"), F.size(wanted)
    )


def query_score(query_words: Column, candidate: Column) -> Column:
    overlap = F.size(F.array_intersect(query_words, candidate))
    share = F.least(
        overlap / F.least(F.size(query_words), F.lit(4)), F.lit(1.0)
    )
    return (
        F.when(F.size(query_words) == 0, F.lit(1.0))
        .when(overlap == 0, F.lit(0.0))
        .otherwise(round_even(share, 3))
    )


def _decide(d: Column, sources: Column, query: Column, context: Column) -> Column:
    """Decision about one described item, given the described sources of its entry."""
    def with_best(d: Column) -> Column:
        candidates = F.transform(
            context.known,
            lambda s: F.struct(
                _share(s.numbers, d.numbers).alias("number"),
                _share(s.words, d.words).alias("word"),
                F.length(s.text).alias("length"),
                s.text.alias("text"),
                s.words.alias("words"),
            ),
        )
        found = F.struct(
            F.array_max(candidates).alias("b"),
            ((F.size(d.numbers) == 0) | item_has_no_data(d.text)).alias("nothing"),
        )
        return let(found, lambda f: verdict(d, f.b, f.nothing))

    def verdict(d: Column, b: Column, nothing: Column) -> Column:
        number = F.coalesce(b.number, F.lit(0.0))
        word = F.coalesce(b.word, F.lit(0.0))
        best_words = F.coalesce(b.words, F.array().cast("array<string>"))
        covered = F.size(F.array_except(d.numbers, F.flatten(F.transform(sources, lambda s: s.numbers)))) == 0
        asked = query_score(context.w, F.array_union(d.words, best_words))
        support = round_even(
            F.lit(0.75) * number + F.lit(0.25) * F.least(word * 2, F.lit(1.0)), 3
        )

        def category(asked: Column) -> Column:
            return (
                F.when(nothing, F.lit("non_financial_or_no_data_response"))
                .when((number < 1.0) & covered, F.lit("cross_row_or_blended_figure"))
                .when(number < 1.0, F.lit("ungrounded_or_hallucinated_figure"))
                .when(
                    (F.size(d.words) > 0) & (F.size(best_words) > 0)
                    & (F.size(F.array_intersect(d.words, best_words)) == 0),
                    F.lit("wrong_label_or_neighboring_row"),
                )
                .when(context.asks & (asked <= 0), F.lit("query_intent_mismatch"))
                .otherwise(F.lit("grounded_relevant_item"))
            )

        return let(
            let(asked, lambda x: F.struct(category(x).alias("category"), x.alias("asked"))),
            lambda v: F.struct(
                d.text.alias("item"),
                v.category.alias("category"),
                (v.category == "grounded_relevant_item").alias("accepted"),
                F.when(nothing, F.lit("")).otherwise(F.coalesce(b.text, F.lit(""))).alias("source_chunk"),
                F.when(nothing, F.lit(0.0)).otherwise(support).alias("support_score"),
                F.when(
                    v.category.isin("grounded_relevant_item", "query_intent_mismatch"), v.asked
                ).otherwise(F.lit(0.0)).alias("query_score"),
            ),
        )

    return with_best(d)


def _decisions(items: Column, sources: Column, query: Column) -> Column:
    """Decision per described item, beside the described sources."""
    # what all items of an entry are held against is computed once
    context = F.struct(
        F.filter(sources, lambda s: F.size(s.numbers) > 0).alias("known"),
        meaningful_words(query).alias("w"), (strip(query) != "").alias("asks"),
    )
    return let(context, lambda c: F.transform(items, lambda d: _decide(d, sources, query, c)))


def grounding_decisions(items: Column, sources: Column, query: Column) -> Column:
    """Decision per answer item of an entry, from arrays in the entry's row.

    Every item is compared with the entry's sources inside the row, keeping
    the best; no pairs leave the row and nothing is shuffled.
    """
    described = F.struct(F.transform(items, describe).alias("d"), F.transform(sources, describe).alias("s"))
    return let(described, lambda e: _decisions(e.d, e.s, query))


def _is_supported(m: Column, known: Column, part=lambda s: s) -> Column:
    """Whether one of the described sources holds an item's figures and fits it."""
    return (F.size(m.numbers) > 0) & F.exists(
        known,
        lambda s: (F.size(F.array_except(m.numbers, part(s).numbers)) == 0)
        & (F.arrays_overlap(m.words, part(s).words) | (F.size(m.numbers) >= 2)),
    )


def supported_items(items: Column, sources: Column) -> Column:
    """Items whose figures all occur in one source item that also shares a word
    (or when the item has two or more figures)."""
    described = F.transform(sources, describe_plain)
    return let(
        described,
        lambda known: F.filter(items, lambda item: let(describe_plain(item), lambda m: _is_supported(m, known))),
    )


def keyed(items: Column) -> Column:
    """Items with their length and key, as :func:`dedupe_keyed` takes them."""
    return F.transform(
        items, lambda i: F.struct(F.length(i).alias("n"), i.alias("item"), normalize_item(i).alias("key"))
    )


def dedupe_keyed(items: Column) -> Column:
    """The shortest, then first, of the items under each key, in this order."""
    return let(
        F.sort_array(items),
        lambda ks: F.filter(ks, lambda k, at: ~F.exists(F.slice(ks, F.lit(1), at), lambda q: q.key == k.key)),
    )


def dedupe_array(items: Column) -> Column:
    """Array form of :func:`dedupe_items` for the items of one entry."""
    return dedupe_keyed(keyed(items))["item"]


def parsed_entries(
    entries: DataFrame,
    retrieved_key: str | None = None,
    relevant_key: str | None = None,
) -> DataFrame:
    """Evaluable chat entries with the items of their three sides as arrays.

    ``entries(entry_id, entry_json)``. ``is_explicit`` tells that the entry
    brings a reference side of its own (``reference_items``), which is not a
    mere copy of its source texts. Each entry is parsed once, in its row.

    Rows of :func:`plain_entries.read_entries` that are told already pass by,
    with what was told; in them the other columns are null.
    """
    fields = F.col("_f")
    explicit = F.col("is_explicit")
    past = [c for c in entries.columns if c.startswith("told")]
    told = F.col("told") if past else F.lit(False)
    parsed = settle(entries.select("entry_id", "entry_json", *past), _f=J.parse_object(F.col("entry_json")))
    parsed = settle(
        parsed.filter(told | (fields.isNotNull() & J.has_field(fields, retrieved_key, C.RETRIEVED_FIELDS))),
        question=F.coalesce(J.variant_text(F.try_element_at(fields, F.lit("question"))), F.lit("")),
        _retrieved=J.field_by_alias(fields, retrieved_key, C.RETRIEVED_FIELDS),
        _source=J.field_by_alias(fields, None, C.SOURCE_FIELDS),
        _relevant=J.field_by_alias(fields, relevant_key, C.EXPLICIT_RELEVANT_FIELDS),
        _has_source=J.has_field(fields, None, C.SOURCE_FIELDS),
        _has_relevant=J.has_field(fields, relevant_key, C.EXPLICIT_RELEVANT_FIELDS),
    )
    repeats = F.lit(False) if relevant_key is not None else (
        F.col("_has_source") & F.to_json("_relevant").eqNullSafe(F.to_json("_source"))
    )
    sides = F.array(
        F.col("_retrieved"),
        F.when(~explicit, F.col("_source")),
        F.when(explicit, F.col("_relevant")),
    )
    items = F.col("_items")
    return settle(
        settle(parsed, is_explicit=F.col("_has_relevant") & ~repeats).filter(
            told | explicit | F.col("_has_source")
        ),
        _items=F.when(~told, F.transform(sides, J.item_set)),
        source_texts=F.when(~told, J.raw_texts(F.when(~explicit, F.col("_source")))),
    ).select(
        "entry_id", "question", "is_explicit",
        items[0].alias("original_retrieved"), items[1].alias("source_items"), "source_texts",
        items[2].alias("reference_items"), *past,
    )


def history_records(
    entries: DataFrame,
    *,
    retrieved_key: str | None = None,
    relevant_key: str | None = None,
    apply_filter: bool = True,
) -> DataFrame:
    """Retrieved and relevant items of each evaluable chat entry.

    An explicit reference side is used as it is. Without one, the relevant
    side is what the sources support, and the retrieved side (with the filter
    on) is what grounding accepts.
    """
    read = P.read_entries(entries, P.record, P.RECORD, retrieved_key, relevant_key, apply_filter)
    records = _keyed_records(read, retrieved_key, relevant_key, apply_filter)
    same = ("question", "original_retrieved", "source_items", "source_texts")
    return records.select(
        "entry_id", *[_told(name, F.col(name)) for name in same],
        _told(RETRIEVED, F.col("_kept.item")), _told(RELEVANT, F.col("_right.item")),
        (~_told("explicit", F.col("is_explicit")) & F.lit(apply_filter)).alias("precision_filter_applied"),
    )


def _told(name: str, otherwise: Column) -> Column:
    """What was told of an entry in plain Python, else what the expressions say of it."""
    return F.when(F.col("told"), F.col(f"told_{name}")).otherwise(otherwise).alias(name)


def _keyed_records(
    entries: DataFrame, retrieved_key: str | None = None, relevant_key: str | None = None,
    apply_filter: bool = True, decide_all: bool = False,
) -> DataFrame:
    """Parsed entries with both sides, ``_kept`` and ``_right``, as arrays of :func:`keyed` items.

    Every text of an entry is described once and every item gets its key once;
    grounding, support, dedupe and counts compare these. ``_d`` holds the
    decisions about ``_keyed``; with ``decide_all`` also where a reference side
    of its own makes them needless. Rows that are told already pass by.
    """
    explicit = F.col("is_explicit")
    left = ~F.col("told")
    wanted = left if decide_all else ~explicit
    described = settle(
        parsed_entries(entries, retrieved_key, relevant_key),
        _keyed=F.when(left, keyed(F.col("original_retrieved"))),
        _items=F.when(wanted, F.transform("original_retrieved", describe_both)),
        _sources=F.when(wanted, F.transform("source_items", describe_both)),
    )
    supported = F.filter(
        "_keyed",
        lambda k, at: let(
            F.get(F.col("_items"), at).plain, lambda m: _is_supported(m, F.col("_sources"), lambda s: s.plain)
        ),
    )
    judged = {"_supported": F.when(~explicit, supported)}
    if apply_filter or decide_all:
        judged["_d"] = F.when(wanted, _decisions(F.col("_items"), F.col("_sources"), F.col("question")))
    records = settle(described, **judged)
    kept, supported = F.col("_keyed"), F.col("_supported")
    if apply_filter:
        accepted = F.filter("_keyed", lambda k, at: F.get(F.col("_d"), at).accepted)
        kept, supported = dedupe_keyed(F.when(explicit, kept).otherwise(accepted)), dedupe_keyed(supported)
    right = F.when(explicit, keyed(F.col("reference_items"))).otherwise(supported)
    return settle(records, _kept=F.when(left, kept), _right=F.when(left, right))


def record_items(records: DataFrame) -> DataFrame:
    """Long form ``(entry_id, side, item)`` of records with item arrays."""
    sides = F.array(
        *[
            F.struct(F.lit(side).alias("side"), F.col(side).alias("items"))
            for side in (RETRIEVED, RELEVANT)
        ]
    )
    return records.select("entry_id", F.inline(sides)).select(
        "entry_id", "side", F.explode("items").alias("item")
    )


def evaluate_records(records: DataFrame, normalize: bool = True) -> DataFrame:
    """Like :func:`evaluate`, for records that hold both sides as arrays.

    Each record is counted in its row; only the counts are aggregated.
    """
    keys = lambda items: F.transform(items, normalize_item) if normalize else items
    counted = settle(records, _r=keys(F.col(RETRIEVED)), _v=keys(F.col(RELEVANT)))
    return with_metrics(_with_total(counted.select("entry_id", *_counts(F.col("_r"), F.col("_v")))))


def _counts(r: Column, v: Column) -> list[Column]:
    """Counts of a record from the keys of both its sides."""
    both = {"tp": F.array_intersect(r, v), "fp": F.array_except(r, v), "fn": F.array_except(v, r)}
    return [F.size(found).cast("long").alias(name) for name, found in both.items()]


def evaluate_history(entries: DataFrame, normalize: bool = True, **options) -> DataFrame:
    """Like :func:`evaluate_records` of :func:`history_records`; each entry is counted where it is read."""
    key = "key" if normalize else "item"
    records = _keyed_records(P.read_entries(entries, P.counts(normalize), P.COUNTS, **options), **options)
    counted = zip(("tp", "fp", "fn"), _counts(F.col(f"_kept.{key}"), F.col(f"_right.{key}")))
    return with_metrics(_with_total(records.select("entry_id", *[_told(name, count) for name, count in counted])))


def jsonl_pairs(
    entries: DataFrame, retrieved_key: str | None = None, relevant_key: str | None = None
) -> DataFrame:
    """Item arrays of JSON records that carry both sides."""
    fields = F.col("_f")
    return (
        settle(entries.select("entry_id", "entry_json"), _f=J.parse_object(F.col("entry_json")))
        .filter(
            J.has_field(fields, retrieved_key, C.RETRIEVED_FIELDS)
            & J.has_field(fields, relevant_key, C.RELEVANT_FIELDS)
        )
        .select(
            "entry_id",
            J.item_set(J.field_by_alias(fields, retrieved_key, C.RETRIEVED_FIELDS)).alias(RETRIEVED),
            J.item_set(J.field_by_alias(fields, relevant_key, C.RELEVANT_FIELDS)).alias(RELEVANT),
        )
    )


def false_positives(entries: DataFrame) -> DataFrame:
    """Every unsupported item of the unfiltered records, with its category.

    The filter's verdict comes from the same decisions, so the entries are
    read once.
    """
    how = {"apply_filter": False, "decide_all": True}
    records = _keyed_records(P.read_entries(entries, P.wrong, P.WRONG, **how), **how)
    pairs = F.zip_with(
        "_d", "_keyed", lambda d, k: F.struct(k["item"].alias("item"), k.key.alias("key"), d.alias("d"))
    )
    judged = F.when(~F.col("told"), F.sort_array(pairs))
    # an explicit reference side is not filtered: all its items are kept
    unfiltered = F.size("source_texts") == 0

    def row(j: Column, at: Column) -> Column:
        mismatch = unfiltered | F.array_contains("_kept_keys", j.key)
        return F.struct(
            F.col("question"),
            (at + 1).cast("long").alias("rank"),
            F.when(mismatch, F.lit(P.MISMATCH)).otherwise(j.d.category).alias("category"),
            j["item"].alias("retrieved_item"),
            j.d.source_chunk.alias("source_chunk"),
            j.d.support_score.alias("support_score"),
            j.d.query_score.alias("query_score"),
            j.key.alias("key"),
        )

    kept = F.filter("_judged", lambda j: j.d.accepted)["key"]
    found = F.filter(
        F.transform("_judged", row), lambda r: ~F.array_contains(F.col("_right.key"), r.key)
    )
    # what is told has a row of its own for each item
    names = [f.name for f in T._parse_datatype_string(P.WRONG).fields]
    one = F.array(F.struct(*[F.col(f"told_{name}").alias(name) for name in names], F.lit("").alias("key")))
    rows = settle(settle(records, _judged=judged), _kept_keys=kept)
    return rows.select("entry_id", F.inline(F.when(F.col("told"), one).otherwise(found))).drop("key")


def false_positive_report(entries: DataFrame) -> DataFrame:
    """Count per category, and in total where ``category`` is NULL."""
    return false_positives(entries).rollup("category").agg(
        F.count(F.lit(1)).alias("n_items")
    )


def rank_items(items: DataFrame) -> DataFrame:
    """1-based rank of each item within its entry and side, however many
    items an entry has."""
    return number_rows(items, ["entry_id", "side"], ["item"], row="rank")


# --------------------------------------------------------------------------
# judge replies
# --------------------------------------------------------------------------

def validate_judge(responses: DataFrame, raw: str = "raw_response") -> DataFrame:
    """Scores of valid judge replies; others keep their row as ``judge_failed``.

    Valid: exactly the seven keys, integers 1-5, overall 1.0-5.0, a list of
    strings, and a rationale of at most 1000 characters.
    """
    fields = J.parse_object(F.col(raw))

    def field(name: str) -> Column:
        return F.try_element_at("_f", F.lit(name))

    def kind(name: str) -> Column:
        return F.schema_of_variant(field(name))

    exact = F.array_sort(F.map_keys("_f")) == F.array(
        *[F.lit(k) for k in sorted(C.JUDGE_FIELDS)]
    )
    valid = exact
    for name in C.JUDGE_INT_FIELDS:
        valid = valid & (kind(name) == "BIGINT") & field(name).try_cast("long").between(1, 5)
    valid = (
        valid
        & kind("overall").rlike("^(?:BIGINT|DECIMAL.*|DOUBLE|FLOAT)$")
        & field("overall").try_cast("double").between(1.0, 5.0)
        & kind("unsupported_claims").isin("ARRAY<STRING>", "ARRAY<VOID>")
        & (kind("rationale") == "STRING")
        & (F.length(field("rationale").try_cast("string")) <= C.JUDGE_MAX_RATIONALE)
    )
    checked = settle(settle(responses, _f=fields), _ok=F.coalesce(valid, F.lit(False)))
    ok = F.col("_ok")
    return checked.select(
        *responses.columns,
        F.when(ok, F.lit("ok")).otherwise(F.lit("judge_failed")).alias("judge_status"),
        *[F.when(ok, field(f).try_cast("long")).alias(f) for f in C.JUDGE_INT_FIELDS],
        F.when(ok, field("overall").try_cast("double")).alias("overall"),
        F.when(ok, field("unsupported_claims").try_cast("array<string>")).alias("unsupported_claims"),
        F.when(ok, field("rationale").try_cast("string")).alias("rationale"),
    )


def judge_means(rows: DataFrame, group_by: str = "model") -> DataFrame:
    return (
        rows.filter(F.col("judge_status") == "ok")
        .groupBy(F.coalesce(F.col(group_by), F.lit("unknown")).alias(group_by))
        .agg(
            F.count(F.lit(1)).alias("judge_rows"),
            *[
                round_even(F.avg(F.col(f).cast("double")), 3).alias(f)
                for f in C.JUDGE_MEAN_FIELDS
            ],
        )
    )
