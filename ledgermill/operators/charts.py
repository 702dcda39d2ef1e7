"""The data behind charts and the choice of chart type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import contains_any, is_blank, is_time_label, last_wins, let, normalize_arabic, strip
from .routing import asks_improvement


def first_per_label(series: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep the first row per label; combines before the shuffle."""
    others = [c for c in series.columns if c not in keys + [order]]
    return (
        series.groupBy(*keys)
        .agg(F.min_by(F.struct(*others), order).alias("_v") if others else F.min(order), F.min(order).alias(order))
        .select(*keys, order, "_v.*")
    )


def extract_improvements(docs: DataFrame, keys: list[str] | None = None, order: str = "doc_id") -> DataFrame:
    """``dimension: X`` and ``improvement rate: +N%`` from row texts."""
    keys = keys or []
    label = strip(
        F.regexp_extract(
            "content", r"(?i)(?:البُعد\s+المقاس|measured\s+dimension|dimension)\s*:\s*([^|\n]+)", 1
        )
    )
    value = F.regexp_extract(
        "content",
        r"(?i)(?:نسبة\s+التحس[\u064B-\u065F]*ن|improvement\s+(?:rate|percentage))"
        r"\s*:\s*\+?(-?[0-9,]+(?:\.[0-9]+)?)\s*%",
        1,
    )
    rows = docs.select(
        *keys, order, label.alias("label"),
        F.regexp_replace(value, ",", "").try_cast("double").alias("value"),
        F.lit("%").alias("currency"),
    ).filter((F.col("label") != "") & F.col("value").isNotNull())
    return first_per_label(rows, [*keys, "label"], order)


def clean_series(replies: DataFrame, reply: str = "reply", keys: list[str] | None = None) -> DataFrame:
    """Rows of a model's JSON list of ``{label, value, currency, suggestion}``.

    Key names are trimmed and lower-cased; ``name``/``description`` and
    ``amount`` stand in for label and value; rows without a number are
    dropped; the first row per label is kept.
    """
    keys = keys or ["query_id"]
    body = F.replace(F.regexp_replace(reply, r"```(?:json)?\s*", ""), F.lit("```"), F.lit(""))
    items = F.from_json(strip(body), "array<map<string,string>>")
    rows = replies.select(*keys, F.posexplode(items).alias("pos", "_raw")).filter(
        F.col("_raw").isNotNull()
    ).withColumn(
        "_m",
        last_wins(
            F.filter(
                F.transform(
                    F.map_entries("_raw"),
                    lambda e: F.struct(F.lower(strip(e.key)).alias("key"), e.value.alias("value")),
                ),
                lambda e: e.key.isin("label", "name", "description", "value", "amount", "currency", "suggestion"),
            )
        ),
    )

    def field(*names: str) -> Column:
        return F.coalesce(
            *[F.when(F.try_element_at("_m", F.lit(n)) != "", F.try_element_at("_m", F.lit(n))) for n in names]
        )

    rows = rows.select(
        *keys, "pos",
        field("label", "name", "description").alias("label"),
        strip(F.regexp_replace(field("value", "amount"), r"[,$]", "")).try_cast("double").alias("value"),
        F.coalesce(field("currency"), F.lit("SAR")).alias("currency"),
        F.coalesce(field("suggestion"), F.lit("No specific advice")).alias("suggestion"),
    ).filter(F.col("label").isNotNull() & F.col("value").isNotNull())
    return first_per_label(rows, [*keys, "label"], "pos")


def clean_amount(c: Column) -> Column:
    """Number in a cell after removing separators, symbols and scale words
    (which are not applied)."""
    text = F.regexp_replace(strip(c), r"[,﷼$ ]", "")
    text = F.regexp_replace(text, r"(?i)billion|million|trillion|bn|mn|tn|مليار|مليون", "")
    return strip(text).try_cast("double")


def clean_rows(series: DataFrame, keys: list[str] | None = None, order: str = "pos") -> DataFrame:
    """Labelled raw cells -> numeric rows, first row per label."""
    keys = keys or ["query_id"]
    rows = series.select(
        *keys, order, strip(F.col("label")).alias("label"), clean_amount(F.col("value")).alias("value")
    ).filter(~is_blank(F.col("label")) & F.col("value").isNotNull())
    return first_per_label(rows, [*keys, "label"], order)


def chart_shape(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Shape of each series: sizes, time-like labels, non-numbers, negatives."""
    keys = keys or ["query_id"]
    named = F.col("label").isNotNull()
    shape = series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.count_if(named).alias("n_labels"),
        F.count_if(named & is_time_label(strip(F.col("label").cast("string")))).alias("n_time"),
        F.coalesce(F.max(F.col("value").isNull()), F.lit(False)).alias("has_gaps"),
        F.coalesce(F.max(F.col("value") < 0), F.lit(False)).alias("has_negatives"),
    )
    needed = F.greatest(F.lit(2), F.ceil(F.col("n_labels") * F.lit(0.5)))
    return shape.withColumn(
        "is_time_series", (F.col("n_labels") >= 2) & (F.col("n_time") >= needed)
    )


def fallback_chart(text: Column, n_points: Column) -> Column:
    t = F.lower(text)
    return (
        F.when(asks_improvement(text), F.lit("bar"))
        .when(contains_any(t, C.AREA_WORDS), F.lit("area"))
        .when(contains_any(t, C.PIE_WORDS), F.lit("pie"))
        .when(contains_any(t, C.LINE_WORDS), F.lit("line"))
        .when(contains_any(t, C.BAR_WORDS), F.lit("bar"))
        .when(contains_any(t, C.TREND_WORDS), F.lit("line"))
        .when(
            contains_any(t, C.COMPARE_WORDS),
            F.when(n_points <= C.PIE_MAX_SLICES, F.lit("pie")).otherwise(F.lit("bar")),
        )
        .otherwise(F.lit("bar"))
    )


def recommend_chart(shapes: DataFrame, text: str = "text", chosen: str | None = None) -> DataFrame:
    """Chart type per series: the given choice, or one from the question's
    words, then guarded by the shape of the data."""
    fallback = fallback_chart(F.col(text), F.col("n_points"))
    wanted = fallback
    if chosen:
        wanted = F.when(F.col(chosen).isin("bar", "line", "pie", "area"), F.col(chosen)).otherwise(fallback)
    pie_ok = (
        contains_any(normalize_arabic(F.lower(F.col(text))), C.PIE_INTENT_WORDS)
        & F.col("n_points").between(2, C.PIE_MAX_SLICES)
        & ~F.col("is_time_series") & ~F.col("has_gaps") & ~F.col("has_negatives")
    )
    guarded = let(
        wanted,
        lambda w: F.when(asks_improvement(F.col(text)), F.lit("bar"))
        .when(w.isin("line", "area") & ~F.col("is_time_series"), F.lit("bar"))
        .when((w == "pie") & ~pie_ok, F.lit("bar"))
        .otherwise(w),
    )
    return shapes.withColumn("chart_type", guarded)


def chart_preview(series: DataFrame, order: str = "pos") -> DataFrame:
    return series.filter(F.col(order) < C.CHART_PREVIEW_ROWS)
