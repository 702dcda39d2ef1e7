"""Reading loosely structured JSON entries with VARIANT expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import text_items
from .text import let, strip_text


def parse_object(json: Column) -> Column:
    """JSON object -> MAP<STRING, VARIANT>; anything else -> NULL."""
    return let(
        F.try_parse_json(json),
        lambda v: F.when(
            F.schema_of_variant(v).startswith("OBJECT"), v.cast("map<string,variant>")
        ),
    )


def field_by_alias(fields: Column, preferred: str | None, aliases) -> Column:
    """Value of the preferred key, else of the first alias that is present.

    A key that is present with JSON null is found (its value is a VARIANT
    null); NULL means that no key is present.
    """
    names = (preferred,) if preferred is not None else tuple(aliases)
    found = F.lit(None).cast("variant")
    for name in reversed(names):
        found = F.when(
            F.map_contains_key(fields, name), F.try_element_at(fields, F.lit(name))
        ).otherwise(found)
    return found


def has_field(fields: Column, preferred: str | None, aliases) -> Column:
    names = (preferred,) if preferred is not None else tuple(aliases)
    return F.arrays_overlap(
        F.map_keys(fields), F.array(*[F.lit(n) for n in names])
    )


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def variant_text(v: Column) -> Column:
    """Text of a JSON value; null and booleans read None, True, False."""
    return let(v, lambda value: let(_kind(value), lambda kind: _text(value, kind)))


def _text(v: Column, kind: Column) -> Column:
    return (
        F.when(kind == "STRING", strip_text(v.cast("string")))
        .when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(F.to_json(v)))
        .otherwise(F.to_json(v))
    )


def nesting(json: Column) -> Column:
    """How many lists of a JSON text lie inside each other at most."""
    bare = F.regexp_replace(F.regexp_replace(json, r"\\.", ""), r'"[^"]*"', "")
    brackets = F.split(F.regexp_replace(bare, r"[^\[\]]+", ""), "")

    def follow(at: Column, bracket: Column) -> Column:
        depth = at["depth"] + F.when(bracket == "[", 1).when(bracket == "]", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.greatest(at["most"], depth).alias("most"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most"))
    return F.aggregate(brackets, start, follow, lambda at: at["most"])


def leaves(v: Column) -> Column:
    """Non-list values of a JSON value in order, lists flattened, nulls dropped.

    Each step opens the outermost lists, as often as the value's own nesting
    asks for, so no depth is too deep.
    """

    def opened(value: Column) -> Column:
        # what is no list has no elements; that is told without looking at what a list holds
        elements = F.coalesce(value.try_cast("array<variant>"), F.array(value))
        return F.when(
            value.isNull() | F.is_variant_null(value), F.array().cast("array<variant>")
        ).otherwise(elements)

    def depth(value: Column) -> Column:
        # elements of one kind name it; only mixed ones are followed bracket by bracket
        named = F.length(F.regexp_extract(_kind(value), "^(?:ARRAY<)*", 0)) / F.lit(len("ARRAY<"))
        return F.when(_kind(value).contains("ARRAY<VARIANT"), nesting(F.to_json(value))).otherwise(named.cast("int"))

    def body(value: Column) -> Column:
        lists = F.when(value.try_cast("array<variant>").isNotNull(), depth(value)).otherwise(0)
        return F.aggregate(
            F.sequence(F.lit(0), lists), F.array(value),
            lambda found, _: F.flatten(F.transform(found, opened)),
        )

    return let(v, body)


def item_set(v: Column) -> Column:
    """Distinct items of a JSON value.

    null -> none; object -> ``key: value`` per key; list -> the items of its
    elements; longer text -> its numeric clauses, else the text itself.
    """

    def items(value: Column) -> Column:
        def of_kind(kind: Column) -> Column:
            return F.when(
                kind.startswith("OBJECT"),
                F.transform(
                    F.map_entries(value.cast("map<string,variant>")),
                    lambda e: F.concat(e.key, F.lit(": "), variant_text(e.value)),
                ),
            ).otherwise(text_items(_text(value, kind)))

        return let(_kind(value), of_kind)

    return F.array_distinct(F.flatten(F.transform(leaves(v), items)))


def raw_texts(v: Column) -> Column:
    """Source texts of a JSON value in order, lists flattened."""
    return F.filter(F.transform(leaves(v), variant_text), lambda t: t != "")
