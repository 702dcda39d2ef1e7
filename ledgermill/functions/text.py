"""Text expressions: every function takes a Column and returns a Column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C

# Letters, digits and underscore in any script. Java's \w is ASCII only, so
# word boundaries are written with this class.
WORD = r"\p{L}\p{N}_"
DIACRITICS = r"[\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06ED]"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times inside ``body``.

    An aggregation over nothing: unlike elements of a transformed array, neither
    its start nor its end is copied, however many of these lie in each other.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, here.

    A plain projection may be merged into later filters and projections, which
    would parse or tokenize the same text several times, or before a
    repartition; the output of a generator may not.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline_outer(F.array(row)))


def plain_spaces(c: Column) -> Column:
    return F.translate(c, "\u00a0\u202f", "  ")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_ascii(c: Column) -> Column:
    """Whether a text has as many bytes as characters."""
    return F.octet_length(c) == F.char_length(c)


def strip_ascii(c: Column) -> Column:
    """:func:`strip` of an ASCII text, without a pattern."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def strip_text(c: Column) -> Column:
    """:func:`strip`; an ASCII text, which most are, goes without the pattern."""
    return let(c, lambda t: F.when(is_ascii(t), strip_ascii(t)).otherwise(strip(t)))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"\S")


def ascii_digits(c: Column) -> Column:
    return F.translate(c, C.ARABIC_DIGITS, C.ASCII_DIGITS)


def words_of(c: Column) -> Column:
    """Non-empty pieces between whitespace."""
    return matches(c, r"\S+")


def matches(c: Column, pattern: str) -> Column:
    """All matches. Unlike a split, this compiles its pattern only once."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


# U+FFFF is no character, so texts do not hold it.
CUT = "\uffff"


def split_at(c: Column, pattern: str) -> Column:
    """Pieces between matches; the pattern is compiled once, not per row."""
    return F.split(F.regexp_replace(c, pattern, CUT), CUT, -1)


def contains_any(c: Column, phrases) -> Column:
    """True when any phrase occurs as a substring."""
    alternatives = "|".join(_literal(p) for p in phrases)
    return c.rlike(f"(?:{alternatives})")


def _literal(phrase: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?{}[]\|()" else ch for ch in phrase)


def replace_matches(c: Column, pattern: str, replacement: str) -> Column:
    """Replace each match of ``pattern`` by a SQL lambda ``m -> …`` of it."""
    return let(
        c,
        lambda t: F.array_join(
            F.zip_with(
                split_at(t, pattern),
                F.concat(
                    F.call_function("transform", matches(t, pattern), F.expr(replacement)),
                    F.array(F.lit("")),
                ),
                lambda gap, new: F.concat(gap, new),
            ),
            "",
        ),
    )


# --------------------------------------------------------------------------
# tokens for lexical search
# --------------------------------------------------------------------------

def _scaled(factor: int) -> str:
    """SQL lambda: ``12.5 million`` -> `` 12500000 ``.

    Results that are not whole are written with six significant digits. A
    double is an integer over a power of two, so rounding (half to even) is
    decided exactly, on integers.
    """
    places = " ".join(f"WHEN d >= 1e{p}D THEN {5 - p}" for p in range(5, -4, -1))
    digits = (
        "lpad(CAST(CAST((n - n % base) / base AS DECIMAL(18,0)) + IF(n % base * 2 > base OR (n % base * 2 = base"
        " AND CAST((n - n % base) / base AS DECIMAL(18,0)) % 2 = 1), 1, 0) AS STRING),"
        " greatest(length(CAST(CAST((n - n % base) / base AS DECIMAL(18,0)) AS STRING)), places + 1), '0')"
    ).replace("base", "s.base").replace("places", "s.places").replace("n %", "s.n %").replace("(n -", "(s.n -")
    return rf"""m -> transform(
      transform(array(CAST(replace(regexp_extract(m, '^([0-9][0-9,]*(?:[.][0-9]+)?)', 1), ',', '') AS DOUBLE) * {factor}D),
        d -> CASE
          WHEN d = floor(d) AND d < 1e37D THEN CAST(CAST(d AS DECIMAL(38,0)) AS STRING)
          WHEN d >= 1e6D OR d < 1e-4D THEN regexp_replace(format_string('%.5e', d), '[.]?0+e', 'e')
          ELSE transform(transform(transform(
            array(named_struct('d', d, 'places', CASE {places} ELSE 9 END)),
            p -> named_struct('d', p.d, 'places', p.places, 'two', pow(2D, 52 - floor((5 - p.places) * {math.log2(10)}D)))),
            p -> named_struct('places', p.places, 'base', CAST(p.two AS DECIMAL(20,0)),
              'n', CAST(CAST(p.d * p.two AS DECIMAL(18,0)) * CAST(pow(10D, p.places) AS DECIMAL(11,0)) AS DECIMAL(38,0)))),
            s -> transform(array({digits}), g -> regexp_replace(
              concat(substring(g, 1, length(g) - s.places), '.', substring(g, length(g) - s.places + 1)), '[.]?0*$', ''))[0])[0]
        END),
      x -> concat(' ', x, ' '))[0]"""


def _scale_words(c: Column, units: str, factor: int) -> Column:
    pattern = (
        rf"(?i)(?<![{WORD}])[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:{units})(?![{WORD}])"
    )
    return let(
        c,
        lambda t: F.when(
            t.rlike(pattern), replace_matches(t, pattern, _scaled(factor))
        ).otherwise(t),
    )


# No-break spaces become spaces, Arabic digits ASCII ones; the diacritics have
# no counterpart and are dropped.
_TOKEN_FROM = "\u00a0\u202f" + C.ARABIC_DIGITS + "".join(map(chr, range(0x64B, 0x660))) + "\u0670"
_TOKEN_TO = "  " + C.ASCII_DIGITS


def tokenize(c: Column) -> Column:
    """Lexical-search tokens. Purely numeric tokens are listed twice, so that
    figures weigh double in term frequency and document length."""

    def scaled(t: Column) -> Column:
        for units, factor in (("million|mn|m", 10**6), ("billion|bn|b", 10**9), ("thousand|k", 1000)):
            t = _scale_words(t, units, factor)
        return t

    def tokens(t: Column) -> Column:
        words = matches(F.lower(t), rf"[{WORD}]+")
        figures = matches(t, rf"(?<![{WORD}])[0-9]+(?![{WORD}])")
        return F.when(t.rlike("[0-9]"), F.concat(words, figures)).otherwise(words)

    # ASCII texts hold none of these characters
    text = let(c, lambda t: F.when(is_ascii(t), t).otherwise(F.translate(t, _TOKEN_FROM, _TOKEN_TO)))
    return let(
        let(text, lambda t: F.when(t.rlike("[0-9]"), scaled(t)).otherwise(t)), tokens
    )


# --------------------------------------------------------------------------
# answers and questions
# --------------------------------------------------------------------------

def normalize_arabic(c: Column) -> Column:
    """Without diacritics and the stretching mark (U+0640)."""
    return F.regexp_replace(c, DIACRITICS[:-1] + r"\u0640]", "")


def has_digit(c: Column) -> Column:
    return c.rlike(r"[0-9\u0660-\u0669]")


def strip_answer(c: Column) -> Column:
    """Drop fenced code, straighten quotes and squeeze blank lines; an answer
    that would become empty is kept as it was."""
    cleaned = F.regexp_replace(c, r"(?i)```(?:json)?\s*[\s\S]*?```", "")
    cleaned = F.translate(cleaned, "“”‘’", "\"\"''")
    cleaned = strip(F.regexp_replace(cleaned, r"\n{3,}", "\n\n"))
    return let(cleaned, lambda t: F.when(t != "", t).otherwise(strip(c)))


def strip_legacy_notes(c: Column) -> Column:
    """Drop the caution note that older answers carried at their end."""
    cleaned = F.regexp_replace(
        c, r"(?is)\n*\s*---\s*\n\s*\*\*Note:\*\*\s*.*?appropriate caution\.?", ""
    )
    cleaned = F.regexp_replace(
        cleaned, r"(?s)\n*\s*---\s*\n\s*\*\*ملاحظة:\*\*\s*.*?الحذر المناسب\.?", ""
    )
    return strip(F.coalesce(cleaned, F.lit("")))


def redact_models(c: Column) -> Column:
    return F.regexp_replace(
        F.coalesce(c, F.lit("")),
        rf"(?i)(?<![{WORD}])(?:{C.MODEL_NAMES_PATTERN})(?![{WORD}])",
        C.REDACTED_MODEL,
    )


def answer_language(c: Column) -> Column:
    arabic = F.length(F.regexp_replace(c, r"[^\u0600-\u06FF]", ""))
    latin = F.length(F.regexp_replace(c, r"[^A-Za-z]", ""))
    return F.when((arabic > 0) & (arabic >= latin), F.lit("Arabic")).otherwise(
        F.lit("English")
    )


def answer_has_no_data(c: Column) -> Column:
    return contains_any(F.lower(F.coalesce(c, F.lit(""))), C.NO_DATA_ANSWER_PHRASES)


def item_has_no_data(c: Column) -> Column:
    return contains_any(F.lower(c), C.NO_DATA_ITEM_PHRASES)


def is_time_label(c: Column) -> Column:
    lead, tail = rf"(?<![{WORD}])", rf"(?![{WORD}])"
    text = normalize_arabic(F.lower(c))
    return let(
        text,
        lambda t: t.rlike(
            lead + r"(?:q[1-4]|qtr\s*[1-4]|quarter\s*[1-4]|fy\s*[0-9]{2,4})" + tail
        )
        | t.rlike(lead + r"(?:19|20)[0-9]{2}" + tail)
        | t.rlike(lead + r"[0-9]{1,2}[/-][0-9]{1,2}(?:[/-][0-9]{2,4})?" + tail)
        | contains_any(t, C.TIME_LABEL_WORDS),
    )


def clean_words(c: Column) -> Column:
    """Lower-cased words without punctuation, as a distinct array."""
    return F.array_distinct(matches(F.lower(c), rf"[{WORD}]+"))


def last_wins(pairs: Column) -> Column:
    """Map from pairs in which a later pair replaces an earlier one."""
    return F.map_from_entries(
        F.filter(
            pairs,
            lambda p, i: ~F.exists(
                F.slice(pairs, i + 2, F.size(pairs)), lambda q: q.key == p.key
            ),
        )
    )
