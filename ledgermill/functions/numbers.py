"""Canonical figures and financial items as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .text import (
    CUT,
    DIACRITICS,
    WORD,
    ascii_digits,
    item_has_no_data,
    is_ascii,
    let,
    matches,
    plain_spaces,
    split_at,
    squeeze,
    strip,
    strip_ascii,
    strip_text,
)

#: A figure in a prepared, hence lower-cased text.
NUMBER = rf"\(?[-+]?\d[\d,]*(?:\.\d+)?\)?(?:\s*(?:{C.NUMBER_UNITS}))?"


def _with_currencies(text: Column, ignored: str = "") -> Column:
    for symbol, word in C.CURRENCY_WORDS:
        if symbol != ignored:
            text = F.replace(text, F.lit(symbol), F.lit(word))
    return text


def _in_ascii(text: Column) -> Column:
    """The part of both preparations that concerns ASCII texts."""
    return F.replace(strip_ascii(F.lower(text)), F.lit("$"), F.lit(dict(C.CURRENCY_WORDS)["$"]))


def prepare(c: Column) -> Column:
    """Lower case, ASCII digits, currency words; without diacritics and made-up column names.

    Most steps concern characters outside ASCII and are left out for ASCII texts.
    """

    def named(text: Column) -> Column:
        unnamed = rf"(?<![{WORD}])unnamed\s*:?\s*[0-9]+(?![{WORD}])"
        return F.when(text.contains("unnamed"), F.regexp_replace(text, unnamed, " ")).otherwise(text)

    def any_script(t: Column) -> Column:
        text = strip(F.lower(ascii_digits(plain_spaces(t))))
        return let(F.regexp_replace(text, DIACRITICS, ""), lambda x: _with_currencies(named(x)))

    def ascii(t: Column) -> Column:
        return let(_in_ascii(t), named)

    return let(c, lambda t: F.when(is_ascii(t), ascii(t)).otherwise(any_script(t)))


def prepare_plain(c: Column) -> Column:
    """The simpler preparation: keeps diacritics and the Arabic percent sign."""
    any_script = lambda t: _with_currencies(strip(F.lower(ascii_digits(plain_spaces(t)))), "٪")
    return let(c, lambda t: F.when(is_ascii(t), _in_ascii(t)).otherwise(any_script(t)))


_SHIFT = "CASE p.unit " + " ".join(
    f"WHEN '{unit}' THEN {power}" for unit, power in C.UNIT_SHIFTS.items()
) + " ELSE 0 END"
_PERCENT = ", ".join(f"'{unit}'" for unit in C.PERCENT_UNITS)

# ``(1,250.50)`` -> ``num_neg1250p5``; ``5%`` -> ``pct_5``. Scaling moves the
# decimal point in the digit string, so figures of any length stay exact.
_PLAIN = "regexp_replace(replace(m, ',', ''), '^0+(?=[0-9])', '')"
CANONICAL = rf"""m -> CASE
  WHEN m RLIKE '^[0-9][0-9,]*$' THEN concat('num_', {_PLAIN})
  WHEN m RLIKE '^[0-9][0-9,]*[.][0-9]+$'
    THEN concat('num_', regexp_replace(replace({_PLAIN}, '.', 'p'), 'p?0*$', ''))
  ELSE transform(transform(transform(transform(
    array(lower(regexp_replace(m, r'^\s+|\s+$', ''))),
    r -> named_struct(
      'unit', regexp_extract(r, r'(percent|percentage|million|mn|m|billion|bn|b|thousand|k|%)\s*$', 1),
      'digits', regexp_replace(r, '[^0-9.]', ''),
      'sign', IF(startswith(r, '-') OR (startswith(r, '(') AND endswith(r, ')')), 'neg', ''))),
    p -> named_struct(
      'head', concat(IF(p.unit IN ({_PERCENT}), 'pct_', 'num_'), p.sign),
      'whole', substring_index(p.digits, '.', 1),
      'frac', IF(contains(p.digits, '.'), substring_index(p.digits, '.', -1), ''),
      'shift', {_SHIFT})),
    p -> named_struct('head', p.head, 'whole', p.whole, 'shift', p.shift,
      'frac', rpad(p.frac, greatest(length(p.frac), p.shift), '0'))),
    p -> concat(p.head,
      regexp_replace(concat(p.whole, substring(p.frac, 1, p.shift)), '^0+(?=[0-9])', ''),
      regexp_replace(concat('p', substring(p.frac, p.shift + 1)), 'p?0*$', '')))[0] END"""


def canonical_number(raw: Column) -> Column:
    """A figure with sign, separators and unit as one token."""
    return F.call_function("transform", F.array(raw), F.expr(CANONICAL))[0]


def _figure_list(prepared: Column) -> Column:
    return F.call_function("transform", matches(prepared, NUMBER), F.expr(CANONICAL))


def _bare(prepared: Column) -> Column:
    """A prepared text without its figures."""
    return F.when(prepared.rlike("[0-9]"), F.regexp_replace(prepared, NUMBER, " ")).otherwise(prepared)


def _tokens(prepared: Column, bare: Column) -> Column:
    words = matches(bare, r"[a-z0-9_\u0600-\u06ff]+")
    return F.when(prepared.rlike("[0-9]"), F.concat(words, _figure_list(prepared))).otherwise(words)


def value_tokens(prepared: Column) -> Column:
    """Words and canonical figures of a prepared text, in no meaningful order."""
    return let(prepared, lambda t: _tokens(t, _bare(t)))


def _figures(prepared: Column) -> Column:
    """Distinct figures, and words that are spelled like one."""

    def body(t: Column) -> Column:
        spelled = F.filter(
            value_tokens(t), lambda w: w.startswith("num_") | w.startswith("pct_")
        )
        return F.array_distinct(
            F.when(t.contains("num_") | t.contains("pct_"), spelled)
            .when(t.rlike("[0-9]"), _figure_list(t))
            .otherwise(F.array().cast("array<string>"))
        )

    return let(prepared, body)


def number_tokens(c: Column) -> Column:
    return _figures(prepare(c))


def number_tokens_plain(c: Column) -> Column:
    return _figures(prepare_plain(c))


def _without_scales(prepared: Column) -> Column:
    """Drop the scale in ``3.7/5`` or ``3 out of 4``, which is no figure."""
    edge, open_ = rf"(?![{WORD}])", rf"(?<![{WORD}])"
    scale = (
        r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*"
        rf"(?:/|{open_}من{edge}|{open_}out\s+of{edge})\s*[45]{edge}"
    )
    return F.when(_may_scale(prepared), F.regexp_replace(prepared, scale, "$1")).otherwise(prepared)


def _may_scale(prepared: Column) -> Column:
    """Whether a text holds what a scale is written with; most do not."""
    return prepared.contains("/") | prepared.contains("من") | prepared.contains("out")


def material_numbers(c: Column) -> Column:
    return let(prepare(c), lambda t: _figures(_without_scales(t)))


def _label_words(bare: Column, ignored=C.NON_LABEL_WORDS) -> Column:
    found = matches(bare, r"[a-z\u0600-\u06ff]{2,}")
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*ignored)))


def _words(prepared: Column, ignored=C.NON_LABEL_WORDS) -> Column:
    return _label_words(F.regexp_replace(prepared, NUMBER, " "), ignored)


def word_tokens(c: Column) -> Column:
    return _words(prepare(c))


def word_tokens_plain(c: Column) -> Column:
    return _words(prepare_plain(c))


_IGNORED = tuple(dict.fromkeys(C.NON_LABEL_WORDS + C.STOPWORDS))


def meaningful_words(c: Column) -> Column:
    return _words(prepare(c), _IGNORED)


def describe(c: Column) -> Column:
    """Struct of a text, its material figures and its meaningful words."""
    return let(
        prepare(c),
        lambda p: F.struct(
            c.alias("text"),
            _figures(_without_scales(p)).alias("numbers"),
            _words(p, _IGNORED).alias("words"),
        ),
    )


def describe_plain(c: Column) -> Column:
    """Struct of the figures and words in the simpler preparation."""
    return let(
        prepare_plain(c),
        lambda p: F.struct(_figures(p).alias("numbers"), _words(p).alias("words")),
    )


def describe_both(c: Column) -> Column:
    """The fields of :func:`describe` and, as ``plain``, of :func:`describe_plain`.

    The two preparations of a text mostly agree. Then its figures and words are
    found once; the ignored words of one are among those of the other.
    """

    def told(t: Column) -> Column:
        def with_plain(d: Column) -> Column:
            same = d.p == d.q
            return F.struct(
                t.alias("text"),
                F.when(same & ~_may_scale(d.p), d.plain.numbers)
                .otherwise(_figures(_without_scales(d.p))).alias("numbers"),
                F.when(same, F.filter(d.plain.words, lambda w: ~w.isin(*C.STOPWORDS)))
                .otherwise(_words(d.p, _IGNORED)).alias("words"),
                d.plain.alias("plain"),
            )

        prepared = F.struct(prepare(t).alias("p"), prepare_plain(t).alias("q"))
        return let(
            let(prepared, lambda x: F.struct(x.p.alias("p"), x.q.alias("q"), _plain_parts(x.q).alias("plain"))),
            with_plain,
        )

    return let(c, told)


def _plain_parts(prepared: Column) -> Column:
    return F.struct(_figures(prepared).alias("numbers"), _label_words(_bare(prepared)).alias("words"))


def normalize_item(c: Column) -> Column:
    """Key under which two spellings of one financial item are equal."""

    def value(text: Column) -> Column:
        return F.array_join(F.sort_array(value_tokens(text)), " ")

    def label(text: Column) -> Column:
        return F.array_join(matches(text, r"[a-z0-9\u0600-\u06ff]+"), " ")

    def body(t: Column) -> Column:
        at = F.instr(t, ":")
        return F.when(
            at > 0,
            F.concat(
                label(F.substring(t, F.lit(1), at - 1)),
                F.lit(": "),
                value(F.substring(t, at + 1, F.lit(2147483647))),
            ),
        ).otherwise(value(t))

    return let(prepare(c), body)


def extract_items(c: Column) -> Column:
    """Numeric clauses of an answer or source text, as a distinct array.

    A step whose pattern cannot match, as a plain search tells, is left out.
    """

    def step(t: Column, needed, change) -> Column:
        return let(t, lambda x: F.when(needed(x), change(x)).otherwise(x))

    spaced = F.when(is_ascii(c), c).otherwise(plain_spaces(c))
    pieces = split_at(spaced, r"[\n\r]+|(?:\s+[\u2022*-]\s+)|(?:\s+[0-9]+[.)]\s+)|\|")
    # most pieces hold no figure and are dropped before any cleaning
    pieces = F.filter(pieces, lambda p: p.rlike(r"[0-9\u0660-\u0669]"))
    # the rest is cleaned as one text, with a cut between two pieces
    text = step(
        F.array_join(pieces, CUT),
        lambda t: t.contains("-") | t.contains("*") | t.contains("\u2022"),
        lambda t: F.regexp_replace(t, rf"(^|{CUT})\s*[-\u2022*]\s*", "$1"),
    )
    text = step(text, lambda t: t.rlike(r"[\t-\r]| {2}"), squeeze)
    edge = rf"(?<=^|{CUT}) | (?=[\u0085\u2028\u2029]?(?:{CUT}|\z))"
    text = step(
        text,
        lambda t: t.startswith(" ") | t.endswith(" ") | t.contains(" " + CUT) | t.contains(CUT + " ")
        | t.rlike(r" [\u0085\u2028\u2029]"),
        lambda t: F.regexp_replace(t, edge, ""),
    )
    text = step(
        text, lambda t: t.contains("[Source:"),
        lambda t: F.regexp_replace(t, rf"(^|{CUT})\[Source:[^\]{CUT}]+\]\s*", "$1"),
    )
    pieces = F.split(text, CUT, -1)
    pieces = F.transform(
        pieces,
        lambda p: F.when(
            F.length(p) > C.ITEM_MAX_CHARS,
            strip(
                F.regexp_replace(
                    F.substring(p, 1, C.ITEM_MAX_CHARS), r"^(.*) [^ ]*$", "$1"
                )
            ),
        ).otherwise(p),
    )
    return F.array_distinct(F.filter(pieces, lambda p: p != ""))


def looks_like_blob(c: Column) -> Column:
    return (
        (F.length(c) > C.BLOB_MIN_CHARS)
        | c.contains("\n") | c.contains("|") | c.contains("  ")
        | c.rlike(r"^\s*[-*\u2022]")
    )


def text_items(c: Column) -> Column:
    """Items of one text: its numeric clauses when it is a longer passage that
    has any, else the text itself, else nothing."""

    def body(t: Column) -> Column:
        return let(
            F.when(looks_like_blob(t), extract_items(t)).otherwise(
                F.array().cast("array<string>")
            ),
            lambda found: F.when(F.size(found) > 0, found)
            .when(t != "", F.array(t))
            .otherwise(F.array().cast("array<string>")),
        )

    return let(strip_text(c), body)


__all__ = [
    "canonical_number", "describe", "describe_both", "describe_plain", "extract_items", "item_has_no_data", "looks_like_blob",
    "material_numbers", "meaningful_words", "normalize_item", "number_tokens",
    "number_tokens_plain", "prepare", "prepare_plain", "text_items",
    "value_tokens", "word_tokens", "word_tokens_plain",
]
