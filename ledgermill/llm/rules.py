"""Quality rules: a table of thresholds compiled into one projection.

Measures are Column expressions over a whole text; a rule bounds one of them.
No user function runs. Windows of words are compared by 64-bit hashes, and
only texts that hold an equal pair of them are sorted for the places.

Edge cases: a null or empty text has no words and measures of 0, so the rule
on the least number of words fails. All rows are returned, repeated ones too;
extra columns stay unless named as a measure, which replaces them.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import settle

# Fixed values ---------------------------------------------------------------
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
#: Very common words of the languages at hand.
STOP_WORDS = (
    "a and as at be by for from in is it of on or that the this to was with "
    "das dem den der des die ein eine im ist mit nicht sich und von zu "
    "au dans de du en est et la le les pour que qui sur un une "
    "como con del el es las los no para por se su una y"
).split()
#: rule, measure, least, most (None: open)
RULES = (
    ("few_words", "n_words", 10, None),
    ("repeated_windows", "repeat_ratio", None, 0.2),
    ("word_length", "mean_word_length", 2.0, 12.0),
    ("symbols", "symbol_ratio", None, 0.25),
    ("no_stop_words", "stop_ratio", 0.02, None),
    ("repeated_lines", "dup_line_ratio", None, 0.4),
    ("bullets", "bullet_ratio", None, 0.9),
    ("ellipses", "ellipsis_ratio", None, 0.3),
    ("no_letters", "letter_ratio", 0.5, None),
)
# ----------------------------------------------------------------------------


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with counts and ratios of their whole texts."""
    names = {
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "mean_word_length",
        "symbol_ratio", "stop_ratio", "dup_line_ratio", "bullet_ratio", "ellipsis_ratio", "letter_ratio",
        "repeat_ratio",
    }
    kept = docs.drop(*[c for c in docs.columns if c in names and c != text_col])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = kept.select(F.struct(*kept.columns).alias("row"), text.alias("text"))
    rows = settle(
        rows,
        words=F.regexp_extract_all("text", F.lit(WORD), F.lit(0)),
        lines=_lines(F.col("text")),
        n_symbols=F.regexp_count("text", F.lit(SYMBOL)).cast("long"),
    )
    n = F.size("words")
    hashes = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW))),
    ).otherwise(F.array().cast("array<long>"))
    rows = settle(
        rows,
        hashes=hashes,
        word_chars=F.length(F.array_join("words", "")).cast("long"),
        n_stop=F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))),
        n_letter_words=F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_bullets=F.size(F.filter("lines", lambda x: x.rlike(r"^\s*[-*•]"))),
        n_ellipses=F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))),
    ).drop("text")
    # places of windows that occur twice or more, in order; most texts have none
    pairs = F.when(
        F.size("hashes") > F.size(F.array_distinct("hashes")),
        F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    rows = settle(rows, pairs=pairs)
    near = lambda x, i, by: F.coalesce(F.get("pairs", i + by)["h"] == x["h"], F.lit(False))
    again = F.filter("pairs", lambda x, i: near(x, i, -1) | near(x, i, 1))
    places = F.array_sort(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last")),
        lambda s: s["n"],
    )
    rows = settle(rows, n_repeat_words=F.coalesce(covered, F.lit(0)).cast("long"))
    n_lines = F.size("lines")
    return rows.select(
        "row.*",
        n.cast("long").alias("n_words"),
        "word_chars", "n_symbols", n_lines.cast("long").alias("n_lines"), "n_dup_lines", "n_repeat_words",
        _ratio(F.col("word_chars"), n).alias("mean_word_length"),
        _ratio(F.col("n_symbols"), n).alias("symbol_ratio"),
        _ratio(F.col("n_stop"), n).alias("stop_ratio"),
        _ratio(F.col("n_dup_lines"), n_lines).alias("dup_line_ratio"),
        _ratio(F.col("n_bullets"), n_lines).alias("bullet_ratio"),
        _ratio(F.col("n_ellipses"), n_lines).alias("ellipsis_ratio"),
        _ratio(F.col("n_letter_words"), n).alias("letter_ratio"),
        _ratio(F.col("n_repeat_words"), n).alias("repeat_ratio"),
    )


def compile_rules(rules: Iterable[tuple] = RULES) -> Mapping[str, Column]:
    """Rule name -> whether it fails, for one projection over ``measures``."""
    found = {}
    for name, measure, least, most in rules:
        value = F.col(measure)
        fails = [value < least] if least is not None else []
        fails += [value > most] if most is not None else []
        found[name] = fails[0] | fails[1] if len(fails) == 2 else fails[0] if fails else F.lit(False)
    return found


def apply_rules(docs: DataFrame, rules: Iterable[tuple] = RULES, text_col: str = "text") -> DataFrame:
    """All rows with measures, ``failed`` (names of the rules that fail) and ``kept``."""
    compiled = compile_rules(rules)
    failed = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in compiled.items()]))
    return measures(docs, text_col).withColumn("failed", failed).withColumn("kept", F.size("failed") == 0)
