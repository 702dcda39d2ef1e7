"""Chat entries read and judged in plain Python, an entry at a time.

The results are those of the Column expressions in ``evaluation``, which spend
most of their time on interpreting expressions. Here one pass over a prepared
text finds its figures and its words. Of an entry about which this module and
the expressions might disagree nothing is told: its JSON is ``left`` to them.
That is JSON that does not parse here, repeated keys, numbers that are no short
integers and objects inside objects in fields that are used, and characters
outside the scripts in ``_KNOWN``, whose case or class may differ in Java.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .. import constants as C
from ..functions.numbers import NUMBER
from ..functions.text import DIACRITICS

#: Longer JSON, and JSON with more brackets, is left; so are long keys.
MOST_CHARS, MOST_BRACKETS, MOST_KEY_CHARS = 1_000_000, 900, 10_000

#: ASCII, Latin, Cyrillic, Arabic, punctuation, currencies, symbols, Chinese, Japanese, pictures.
_KNOWN = re.compile(
    r"[\x00-\x7f\u00a0-\u012f\u0131-\u017e\u0400-\u04ff\u0600-\u06ff\u2010-\u2027\u202f-\u205e"
    r"\u20a0-\u20bf\u2190-\u27bf\u3000-\u303f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\ufe0f\U0001f300-\U0001faff]*"
).fullmatch


class Left(Exception):
    """The entry is left to the expressions."""


# --------------------------------------------------------------------------
# JSON
# --------------------------------------------------------------------------

class _Number(str):
    """A number as it is written, which is no short integer."""


def _object(pairs: list) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise Left
    return found


def _checked_object(pairs: list) -> dict:
    for key, _ in pairs:
        if len(key) > MOST_KEY_CHARS or not _KNOWN(key):
            raise Left
    return _object(pairs)


def _integer(digits: str):
    return int(digits) if len(digits) < 19 else _fraction(digits)


def _fraction(digits: str) -> _Number:
    if len(digits) > 38 or "e" in digits or "E" in digits:
        raise Left
    return _Number(digits)


def _constant(name: str):
    raise Left


def _decoder(hook: Callable) -> Callable:
    return json.JSONDecoder(
        object_pairs_hook=hook, parse_int=_integer, parse_float=_fraction, parse_constant=_constant
    ).decode


_DECODE, _DECODE_CHECKED = _decoder(_object), _decoder(_checked_object)


def parse_object(text: str) -> dict | None:
    """A JSON object; None for other JSON."""
    if len(text) > MOST_CHARS or text.count("[") + text.count("{") > MOST_BRACKETS:
        raise Left
    plain = text.isascii() and "\\u" not in text and len(text) <= MOST_KEY_CHARS
    found = (_DECODE if plain else _DECODE_CHECKED)(text)
    return found if type(found) is dict else None


_SPACE = " \t\n\x0b\f\r"
_ABSENT = object()


def _first(fields: dict, names: tuple):
    for name in names:
        if name in fields:
            return fields[name]
    return _ABSENT


def _scalar(value) -> str:
    kind = type(value)
    if kind is str:
        if not value.isascii() and not _KNOWN(value):
            raise Left
        return value.strip(_SPACE)
    if kind is int or kind is bool or value is None:
        return str(value)
    raise Left


def _same(a, b) -> bool:
    """Whether two JSON values are written alike."""
    if type(a) is not type(b):
        return False
    if type(a) is list:
        return len(a) == len(b) and all(map(_same, a, b))
    if type(a) is dict:
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    if type(a) is _Number:
        raise Left
    return a == b


def _leaves(value, found: list) -> list:
    if type(value) is list:
        for one in value:
            _leaves(one, found)
    elif value is not None and value is not _ABSENT:
        found.append(value)
    return found


# --------------------------------------------------------------------------
# items of texts
# --------------------------------------------------------------------------

_SPLIT = re.compile(r"[\n\r]+|(?:\s+[\u2022*-]\s+)|(?:\s+[0-9]+[.)]\s+)|\|", re.ASCII).split
_DIGIT = re.compile(r"[0-9\u0660-\u0669]").search
_MARKED = re.compile(r"\s(?:[\u2022*-]|[0-9]+[.)])\s", re.ASCII).search
_BULLETS = ("-", "*", "\u2022")
_SPACES, _SPACED = re.compile(r"\s+", re.ASCII), re.compile(r"[\t-\r]|  ").search
_SOURCE = re.compile(r"\[Source:[^\]]+\]\s*", re.ASCII)
_NO_BREAK = {0xA0: " ", 0x202F: " "}


def _clauses(text: str) -> list[str]:
    """:func:`ledgermill.functions.numbers.extract_items`."""
    found = {}
    if not text.isascii():
        text = text.translate(_NO_BREAK)
    # without a mark between spaces the pattern only cuts at these; pieces without a figure go anyway
    pieces = _SPLIT(text) if _MARKED(text) else text.replace("\r", "\n").replace("|", "\n").split("\n")
    for piece in pieces:
        if not _DIGIT(piece):
            continue
        piece = piece.strip(_SPACE)
        if piece[0] in _BULLETS:
            piece = piece[1:].lstrip(_SPACE)
        if _SPACED(piece):
            piece = _SPACES.sub(" ", piece)
        if piece.startswith("[Source:"):
            source = _SOURCE.match(piece)
            piece = piece[source.end():] if source else piece
        if len(piece) > C.ITEM_MAX_CHARS:
            piece = piece[: C.ITEM_MAX_CHARS]
            at = piece.rfind(" ")
            piece = (piece[:at] if at >= 0 else piece).strip(_SPACE)
        if piece:
            found[piece] = None
    return list(found)


def _text_items(text: str) -> list[str]:
    if (
        len(text) > C.BLOB_MIN_CHARS or "\n" in text or "|" in text or "  " in text or text[:1] in _BULLETS
    ):
        found = _clauses(text)
        if found:
            return found
    return [text] if text else []


def _item_set(leaves: list) -> list[str]:
    found = []
    for value in leaves:
        if type(value) is dict:
            for key in sorted(value, key=lambda k: k.encode("utf-16-be")):
                if not _KNOWN(key):
                    raise Left
                found.append(f"{key}: {_scalar(value[key])}")
        else:
            found += _text_items(_scalar(value))
    return list(dict.fromkeys(found)) if len(found) > 1 else found


# --------------------------------------------------------------------------
# figures and words
# --------------------------------------------------------------------------

#: Figures, which start below a colon, and words, which start above.
_TOKENS = re.compile(rf"{NUMBER}|[a-z_\u0600-\u06ff]+", re.ASCII).findall
_LABEL = re.compile(r"[a-z0-9\u0600-\u06ff]+").findall
_UNIT = re.compile(r"(percent|percentage|million|mn|m|billion|bn|b|thousand|k|%)\s*\Z", re.ASCII).search
_NOT_DIGITS = re.compile(r"[^0-9.]").sub
_UNNAMED = re.compile(r"(?<!\w)unnamed[ \t-\r]*:?[ \t-\r]*[0-9]+(?!\w)").sub
_SCALE = re.compile(
    r"([0-9][0-9,]*(?:\.[0-9]+)?)[ \t-\r]*(?:/|(?<!\w)من(?!\w)|(?<!\w)out[ \t-\r]+of(?!\w))[ \t-\r]*[45](?!\w)"
).sub
_DIACRITIC = re.compile(DIACRITICS).sub
_ASCII_DIGITS = _NO_BREAK | {ord(a): b for a, b in zip(C.ARABIC_DIGITS, C.ASCII_DIGITS)}
_DOLLAR = dict(C.CURRENCY_WORDS)["$"]
_SPELLED = re.compile(r"(?i)num_|pct_").search
#: What asks for more than a lower case and dollars in words: made-up names, scales, words spelled like figures.
_SPECIAL = re.compile(r"unnamed|num_|pct_|out|/").search
_NONE: frozenset = frozenset()
_NON_LABEL, _STOP = frozenset(C.NON_LABEL_WORDS), frozenset(C.STOPWORDS)


def _canonical(figure: str) -> str:
    """A match of ``NUMBER`` in a prepared text as a token."""
    if figure.isdigit():
        return "num_" + (figure.lstrip("0") or "0")
    whole, _, part = figure.partition(".")
    if part.isdigit():
        whole, part = whole.replace(",", ""), part.rstrip("0")
        if whole.isdigit():
            whole = whole.lstrip("0") or "0"
            return f"num_{whole}p{part}" if part else "num_" + whole
    figure = figure.strip(_SPACE)
    unit = _UNIT(figure)
    unit = unit.group(1) if unit else ""
    whole, _, part = _NOT_DIGITS("", figure).partition(".")
    sign = "neg" if figure[0] == "-" or (figure[0] == "(" and figure[-1] == ")") else ""
    shift = C.UNIT_SHIFTS.get(unit, 0)
    whole = (whole + part[:shift].ljust(shift, "0")).lstrip("0") or "0"
    part = part[shift:].rstrip("0")
    return f"{'pct_' if unit in C.PERCENT_UNITS else 'num_'}{sign}{whole}{'p' if part else ''}{part}"


def _currencies(text: str, ignored: str = "") -> str:
    for symbol, word in C.CURRENCY_WORDS:
        if symbol != ignored:
            text = text.replace(symbol, word)
    return text


def _named(text: str) -> str:
    return _UNNAMED(" ", text) if "unnamed" in text else text


def _prepared(text: str) -> tuple[str, str]:
    """Both preparations of a text, which are one string where they agree."""
    if text.isascii():
        plain = text.lower().strip(_SPACE)
        if "$" in plain:
            plain = plain.replace("$", _DOLLAR)
        return (_named(plain) if "unnamed" in plain else plain), plain
    lower = text.translate(_ASCII_DIGITS).lower().strip(_SPACE)
    return _currencies(_named(_DIACRITIC("", lower))), _currencies(lower, "٪")


def _figure_set(text: str, found: list[str]) -> set[str]:
    """The figures of a prepared text with these tokens, and words that are spelled like one."""
    figures = {_canonical(t) for t in found if t < ":"}
    if "num_" in text or "pct_" in text:
        figures.update([t for t in found if t.startswith(("num_", "pct_"))])
    return figures


def _label_words(text: str, found: list[str]) -> set[str]:
    if "_" in text:
        found = [part for t in found if t > ":" for part in t.split("_")]
    return {t for t in found if t > ":" and len(t) > 1} - _NON_LABEL


def _value(found: list[str]) -> str:
    return " ".join(sorted([_canonical(t) if t < ":" else t for t in found]))


class Described:
    """A text with the figures of both preparations; its words and its key are found when they are asked for."""

    __slots__ = ("text", "numbers", "plain_numbers", "prepared", "found", "_words", "_labels", "_key")

    def __init__(self, text: str):
        self.text = text
        self.numbers = self.plain_numbers = _NONE
        self.prepared = self.found = self._words = self._labels = self._key = None
        if _DIGIT(text) or _SPELLED(text):
            self._read()
            p, q = self.prepared
            self.numbers = self.plain_numbers = _figure_set(p, self.found)
            if p is not q and p != q:
                self.plain_numbers = _figure_set(q, _TOKENS(q))
            if "/" in p or "out" in p or "من" in p:
                unscaled = _SCALE(r"\1", p)
                if unscaled != p:
                    self.numbers = _figure_set(unscaled, _TOKENS(unscaled))

    @classmethod
    def from_ascii(cls, text: str, lower: str) -> Described:
        """From an ASCII text in lower case in which nothing is to be changed but dollars."""
        told = cls.__new__(cls)
        told.text, told.prepared = text, (lower, lower)
        told.found = found = _TOKENS(lower)
        told.numbers = told.plain_numbers = {_canonical(t) for t in found if t < ":"}
        told._words = told._labels = told._key = None
        return told

    def _read(self) -> None:
        self.prepared = _prepared(self.text)
        self.found = _TOKENS(self.prepared[0])

    def words(self) -> set[str]:
        if self._words is None:
            self._words = _label_words(self.prepared[0], self.found) - _STOP
        return self._words

    def plain_words(self) -> set[str]:
        if self._labels is None:
            p, q = self.prepared
            self._labels = _label_words(q, self.found if p is q else _TOKENS(q))
        return self._labels

    def key(self) -> str:
        """:func:`ledgermill.functions.numbers.normalize_item`."""
        if self._key is None:
            if self.found is None:
                self._read()
            before, colon, after = self.prepared[0].partition(":")
            if colon:
                self._key = " ".join(_LABEL(before)) + ": " + _value(_TOKENS(after))
            else:
                self._key = _value(self.found)
        return self._key


# --------------------------------------------------------------------------
# grounding
# --------------------------------------------------------------------------

_THOUSANDTH = Decimal("0.001")
GROUNDED, NOTHING = "grounded_relevant_item", "non_financial_or_no_data_response"
BLENDED, MADE_UP = "cross_row_or_blended_figure", "ungrounded_or_hallucinated_figure"
NEIGHBOUR, OFF_TOPIC = "wrong_label_or_neighboring_row", "query_intent_mismatch"


def _rounded(share: float) -> float:
    return float(Decimal(repr(share)).quantize(_THOUSANDTH, ROUND_HALF_EVEN))


class Decision:
    """What the sources say of an item; the shares of its figures and words that the best one has."""

    __slots__ = ("category", "source", "number", "word", "overlap", "wanted")

    def __init__(self, category: str, source: str = "", number=0.0, word=0.0, overlap=0, wanted=0):
        self.category, self.source, self.number, self.word = category, source, number, word
        self.overlap, self.wanted = overlap, wanted

    def support(self) -> float:
        return 0.0 if self.category == NOTHING else _rounded(0.75 * self.number + 0.25 * min(self.word * 2, 1.0))

    def asked(self) -> float:
        if self.category not in (GROUNDED, OFF_TOPIC):
            return 0.0
        return _rounded(min(self.overlap / min(self.wanted, 4), 1.0)) if self.wanted else 1.0


_NO_DATA = Decision(NOTHING)


def _described(texts: list[str]) -> list[Described]:
    """Texts described one by one, or, where all are plain, after looking at all of them at once."""
    lower = "\0".join(texts)
    if not lower.isascii():
        return [Described(t) for t in texts]
    lower = lower.lower()
    if _SPECIAL(lower):
        return [Described(t) for t in texts]
    if "$" in lower:
        lower = lower.replace("$", _DOLLAR)
    lowers = lower.split("\0")
    if len(lowers) != len(texts):
        return [Described(t) for t in texts]
    return [Described.from_ascii(t, low) for t, low in zip(texts, lowers)]


class Sources:
    """The sources of an entry, and its question; they are described once an item with figures asks.

    Sources without figures neither ground nor support an item.
    """

    __slots__ = ("items", "question", "_all", "_asked")

    def __init__(self, items: list[str], question: str):
        self.items, self.question = items, question
        self._all = self._asked = None

    def described(self) -> list[Described]:
        if self._all is None:
            self._all = [s for s in _described(self.items) if s.numbers or s.plain_numbers]
        return self._all

    def asked(self) -> set[str]:
        if self._asked is None:
            p = _prepared(self.question)[0]
            self._asked = _label_words(p, _TOKENS(p)) - _STOP
        return self._asked

    def supports(self, d: Described) -> bool:
        wanted = d.plain_numbers
        if wanted:
            for s in self.described():
                if wanted <= s.plain_numbers and (len(wanted) > 1 or not d.plain_words().isdisjoint(s.plain_words())):
                    return True
        return False

    def decide(self, d: Described) -> Decision:
        numbers = d.numbers
        if not numbers:
            return _NO_DATA
        lower = d.text.lower()
        for phrase in C.NO_DATA_ITEM_PHRASES:
            if phrase in lower:
                return _NO_DATA
        words, size = d.words(), len(numbers)
        number, word, best = -1, 0.0, None
        sources = self.described()
        for s in sources:
            if not s.numbers:
                continue
            n = len(numbers & s.numbers)
            if n < number:
                continue
            w = len(words & s.words()) / len(words) if words else 0.0
            if n > number or (w, len(s.text), s.text) > (word, len(best.text), best.text):
                number, word, best = n, w, s
        if best is None:
            return Decision(MADE_UP)
        if number < size:
            every = set().union(*[s.numbers for s in sources])
            return Decision(BLENDED if numbers <= every else MADE_UP, best.text, number / size, word)
        best_words = best.words()
        if words and best_words and word == 0.0:
            return Decision(NEIGHBOUR, best.text, 1.0, word)
        asked = self.asked()
        overlap = len(asked & words) + len((asked & best_words) - words)
        off = asked and not overlap and self.question.strip(_SPACE) != ""
        return Decision(OFF_TOPIC if off else GROUNDED, best.text, 1.0, word, overlap, len(asked))


def _deduped(items: list[Described]) -> list[Described]:
    """The shortest, then first, of the items under each key, in this order."""
    if len(items) < 2:
        return items
    found: dict[str, Described] = {}
    for d in sorted(items, key=lambda d: (len(d.text), d.text)):
        found.setdefault(d.key(), d)
    return list(found.values())


class Entry:
    """An evaluable chat entry with both sides, ``kept`` and ``right``."""

    def __init__(self, asked, retrieved, source, relevant, fixed: bool, apply_filter: bool, decide_all: bool):
        self.explicit = relevant is not _ABSENT and (fixed or source is _ABSENT or not _same(relevant, source))
        self.question = _scalar(asked)
        self.raw = _leaves(_ABSENT if self.explicit else source, [])
        self.original = _item_set(_leaves(retrieved, []))
        self.source_items = _item_set(self.raw)
        self.items = items = _described(self.original)
        self.kept = items
        sources = Sources(self.source_items, self.question)
        if decide_all or (apply_filter and not self.explicit):
            self.decisions = [sources.decide(d) for d in items]
        if self.explicit:
            self.right = [Described(i) for i in _item_set(_leaves(relevant, []))]
            if apply_filter:
                self.kept = _deduped(items)
            return
        self.right = [d for d in items if sources.supports(d)]
        if apply_filter:
            self.kept = _deduped([d for d, found in zip(items, self.decisions) if found.category == GROUNDED])
            self.right = _deduped(self.right)

    @property
    def source_texts(self) -> list[str]:
        return [t for t in map(_scalar, self.raw) if t]


def _entry(text: str, names: tuple, *how) -> Entry | None:
    """The entry in a JSON text, None if it cannot be evaluated."""
    try:
        fields = parse_object(text)
        if fields is None:
            return None
        retrieved, source, relevant = (_first(fields, n) for n in names)
        if retrieved is _ABSENT or (source is _ABSENT and relevant is _ABSENT):
            return None
        return Entry(fields.get("question", ""), retrieved, source, relevant, *how)
    except (ValueError, RecursionError) as error:
        raise Left from error


# --------------------------------------------------------------------------
# what is told of an entry
# --------------------------------------------------------------------------

def record(entry: Entry) -> list[tuple]:
    return [(
        entry.question, entry.original, entry.source_items, entry.source_texts, [d.text for d in entry.kept],
        [d.text for d in entry.right], entry.explicit,
    )]


RECORD = (
    "question string, original_retrieved array<string>, source_items array<string>, source_texts array<string>, "
    "retrieved array<string>, relevant array<string>, explicit boolean"
)


def counts(by_key: bool) -> Callable[[Entry], list[tuple]]:
    def told(entry: Entry) -> list[tuple]:
        kept, right = entry.kept, entry.right
        if len(kept) < 2 and len(right) < 2 and (kept == right or not kept or not right):
            # one item at most: its key tells nothing more
            both = len(kept) if kept == right else 0
            return [(both, len(kept) - both, len(right) - both)]
        r, v = ({d.key() if by_key else d.text for d in side} for side in (kept, right))
        both = len(r & v)
        return [(both, len(r) - both, len(v) - both)]

    return told


COUNTS = "tp long, fp long, fn long"
MISMATCH = "normalization_or_support_context_mismatch"


def wrong(entry: Entry) -> list[tuple]:
    """Rank, category and decision of each item that is not relevant."""
    if not entry.items:
        return []
    judged = sorted(zip(entry.items, entry.decisions), key=lambda j: j[0].text)
    right = {d.key() for d in entry.right}
    kept = {d.key() for d, found in judged if found.category == GROUNDED}
    unfiltered = not entry.source_texts
    rows = []
    for rank, (d, found) in enumerate(judged, 1):
        if not right or d.key() not in right:
            category = MISMATCH if unfiltered or (kept and d.key() in kept) else found.category
            rows.append((entry.question, rank, category, d.text, found.source, found.support(), found.asked()))
    return rows


WRONG = (
    "question string, rank long, category string, retrieved_item string, source_chunk string, support_score double, "
    "query_score double"
)


def read_entries(
    entries: DataFrame, tell: Callable[[Entry], list[tuple]], shape: str, retrieved_key: str | None = None,
    relevant_key: str | None = None, apply_filter: bool = True, decide_all: bool = False,
) -> DataFrame:
    """What ``tell`` says of each entry, as columns ``told_…`` of ``shape``, and the entries that are left.

    Rows are ``entry_id, entry_json, told, told_…``: with ``told``, a row that
    ``tell`` gave; without, an entry that is left, with its JSON. Entries that
    cannot be evaluated have no row.
    """
    names = (
        (retrieved_key,) if retrieved_key is not None else C.RETRIEVED_FIELDS,
        C.SOURCE_FIELDS,
        (relevant_key,) if relevant_key is not None else C.EXPLICIT_RELEVANT_FIELDS,
    )
    how = (relevant_key is not None, apply_filter, decide_all)
    fields = T._parse_datatype_string(shape).fields
    schema = T.StructType([
        T.StructField("entry_id", entries.schema["entry_id"].dataType), T.StructField("entry_json", T.StringType()),
        T.StructField("told", T.BooleanType()), *[T.StructField(f"told_{f.name}", f.dataType) for f in fields],
    ])
    kinds = [_arrow(f.dataType) for f in fields]
    columns = [f.name for f in schema.fields]
    nothing = (None,) * len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, left, rows = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                try:
                    entry = _entry(text, names, *how)
                    found = tell(entry) if entry is not None else ()
                    text = None
                except Left:
                    found = (nothing,)
                for row in found:
                    at.append(i)
                    left.append(text)
                    rows.append(row)
            values = list(zip(*rows)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int32())), pa.array(left, pa.string()),
                    pa.array([text is None for text in left], pa.bool_()), *map(pa.array, values, kinds),
                ],
                columns,
            )

    return entries.select("entry_id", "entry_json").mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[
        kind.simpleString()
    ]
