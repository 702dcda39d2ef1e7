"""DuckDB SQL fragments for the checks. Each takes and returns SQL text."""

from __future__ import annotations

from .. import constants as C

W = r"\p{L}\p{N}_"
NUMBER = (
    r"(?i)\(?[-+]?[0-9][0-9,]*(?:\.[0-9]+)?\)?(?:\s*(?:" + C.NUMBER_UNITS + r"))?"
)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def any_of(c: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({c}, {quote(p)})" for p in phrases) + ")"


def plain(c: str) -> str:
    return f"translate({c}, chr(160) || chr(8239), '  ')"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def squeeze(c: str) -> str:
    return rf"regexp_replace({c}, '\s+', ' ', 'g')"


def words(c: str) -> str:
    return rf"list_filter(string_split_regex({c}, '\s+'), lambda x: x <> '')"


def base_tokens(c: str) -> str:
    return words(f"lower(regexp_replace({plain(c)}, '[^{W}\\s]', ' ', 'g'))")


def tokens(c: str) -> str:
    """Tokens of texts without scaled amounts."""
    t = base_tokens(c)
    return f"list_concat({t}, list_filter({t}, lambda x: regexp_full_match(x, '[0-9]+')))"


def prepare(c: str) -> str:
    t = strip(f"lower({plain(c)})")
    for symbol, word in C.CURRENCY_WORDS:
        t = f"replace({t}, {quote(symbol)}, {quote(word)})"
    return t


def canonical(numbers: str) -> str:
    """List of raw figures -> list of canonical figures."""
    shift = "CASE " + " ".join(
        f"WHEN u = {quote(k)} THEN {v}" for k, v in C.UNIT_SHIFTS.items()
    ) + " ELSE 0 END"
    unit = r"regexp_extract(r, '(percent|percentage|million|mn|m|billion|bn|b|thousand|k|%)\s*$', 1)"
    parts = (
        "{'w': split_part(regexp_replace(r, '[^0-9.]', '', 'g'), '.', 1),"
        " 'f': split_part(regexp_replace(r, '[^0-9.]', '', 'g'), '.', 2),"
        f" 'u': {unit},"
        " 's': CASE WHEN starts_with(r, '-') OR (starts_with(r, '(') AND ends_with(r, ')')) THEN 'neg' ELSE '' END}"
    )
    trimmed = f"list_transform({numbers}, lambda r: lower(trim(r)))"
    split = f"list_transform({trimmed}, lambda r: {parts})"
    shifted = (
        f"list_transform({split}, lambda p: {{'s': p.s,"
        " 'k': CASE WHEN p.u IN ('%', 'percent', 'percentage') THEN 'pct' ELSE 'num' END,"
        f" 'w': p.w, 'n': {shift.replace('WHEN u', 'WHEN p.u')},"
        f" 'f': rpad(p.f, CAST(greatest(length(p.f), {shift.replace('WHEN u', 'WHEN p.u')}) AS INTEGER), '0')}})"
    )
    return (
        f"list_transform({shifted}, lambda p: p.k || '_' || p.s ||"
        r" regexp_replace(p.w || substr(p.f, 1, p.n), '^0+([0-9])', '\1') ||"
        " CASE WHEN regexp_replace(substr(p.f, p.n + 1), '0+$', '') <> ''"
        " THEN 'p' || regexp_replace(substr(p.f, p.n + 1), '0+$', '') ELSE '' END)"
    )


def figures_of(prepared: str) -> str:
    return f"list_distinct({canonical(f'regexp_extract_all({prepared}, {quote(NUMBER)})')})"


def unscaled(prepared: str) -> str:
    """Without the scale in ``3.7/5`` and ``3 out of 4``."""
    t = rf"regexp_replace({prepared}, '([0-9][0-9,]*(?:\.[0-9]+)?)\s*/\s*[45]($|[^{W}])', '\1\2', 'g')"
    return rf"regexp_replace({t}, '([0-9][0-9,]*(?:\.[0-9]+)?)\s+out\s+of\s+[45]($|[^{W}])', '\1\2', 'g')"


def material(c: str) -> str:
    return figures_of(unscaled(prepare(c)))


def word_list(c: str) -> str:
    found = (
        f"list_distinct(regexp_extract_all(regexp_replace({prepare(c)}, {quote(NUMBER)}, ' ', 'g'),"
        r" '[a-z\x{0600}-\x{06ff}]{2,}'))"
    )
    return f"list_filter({found}, lambda x: NOT list_contains({sql_list(C.NON_LABEL_WORDS)}, x))"


def meaningful(c: str) -> str:
    return f"list_filter({word_list(c)}, lambda x: NOT list_contains({sql_list(C.STOPWORDS)}, x))"


def value_text(prepared: str) -> str:
    rest = words(
        f"regexp_replace(regexp_replace({prepared}, {quote(NUMBER)}, ' ', 'g'),"
        r" '[^a-z0-9_\x{0600}-\x{06ff}]+', ' ', 'g')"
    )
    numbers = canonical(f"regexp_extract_all({prepared}, {quote(NUMBER)})")
    return f"array_to_string(list_sort(list_concat({rest}, {numbers})), ' ')"


def normalize_item(c: str) -> str:
    p = prepare(c)
    label = f"array_to_string({words(rf'regexp_replace(split_part({p}, {quote(chr(58))}, 1), {quote(r'[^a-z0-9\x{0600}-\x{06ff}]+')}, {quote(' ')}, {quote('g')})')}, ' ')"
    value = value_text(f"substr({p}, instr({p}, ':') + 1)")
    return f"CASE WHEN contains({p}, ':') THEN {label} || ': ' || {value} ELSE {value_text(p)} END"


def items(c: str) -> str:
    """Numeric clauses of a text."""
    cut = rf"string_split_regex({plain(c)}, '[\n\r]+|(?:\s+[•*-]\s+)|(?:\s+[0-9]+[.)]\s+)|\|')"
    clean = squeeze(strip(r"regexp_replace(x, '^\s*[-•*]\s*', '')"))
    t = f"list_transform({cut}, lambda x: {clean})"
    t = f"list_filter({t}, lambda x: regexp_matches(x, '[0-9]'))"
    t = f"list_transform({t}, lambda x: {strip(r'regexp_replace(x, ' + quote(r'^\[Source:[^\]]+\]\s*') + ', ' + quote('') + ')')})"
    t = (
        f"list_transform({t}, lambda x: CASE WHEN length(x) > {C.ITEM_MAX_CHARS} THEN "
        + strip(f"regexp_replace(substr(x, 1, {C.ITEM_MAX_CHARS}), '^(.*) [^ ]*$', '\\1')")
        + " ELSE x END)"
    )
    return f"list_distinct(list_filter({t}, lambda x: x <> ''))"


def sar(v: str, signed: bool = False) -> str:
    plus = f"CASE WHEN {v} > 0 THEN '+' ELSE '' END || " if signed else ""
    return (
        f"({plus}CASE WHEN {v} = floor({v}) THEN format('{{:,}}', CAST({v} AS BIGINT))"
        f" ELSE format('{{:,.2f}}', CAST({v} AS DOUBLE)) END || ' SAR')"
    )
