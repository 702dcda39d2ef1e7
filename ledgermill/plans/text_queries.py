"""Queries over texts: tokens, figures, items, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import jsonvals as J
from ..functions import numbers as N
from ..functions import text as T
from . import duck as Q
from .registry import query


def joined(c):
    return F.array_join(c, "\n")


@query(
    "tokenize_documents",
    f"""
    WITH t AS (SELECT doc_id, {Q.base_tokens('text')} AS b FROM documents),
    u AS (SELECT doc_id, list_concat(b, list_filter(b, lambda x: regexp_full_match(x, '[0-9]+'))) AS tok FROM t)
    SELECT doc_id, CAST(len(tok) AS BIGINT) AS n_tokens, md5(array_to_string(tok, chr(10))) AS tokens_md5 FROM u
    """,
)
def tokenize_documents(t):
    return t.spread("documents").select("doc_id", T.tokenize(F.col("text")).alias("tok")).select(
        "doc_id", F.size("tok").cast("long").alias("n_tokens"), F.md5(joined("tok")).alias("tokens_md5")
    )


SCALES = (("million", 10**6), ("mn", 10**6), ("m", 10**6), ("Billion", 10**9), ("bn", 10**9), ("b", 10**9), ("thousand", 1000), ("k", 1000))


def _scaled_sql():
    unit = "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{u}'" for i, (u, _) in enumerate(SCALES)) + " END"
    factor = "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN {f}.0" for i, (_, f) in enumerate(SCALES)) + " END"
    return f"""
    WITH o AS (SELECT o_orderkey, {unit} AS unit, CAST({factor} AS DOUBLE) AS factor,
        CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)
             ELSE CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.001 AS DECIMAL(18,5)) AS VARCHAR) END AS amount FROM orders),
    v AS (SELECT *, CAST(amount AS DOUBLE) * factor AS d FROM o),
    s AS (SELECT *, CASE WHEN d = floor(d) THEN CAST(CAST(d AS DECIMAL(38,0)) AS VARCHAR) ELSE format('{{:g}}', d) END AS txt FROM v),
    t AS (SELECT o_orderkey, {Q.base_tokens("'total ' || txt || ' and ' || txt || ' in 5m2'")} AS b FROM s)
    SELECT o_orderkey, array_to_string(list_concat(b, list_filter(b, lambda x: regexp_full_match(x, '[0-9]+'))), ' ') AS tokens FROM t
    """


@query("tokenize_scaled_amounts", _scaled_sql())
def tokenize_scaled_amounts(t):
    unit = F.element_at(F.array(*[F.lit(u) for u, _ in SCALES]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    amount = F.when(
        F.col("o_orderkey") % 3 == 0, F.floor("o_totalprice").cast("long").cast("string")
    ).otherwise((F.col("o_totalprice").cast("decimal(18,2)") * F.lit(0.001).cast("decimal(4,3)")).cast("decimal(18,5)").cast("string"))
    text = F.concat(F.lit("Total "), amount, F.lit(" "), unit, F.lit(", and "), amount, unit, F.lit("! in 5m2"))
    return t.spread("orders").select(
        "o_orderkey", F.array_join(T.tokenize(text), " ").alias("tokens")
    )


@query(
    "material_numbers",
    f"""
    WITH m AS (SELECT doc_id, {Q.material('text')} AS figures FROM documents)
    SELECT doc_id, CAST(len(figures) AS BIGINT) AS n_figures, array_to_string(list_sort(figures), ' ') AS figures FROM m
    """,
)
def material_numbers(t):
    return t.spread("documents").select("doc_id", N.material_numbers(F.col("text")).alias("f")).select(
        "doc_id", F.size("f").cast("long").alias("n_figures"),
        F.array_join(F.array_sort("f"), " ").alias("figures"),
    )


@query(
    "meaningful_words",
    f"""
    WITH m AS (SELECT doc_id, {Q.meaningful('text')} AS w FROM documents)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, md5(array_to_string(list_sort(w), ' ')) AS words_md5 FROM m
    """,
)
def meaningful_words(t):
    return t.spread("documents").select("doc_id", N.meaningful_words(F.col("text")).alias("w")).select(
        "doc_id", F.size("w").cast("long").alias("n_words"),
        F.md5(F.array_join(F.array_sort("w"), " ")).alias("words_md5"),
    )


@query(
    "financial_items",
    f"""
    WITH m AS (SELECT doc_id, {Q.items('text')} AS i FROM documents)
    SELECT doc_id, CAST(len(i) AS BIGINT) AS n_items, array_to_string(list_sort(i), chr(10)) AS items FROM m
    """,
)
def financial_items(t):
    return t.spread("documents").select("doc_id", N.extract_items(F.col("text")).alias("i")).select(
        "doc_id", F.size("i").cast("long").alias("n_items"), joined(F.array_sort("i")).alias("items")
    )


SPELLINGS = (
    ("Total Price: SAR ", ""), ("total price:  ", " sar"), ("Total-price: $", ""), ("(", ") owed"),
    ("Total price was -", "%"), ("Unnamed: 3 total ", " thousand SAR"), ("€", "k"), ("Deals: ", "mn"),
)


def spelled(t):
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.format_number(amount, 2)).otherwise(amount.cast("string"))
    before = F.element_at(F.array(*[F.lit(a) for a, _ in SPELLINGS]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    after = F.element_at(F.array(*[F.lit(b) for _, b in SPELLINGS]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return t.spread("orders").select("o_orderkey", F.concat(before, text, after).alias("item"))


def spelled_sql():
    pick = lambda n: "CASE o_orderkey % 8 " + " ".join(
        f"WHEN {i} THEN {Q.quote(s[n])}" for i, s in enumerate(SPELLINGS)
    ) + " END"
    amount = "CAST(o_totalprice AS DECIMAL(18,2))"
    text = (
        f"CASE WHEN o_orderkey % 2 = 0 THEN format('{{:,.2f}}', CAST({amount} AS DOUBLE))"
        f" ELSE CAST({amount} AS VARCHAR) END"
    )
    return f"SELECT o_orderkey, {pick(0)} || {text} || {pick(1)} AS item FROM orders"


_P = r"regexp_replace(regexp_replace(" + Q.prepare("item") + r", '^unnamed\s*:?\s*[0-9]+ ', '  '), '^$', '')"


@query(
    "normalize_items",
    f"""
    WITH s AS ({spelled_sql()}),
    c AS (SELECT o_orderkey, item, {_P} AS prep FROM s)
    SELECT o_orderkey, item, CASE WHEN contains(prep, ':') THEN
      array_to_string({Q.words("regexp_replace(split_part(prep, ':', 1), '[^a-z0-9]+', ' ', 'g')")}, ' ') || ': ' ||
      {Q.value_text("substr(prep, instr(prep, ':') + 1)")} ELSE {Q.value_text('prep')} END AS key
    FROM c
    """,
)
def normalize_items(t):
    return spelled(t).withColumn("key", N.normalize_item(F.col("item")))


@query(
    "item_sets",
    f"""
    WITH l AS (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations),
    i AS (SELECT conv_id, turn, text, CASE WHEN length(text) > 80 OR contains(text, chr(10)) OR contains(text, '|')
        OR contains(text, '  ') OR regexp_matches(text, '^[-*•]') THEN {Q.items('text')} ELSE [] END AS found FROM l),
    a AS (SELECT conv_id, turn, CASE WHEN len(found) > 0 THEN found WHEN text <> '' THEN [text] ELSE [] END AS items FROM i)
    SELECT conv_id, turn, CAST(len(items) AS BIGINT) AS n_items, array_to_string(list_sort(items), chr(10)) AS items FROM a
    """,
)
def item_sets(t):
    return t.conversations.select("conv_id", "turn", N.text_items(F.col("text")).alias("i")).select(
        "conv_id", "turn", F.size("i").cast("long").alias("n_items"), joined(F.array_sort("i")).alias("items")
    )


LABELS = ("Q{q} results", "fy {y}", "{d}/{m}", "Sales in {y}", "part {p}", "March run", "{p}", "no period")


def _labels_sql():
    fill = {
        "q": "quarter(o_orderdate)", "y": "year(o_orderdate)", "d": "day(o_orderdate)",
        "m": "month(o_orderdate)", "p": "o_orderpriority",
    }
    cases = []
    for i, pattern in enumerate(LABELS):
        text = Q.quote(pattern)
        for key, column in fill.items():
            text = f"replace({text}, {Q.quote('{' + key + '}')}, CAST({column} AS VARCHAR))"
        cases.append(f"WHEN {i} THEN {text}")
    edge = f"[^{Q.W}]"
    return f"""
    WITH l AS (SELECT o_orderkey, lower(CASE o_orderkey % 8 {' '.join(cases)} END) AS label FROM orders)
    SELECT o_orderkey, label,
      regexp_matches(label, '(^|{edge})(q[1-4]|qtr\\s*[1-4]|quarter\\s*[1-4]|fy\\s*[0-9]{{2,4}})($|{edge})')
      OR regexp_matches(label, '(^|{edge})(19|20)[0-9]{{2}}($|{edge})')
      OR regexp_matches(label, '(^|{edge})[0-9]{{1,2}}[/-][0-9]{{1,2}}([/-][0-9]{{2,4}})?($|{edge})')
      OR {Q.any_of('label', C.TIME_LABEL_WORDS)} AS is_time FROM l
    """


@query("time_labels", _labels_sql())
def time_labels(t):
    parts = {
        "q": F.quarter("o_orderdate"), "y": F.year("o_orderdate"), "d": F.day("o_orderdate"),
        "m": F.month("o_orderdate"), "p": F.col("o_orderpriority"),
    }
    options = []
    for pattern in LABELS:
        text = F.lit(pattern)
        for key, value in parts.items():
            text = F.replace(text, F.lit("{" + key + "}"), value.cast("string"))
        options.append(text)
    label = F.lower(F.element_at(F.array(*options), (F.col("o_orderkey") % 8 + 1).cast("int")))
    return t.orders.select("o_orderkey", label.alias("label")).withColumn(
        "is_time", T.is_time_label(F.col("label"))
    )


@query(
    "strip_answers",
    """
    WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '```json' || chr(10) || '{"a": 1}' || chr(10) || '```'
          || chr(10) || chr(10) || chr(10) || chr(10) || text
        WHEN turn % 3 = 1 THEN '“' || text || '”' || chr(10) || '---' || chr(10)
          || '**Note:** figures need appropriate caution.' ELSE '```' || text || '```' END AS answer FROM conversations),
    c AS (SELECT *, regexp_replace(regexp_replace(translate(regexp_replace(answer, '(?i)```(?:json)?\\s*[\\s\\S]*?```', '', 'g'),
        '“”‘’', '""'''''), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS clean FROM a),
    k AS (SELECT *, CASE WHEN clean <> '' THEN clean ELSE regexp_replace(answer, '^\\s+|\\s+$', '', 'g') END AS kept FROM c)
    SELECT conv_id, turn, kept AS answer,
      regexp_replace(regexp_replace(kept, '(?is)\\n*\\s*---\\s*\\n\\s*\\*\\*Note:\\*\\*\\s*.*?appropriate caution\\.?', '', 'g'),
        '^\\s+|\\s+$', '', 'g') AS without_note FROM k
    """,
)
def strip_answers(t):
    text, turn = F.col("text"), F.col("turn")
    answer = (
        F.when(turn % 3 == 0, F.concat(F.lit('```json\n{"a": 1}\n```\n\n\n\n'), text))
        .when(turn % 3 == 1, F.concat(F.lit("“"), text, F.lit("”\n---\n**Note:** figures need appropriate caution.")))
        .otherwise(F.concat(F.lit("```"), text, F.lit("```")))
    )
    return t.conversations.select(
        "conv_id", "turn", T.strip_answer(answer).alias("answer")
    ).withColumn("without_note", T.strip_legacy_notes(F.col("answer")))


NAMES = ("Llama", "gpt-oss 120b", "KIMI", "claudette", "my gemini!", "minimax2")


@query(
    "redact_models",
    f"""
    WITH a AS (SELECT conv_id, turn, text || ' said ' || CASE turn % 6 {' '.join(f"WHEN {i} THEN {Q.quote(n)}" for i, n in enumerate(NAMES))} END AS text FROM conversations)
    SELECT conv_id, turn, regexp_replace(text, '(?i)(^|[^{Q.W}])(?:{C.MODEL_NAMES_PATTERN})($|[^{Q.W}])',
      '\\1{C.REDACTED_MODEL}\\2', 'g') AS text FROM a
    """,
)
def redact_models(t):
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("turn") % 6 + 1).cast("int"))
    return t.conversations.select(
        "conv_id", "turn", T.redact_models(F.concat("text", F.lit(" said "), name)).alias("text")
    )


@query(
    "answer_checks",
    f"""
    SELECT doc_id, {Q.any_of('lower(text)', C.NO_DATA_ANSWER_PHRASES)} AS no_data,
      {Q.any_of('lower(text)', C.NO_DATA_ITEM_PHRASES)} AS no_data_item,
      regexp_matches(text, '[0-9]') AS needs_check,
      CASE WHEN regexp_matches(text, '[0-9]') THEN NULL ELSE CAST(8 AS BIGINT) END AS rating
    FROM (SELECT doc_id, text || CASE WHEN doc_id % 4 = 0 THEN ' There is No Data on it.'
      WHEN doc_id % 4 = 1 THEN ' No relevant documents.' ELSE '' END AS text FROM documents)
    """,
)
def answer_checks(t):
    from ..operators import verify

    k = F.col("doc_id") % 4
    note = F.when(k == 0, F.lit(" There is No Data on it.")).when(
        k == 1, F.lit(" No relevant documents.")
    ).otherwise(F.lit(""))
    answers = t.documents.select("doc_id", F.concat("text", note).alias("answer"))
    return verify.split_for_checking(answers).select(
        "doc_id", T.answer_has_no_data(F.col("answer")).alias("no_data"),
        T.item_has_no_data(F.col("answer")).alias("no_data_item"), "needs_check",
        F.col("rating").cast("long").alias("rating"),
    )


@query(
    "item_sets_nested",
    """
    SELECT o_orderkey, 'Revenue: ' || o_orderkey || ' / Cost [' || (o_orderkey % 7) || '] / Margin: 5%' AS items,
      CAST(3 AS BIGINT) AS n_items FROM orders
    """,
)
def item_sets_nested(t):
    """Lists inside up to 40 lists, with a null, brackets in texts and a repeated item."""
    key = F.col("o_orderkey")
    depth = (key % 40).cast("int")
    value = F.concat(
        F.repeat(F.lit("["), depth), F.lit('["Revenue: '), key.cast("string"), F.lit('", [null, "Cost ['),
        (key % 7).cast("string"), F.lit(']"], [[]]'), F.repeat(F.lit("]"), depth), F.lit(', "Margin: 5%", "Margin: 5%"]'),
    )
    nested = t.spread("orders").select("o_orderkey", J.item_set(F.try_parse_json(value)).alias("i"))
    return nested.select(
        "o_orderkey", F.array_join("i", " / ").alias("items"), F.size("i").cast("long").alias("n_items")
    )
