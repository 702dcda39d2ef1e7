"""Queries over questions, answers, charts and usage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import charts as H
from ..operators import documents as D
from ..operators import routing as P
from ..operators import usage
from ..operators import verify as V
from ..session import scratch_path
from ..sources import chatlog, files
from . import duck as Q
from .finance_queries import doubles
from .registry import query

ASKED = (
    "Draw a BAR chart of revenue", "visualize the trend by month", "Budget variance by row",
    "total net profit", "the difference in sums", "ارسم لي نسبة التحسّن", "barely lined up",
    "improvement rate breakdown share", "compare quarterly expenses", "pie of the split",
)


def pick(values, n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def pick_sql(values, n):
    return f"list_extract({Q.sql_list(values)}, CAST({n} % {len(values)} + 1 AS BIGINT))"


def question_log(t):
    """User turns as questions; the wording of a known kind is put in front."""
    return t.conversations.filter(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.concat(pick(ASKED, F.col("conv_id") + F.col("turn")), F.lit(" — "), "text").alias("text"),
    )


ASKED_SQL = f"""
    q AS (SELECT conv_id * 1000 + turn AS query_id, {pick_sql(ASKED, '(conv_id + turn)')} || ' — ' || text AS text
      FROM conversations WHERE role = 'user'),
    n AS (SELECT query_id, text, lower(text) AS low, regexp_replace(lower(text),
        '[\\x{{0610}}-\\x{{061A}}\\x{{064B}}-\\x{{065F}}\\x{{0670}}\\x{{06D6}}-\\x{{06ED}}\\x{{0640}}]', '', 'g') AS plain FROM q)
"""
_LATIN = "|".join(k + (f"[{Q.W}]*" if k.endswith("iz") else "") for k in C.CHART_KEYWORDS if k.isascii())
_OTHER = [k for k in C.CHART_KEYWORDS if not k.isascii()]


@query(
    "classify_queries",
    f"""WITH {ASKED_SQL},
    k AS (SELECT *, CASE WHEN NOT {Q.any_of('low', C.AGGREGATION_KEYWORDS)} THEN 'none'
        WHEN {Q.any_of('low', C.VARIANCE_KEYWORDS)} THEN 'variance_pct' WHEN {Q.any_of('low', C.NET_KEYWORDS)} THEN 'net'
        WHEN {Q.any_of('low', C.DIFFERENCE_KEYWORDS)} THEN 'difference' ELSE 'sum' END AS aggregation_type,
        length(regexp_replace(text, '[^\\x{{0600}}-\\x{{06FF}}]', '', 'g')) AS ar,
        length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS la FROM n)
    SELECT query_id, regexp_matches(low, '(^|[^{Q.W}])({_LATIN})($|[^{Q.W}])') OR {Q.any_of('low', _OTHER)} AS wants_chart,
      aggregation_type <> 'none' AS needs_aggregation, aggregation_type,
      CASE WHEN ar > 0 AND ar >= la THEN 'Arabic' ELSE 'English' END AS language,
      {Q.any_of('plain', C.IMPROVEMENT_PHRASES)} AS asks_improvement, {Q.any_of('low', C.TABLE_KEYWORDS)} AS asks_table FROM k""",
)
def classify_queries(t):
    return P.classify_queries(question_log(t)).drop("text")


@query(
    "route_queries",
    f"""WITH {ASKED_SQL},
    s AS (SELECT 'nation ' || n_nationkey || '.csv' AS source, count(c_custkey) <= 60 AS small FROM nation
      LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey UNION ALL SELECT 'deck.pdf', false),
    h AS (SELECT conv_id * 1000 + turn - 1 AS query_id, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL),
    r AS (SELECT query_id, coalesce(h.n, 0) AS found, {Q.any_of('low', C.TABLE_KEYWORDS)} AND any_small AS full_table, n_small
      FROM n LEFT JOIN h USING (query_id), (SELECT bool_or(small) AS any_small, count(*) FILTER (small) AS n_small FROM s))
    SELECT query_id, CASE WHEN full_table THEN 'ANSWER_FROM_FULL_TABLE' WHEN found > 0 THEN 'ANSWER_FROM_CONTEXT'
        ELSE 'REPORT_NOT_FOUND' END AS action,
      CASE WHEN full_table OR found > 0 THEN 'verified' ELSE 'not_found' END AS context_status,
      CASE WHEN full_table THEN n_small ELSE found END AS n_documents FROM r""",
)
def route_queries(t):
    per_nation = t.nation.join(
        t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    ).groupBy("n_nationkey").agg((F.count("c_custkey") <= 60).alias("is_small"))
    tables = per_nation.select(
        F.concat(F.lit("nation "), F.col("n_nationkey").cast("string"), F.lit(".csv")).alias("path"), "is_small"
    )
    deck = t.region.agg(F.lit("deck.pdf").alias("path"), (F.count(F.lit(1)) < 0).alias("is_small"))
    sources = files.file_manifest(tables.unionByName(deck)).select("source", "is_structured", "is_small")
    hits = t.conversations.filter(F.col("role") == "assistant").select(
        (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("query_id")
    )
    return P.route_queries(question_log(t), sources, hits).drop("text")


@query(
    "dedupe_variants",
    """
    WITH v AS (SELECT conv_id AS query_id, turn * 3 + k AS pos, CASE k WHEN 0 THEN text WHEN 1 THEN ' ' || lower(text) || chr(10) ELSE
        CASE WHEN turn % 2 = 0 THEN '  ' ELSE 'about ' || (turn // 4) END END AS text FROM conversations, (SELECT unnest([0, 1, 2]) AS k)),
    k AS (SELECT *, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS key FROM v),
    f AS (SELECT query_id, min(pos) AS pos, arg_min(text, pos) AS text FROM k WHERE key <> '' GROUP BY query_id, key)
    SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS variant FROM f
    """,
)
def dedupe_variants(t):
    turn, text = F.col("turn"), F.col("text")
    about = F.when(turn % 2 == 0, F.lit("  ")).otherwise(
        F.concat(F.lit("about "), F.floor(turn / 4).cast("string"))
    )
    variants = t.conversations.select(
        F.col("conv_id").alias("query_id"), "turn",
        F.posexplode(F.array(text, F.concat(F.lit(" "), F.lower(text), F.lit("\n")), about)).alias("k", "text"),
    ).select("query_id", (F.col("turn") * 3 + F.col("k")).alias("pos"), "text")
    return P.dedupe_variants(variants)


# answers and checks -------------------------------------------------------------

CLAIMED = ("bank statement", "the ledger file", "", "Budget 2024", "region AFRICA.csv", "orders pdf")
ACTUAL = ("test_1_bank_statement.csv", "q1 ledger.csv", "budget.xlsx", "orders_2-HIGH.csv", "")


def number_checks(t):
    """Line items as number checks of the orders' answers, two attempts each."""
    line = F.col("l_linenumber")
    return t.spread("lineitem").select(
        F.col("l_orderkey").alias("answer_id"), (F.col("l_partkey") % 2 + 1).alias("attempt"),
        F.format_number("l_extendedprice", 0).alias("number_in_answer"),
        F.when(F.col("l_quantity") > 47, F.lit(" not_found_in_sources ")).otherwise(F.col("l_linestatus")).alias("row_label_in_source"),
        (F.col("l_suppkey") % 9 != 0).alias("matches_question_intent"),
        pick(CLAIMED, F.col("l_partkey")).alias("source_file_claimed"),
        pick(ACTUAL, line).alias("source_file_actual"),
    )


_TOK = "list_filter(list_filter(string_split_regex({0}, '[^a-z0-9]+'), lambda x: x <> ''), lambda x: NOT list_contains(" + Q.sql_list(C.SOURCE_NAME_NOISE) + ", x))"
CHECKS = f"""
    k AS (SELECT l_orderkey AS answer_id, l_partkey % 2 + 1 AS attempt,
        format('{{:,}}', CAST(round_even(l_extendedprice, 0) AS BIGINT)) AS number,
        CASE WHEN l_quantity > 47 THEN ' not_found_in_sources ' ELSE l_linestatus END AS label,
        l_suppkey % 9 <> 0 AS intent, {pick_sql(CLAIMED, 'l_partkey')} AS claimed, {pick_sql(ACTUAL, 'l_linenumber')} AS actual FROM lineitem),
    m AS (SELECT *, lower(claimed) AS c, lower(actual) AS a, {_TOK.format('lower(claimed)')} AS ct, {_TOK.format('lower(actual)')} AS at_ FROM k),
    x AS (SELECT *, NOT (c = '' OR a = '' OR contains(a, c) OR contains(c, a) OR (len(ct) > 0 AND list_has_all(at_, ct))
        OR (contains(c, 'bank statement') AND list_has_all(at_, ['bank', 'statement']))
        OR (contains(c, 'ledger') AND list_has_all(at_, ['ledger'])) OR (contains(c, 'budget') AND list_has_all(at_, ['budget']))) AS conflict FROM m),
    y AS (SELECT *, NOT intent OR upper(trim(label)) = 'NOT_FOUND_IN_SOURCES' OR conflict AS bad,
        CASE WHEN conflict THEN number || ' claimed from source ''' || claimed || ''' but matched source ''' || actual || ''''
          ELSE number || ' attributed to ''' || label || ''' which does not match the question''s intent' END AS note FROM x)
"""


@query(
    "number_checks",
    f"WITH {CHECKS} SELECT answer_id, attempt, number AS number_in_answer, claimed AS source_file_claimed, actual AS source_file_actual, conflict, bad AS is_bad, CASE WHEN bad THEN note END AS note FROM y",
)
def check_outcomes(t):
    return V.check_outcomes(number_checks(t)).drop("row_label_in_source", "matches_question_intent")


def attempts(t):
    """Two attempts per order, rated from its price, with missing references."""
    o = t.orders
    key = F.col("o_orderkey")
    return o.select(
        key.alias("answer_id"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("attempt"), "o_custkey", "o_orderstatus",
    ).select(
        "answer_id", "attempt",
        F.pmod(F.col("o_custkey") + F.col("attempt") * 3, F.lit(11)).alias("rating"),
        (F.col("o_orderstatus") != "F").alias("passed"),
        F.when(F.col("o_orderstatus") == "O", F.array(F.lit("page 3"))).alias("missing_refs"),
    )


ATTEMPTS = """
    t AS (SELECT o_orderkey AS answer_id, attempt, (o_custkey + attempt * 3) % 11 AS rating, o_orderstatus <> 'F' AS passed,
        CASE WHEN o_orderstatus = 'O' THEN ['page 3'] ELSE [] END AS refs FROM orders, (SELECT unnest([1, 2]) AS attempt)),
    z AS (SELECT answer_id, attempt, list_sort(list(DISTINCT note)) AS notes FROM y WHERE bad GROUP BY ALL),
    r AS (SELECT answer_id, attempt, CASE WHEN notes IS NOT NULL THEN least(rating, 4) ELSE rating END AS rating,
        passed AND notes IS NULL AS passed, list_concat(refs, coalesce(notes, [])) AS missing_refs
      FROM t LEFT JOIN z USING (answer_id, attempt))
"""


@query(
    "verification_rollup",
    f"WITH {CHECKS}, {ATTEMPTS} SELECT answer_id, CAST(attempt AS BIGINT) AS attempt, rating, passed, array_to_string(missing_refs, '; ') AS missing_refs FROM r",
)
def verification_rollup(t):
    return V.verification_rollup(attempts(t), number_checks(t)).withColumn(
        "missing_refs", F.array_join("missing_refs", "; ")
    )


@query(
    "best_attempt",
    f"""WITH {CHECKS}, {ATTEMPTS} SELECT answer_id, CAST(arg_max(attempt, rating * 10 - attempt) AS BIGINT) AS attempt, max(rating) AS rating,
      arg_max(passed, attempt) AS converged, count(*) AS attempts_made,
      CASE WHEN max(rating) >= 8 THEN 'High' WHEN max(rating) >= 5 THEN 'Medium' ELSE 'Low' END AS confidence FROM r GROUP BY answer_id""",
)
def best_attempt(t):
    return V.best_attempt(V.verification_rollup(attempts(t), number_checks(t)))


@query(
    "remove_unverified_numbers",
    """
    WITH a AS (SELECT o_orderkey AS id, 'Order total is ' || format('{:,.2f}', o_totalprice) || ' SAR.' || chr(10)
        || 'Priority ' || o_orderpriority || chr(10) || 'Customer ' || o_custkey || ' owes 12.' AS answer FROM orders),
    c AS (SELECT o_orderkey AS id, pos, CASE pos WHEN 1 THEN format('{:,.2f}', o_totalprice) ELSE CAST(o_custkey AS VARCHAR) END AS number
      FROM orders, (SELECT unnest([1, 2]) AS pos)
      WHERE (pos = 1 AND o_orderstatus = 'F') OR (pos = 2 AND o_orderpriority LIKE '%L%')),
    g AS (SELECT id, list(number ORDER BY pos) AS numbers FROM c GROUP BY id),
    k AS (SELECT a.id, answer, numbers, list_filter(string_split(answer, chr(10)),
        lambda l: len(list_filter(coalesce(numbers, []), lambda n: contains(l, n))) = 0) AS kept FROM a LEFT JOIN g USING (id))
    SELECT id AS answer_id, CASE WHEN numbers IS NULL THEN answer ELSE
      CASE WHEN len(kept) > 0 THEN trim(array_to_string(kept, chr(10))) || chr(10) || chr(10) ELSE '' END
      || array_to_string(list_transform(numbers, lambda n: 'The figure ' || n || ' was not found in the provided data.'), chr(10)) END AS answer FROM k
    """,
)
def remove_unverified_numbers(t):
    total = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    answers = t.orders.select(
        F.col("o_orderkey").alias("answer_id"),
        F.concat(F.lit("Order total is "), total, F.lit(" SAR.\nPriority "), "o_orderpriority",
                 F.lit("\nCustomer "), F.col("o_custkey").cast("string"), F.lit(" owes 12.")).alias("answer"),
    )
    missing = lambda when: F.when(when, F.lit("NOT_FOUND_IN_SOURCES")).otherwise(F.lit("row"))
    checks = t.orders.select(
        F.col("o_orderkey").alias("answer_id"),
        F.inline(F.array(
            F.struct(F.lit(1).alias("pos"), total.alias("number_in_answer"),
                     missing(F.col("o_orderstatus") == "F").alias("row_label_in_source")),
            F.struct(F.lit(2).alias("pos"), F.col("o_custkey").cast("string").alias("number_in_answer"),
                     missing(F.col("o_orderpriority").contains("L")).alias("row_label_in_source")),
        )),
    )
    return V.remove_unverified_numbers(answers, checks)


@query(
    "conflicting_claims",
    """
    SELECT user_id AS answer_id, event_type AS entity, 'value' AS attribute, count(*) AS n_claims,
      min(CAST(value AS DECIMAL(18,0)))::DOUBLE AS lowest, max(CAST(value AS DECIMAL(18,0)))::DOUBLE AS highest
    FROM events GROUP BY ALL HAVING min(CAST(value AS DECIMAL(18,0))) <> max(CAST(value AS DECIMAL(18,0)))
    """,
)
def conflicting_claims(t):
    claims = t.events.select(
        F.col("user_id").alias("answer_id"), F.col("event_type").alias("entity"),
        F.lit("value").alias("attribute"), F.col("value").cast("decimal(18,0)").alias("value"),
    )
    return doubles(V.conflicting_claims(claims), "lowest", "highest")


# charts -------------------------------------------------------------------------

def monthly(t):
    """Order totals per customer and period or priority, as chart series."""
    key = F.col("o_custkey")
    label = F.when(key % 3 == 0, F.date_format("o_orderdate", "yyyy-MM")).when(
        key % 3 == 1, F.col("o_orderpriority")
    ).otherwise(F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")))
    value = F.when(key % 7 == 0, -F.col("o_totalprice")).when(key % 11 != 0, F.col("o_totalprice"))
    return t.orders.select(key.alias("query_id"), label.alias("label"), value.cast("decimal(18,2)").alias("v")).groupBy(
        "query_id", "label"
    ).agg(F.sum("v").alias("value"))


SHAPES = """
    o AS (SELECT o_custkey AS query_id, CASE o_custkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN o_orderpriority
        ELSE 'Q' || quarter(o_orderdate) END AS label, CASE WHEN o_custkey % 7 = 0 THEN -o_totalprice WHEN o_custkey % 11 <> 0 THEN o_totalprice END AS v FROM orders),
    s AS (SELECT query_id, label, sum(CAST(v AS DECIMAL(18,2))) AS value FROM o GROUP BY ALL),
    sh AS (SELECT query_id, count(*) AS n_points, count(label) AS n_labels,
        count(*) FILTER (query_id % 3 <> 1) AS n_time, bool_or(value IS NULL) AS has_gaps, coalesce(bool_or(value < 0), false) AS has_negatives,
        n_labels >= 2 AND n_time >= greatest(2, ceil(n_labels * 0.5)) AS is_time_series FROM s GROUP BY query_id)
"""


@query("chart_shape", f"WITH {SHAPES} SELECT * FROM sh")
def chart_shape(t):
    return H.chart_shape(monthly(t))


CHART_ASKS = (
    "show the trend", "breakdown of expenses", "share of total as pie", "area chart over time", "improvement rate pie",
    "compare deals", "a line please", "bar it", "monthly distribution mix", "whatever",
)


def _fallback_sql():
    f = lambda words: Q.any_of("ask", words)
    return (
        f"CASE WHEN {f(C.IMPROVEMENT_PHRASES)} THEN 'bar' WHEN {f(C.AREA_WORDS)} THEN 'area' WHEN {f(C.PIE_WORDS)} THEN 'pie'"
        f" WHEN {f(C.LINE_WORDS)} THEN 'line' WHEN {f(C.BAR_WORDS)} THEN 'bar' WHEN {f(C.TREND_WORDS)} THEN 'line'"
        f" WHEN {f(C.COMPARE_WORDS)} THEN CASE WHEN n_points <= 6 THEN 'pie' ELSE 'bar' END ELSE 'bar' END"
    )


@query(
    "recommend_chart",
    f"""WITH {SHAPES}, w AS (SELECT *, {pick_sql(CHART_ASKS, 'query_id')} AS ask FROM sh),
    g AS (SELECT *, {_fallback_sql()} AS wanted FROM w)
    SELECT query_id, CASE WHEN {Q.any_of('ask', C.IMPROVEMENT_PHRASES)} THEN 'bar'
      WHEN wanted IN ('line', 'area') AND NOT is_time_series THEN 'bar'
      WHEN wanted = 'pie' AND NOT ({Q.any_of('ask', C.PIE_INTENT_WORDS)} AND n_points BETWEEN 2 AND 6
        AND NOT is_time_series AND NOT has_gaps AND NOT has_negatives) THEN 'bar' ELSE wanted END AS chart_type FROM g""",
)
def recommend_chart(t):
    shapes = H.chart_shape(monthly(t)).withColumn("text", pick(CHART_ASKS, F.col("query_id")))
    return H.recommend_chart(shapes).select("query_id", "chart_type")


@query(
    "improvement_rates",
    """
    WITH s AS (SELECT l_suppkey AS k, 'Measured dimension: skill ' || (l_partkey % 40) || ' | gap: 1.5 | '
        || CASE WHEN l_linenumber % 2 = 0 THEN 'Improvement rate: +' ELSE 'improvement percentage: -' END
        || format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)) || '.5' || CASE WHEN l_tax < 0.05 THEN '%' ELSE '' END AS content,
        l_orderkey * 10000000 + l_partkey * 1000 + l_suppkey * 10 + l_linenumber AS ord,
        'skill ' || (l_partkey % 40) AS label, l_tax < 0.05 AS ok,
        CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END * (floor(l_extendedprice) + 0.5) AS value FROM lineitem)
    SELECT k AS query_id, label, CAST(arg_min(value, (ord, value)) AS DOUBLE) AS value, '%' AS currency FROM s WHERE ok GROUP BY k, label
    """,
)
def improvement_rates(t):
    n = F.col("l_linenumber")
    rows = t.spread("lineitem").select(
        F.col("l_suppkey").alias("query_id"),
        F.concat(
            F.lit("Measured dimension: skill "), (F.col("l_partkey") % 40).cast("string"), F.lit(" | gap: 1.5 | "),
            F.when(n % 2 == 0, F.lit("Improvement rate: +")).otherwise(F.lit("improvement percentage: -")),
            F.format_number(F.floor("l_extendedprice"), 0), F.lit(".5"),
            F.when(F.col("l_tax") < 0.05, F.lit("%")).otherwise(F.lit("")),
        ).alias("content"),
        F.struct(
            (F.col("l_orderkey") * 10000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") * 10 + n).alias("ord"),
            (F.when(n % 2 == 0, 1).otherwise(-1) * F.floor("l_extendedprice")).alias("tie"),
        ).alias("place"),
    )
    return H.extract_improvements(rows, ["query_id"], "place").drop("place")


@query(
    "clean_series",
    """
    WITH r AS (SELECT o_custkey AS query_id, o_orderkey AS pos, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'deal ' || (o_orderkey % 97) END AS label,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) END AS value,
        CASE WHEN o_orderkey % 2 = 0 THEN 'USD' ELSE 'SAR' END AS currency FROM orders)
    SELECT query_id, label, arg_min(value, pos) AS value, arg_min(currency, pos) AS currency FROM r
    WHERE label IS NOT NULL AND value IS NOT NULL GROUP BY ALL
    """,
)
def clean_series(t):
    """Each order as one reply with a single entry, in mixed spellings."""
    key = F.col("o_orderkey")
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    text = F.when(key % 2 == 0, F.concat(F.lit("$"), F.format_number(amount, 2))).otherwise(amount.cast("string"))
    entry = F.concat(
        F.lit('```json\n[{" Label": '), F.when(key % 5 == 0, F.lit('""')).otherwise(F.concat(F.lit('"deal '), (key % 97).cast("string"), F.lit('"'))),
        F.lit(', "'), F.when(key % 3 == 0, F.lit("AMOUNT")).otherwise(F.lit("value")), F.lit('": '),
        F.when(key % 7 == 0, F.lit('"n/a"')).otherwise(F.concat(F.lit('"'), text, F.lit('"'))),
        F.when(key % 2 == 0, F.lit(', "currency": "USD"')).otherwise(F.lit("")), F.lit("}]\n```"),
    )
    replies = t.spread("orders").select(F.col("o_custkey").alias("query_id"), key.alias("reply_no"), entry.alias("reply"))
    series = H.clean_series(replies, keys=["query_id", "reply_no"])
    return H.first_per_label(
        series.select("query_id", "label", "reply_no", "value", "currency"), ["query_id", "label"], "reply_no"
    ).drop("reply_no")


@query(
    "clean_rows",
    """
    WITH r AS (SELECT o_custkey AS query_id, o_orderkey AS pos, trim(CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE ' ' || o_orderpriority END) AS label,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) END AS value FROM orders)
    SELECT query_id, label, arg_min(value, pos) AS value FROM r WHERE label <> '' AND value IS NOT NULL GROUP BY ALL
    """,
)
def clean_rows(t):
    key = F.col("o_orderkey")
    text = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    cells = t.orders.select(
        F.col("o_custkey").alias("query_id"), key.alias("pos"),
        F.when(key % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "o_orderpriority")).alias("label"),
        F.when(key % 7 == 0, F.lit("about ten")).when(key % 2 == 0, F.concat(F.lit("﷼ "), text, F.lit(" Million")))
        .otherwise(F.concat(F.lit("$"), text, F.lit("bn"))).alias("value"),
    )
    return H.clean_rows(cells).drop("pos")


# chat log and usage ---------------------------------------------------------------

def chat_entries(t):
    """Turns as log entries; system turns hold broken JSON."""
    text = F.col("text")
    body = F.to_json(F.struct(
        F.when(F.col("role") == "user", text).alias("question"), F.when(F.col("role") != "user", text).alias("answer"),
        F.when(F.col("turn") % 4 == 1, F.array(F.lit("chunk"), F.col("role"))).alias("source_chunks"),
        F.when(F.col("turn") % 2 == 1, F.array(F.lit("p.1"))).alias("source_pages"),
        F.when(F.col("turn") % 3 == 1, F.lit("reference")).alias("reference_answer"),
    ))
    return t.conversations.select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("id"),
        F.when(F.col("role") == "system", F.concat(F.lit("{broken "), body)).otherwise(body).alias("entry_json"),
        F.col("turn").cast("double").alias("created_at"),
    )


@query(
    "chat_history",
    """
    WITH c AS (SELECT conv_id, min(turn) FILTER (role = 'system') AS upto FROM conversations GROUP BY conv_id)
    SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS id, md5(text) AS text_md5 FROM conversations JOIN c USING (conv_id)
    WHERE role <> 'system' AND (upto IS NULL OR turn > upto + 1)
    """,
)
def chat_history(t):
    """Readable entries after the sessions with a system turn were cleared."""
    cleared = t.conversations.filter(F.col("role") == "system").select(
        F.col("conv_id").cast("string").alias("session_id"), (F.col("turn") + 1).alias("up_to")
    )
    entries = chatlog.readable(chatlog.drop_cleared(chat_entries(t), cleared))
    body = F.coalesce(F.get_json_object("entry_json", "$.question"), F.get_json_object("entry_json", "$.answer"))
    return entries.select("session_id", "id", F.md5(body).alias("text_md5"))


def _stored_chat(t):
    """A store that got even and odd turns as two batches, the first of them twice."""
    path = scratch_path(t.spark, "chat")
    for batch in ("even", "odd", "even"):
        chatlog.append_entries(chat_entries(t).filter(F.col("id") % 2 == int(batch == "odd")), path, batch)
    return path


def _chat_rows(entries):
    body = F.coalesce(F.get_json_object("entry_json", "$.question"), F.get_json_object("entry_json", "$.answer"))
    return entries.select("session_id", "id", F.md5(body).alias("text_md5"))


@query(
    "chat_store_history",
    "SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS id, md5(text) AS text_md5 FROM conversations WHERE role <> 'system'",
)
def chat_store_history(t):
    """Everything readable in a store whose first batch was appended twice."""
    return _chat_rows(chatlog.load_all_history(t.spark, _stored_chat(t)))


@query(
    "chat_store_cleared",
    """
    WITH s AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system')
    SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS id, md5(text) AS text_md5 FROM conversations
    WHERE role <> 'system' AND conv_id NOT IN (SELECT conv_id FROM s)
    UNION ALL SELECT CAST(conv_id AS VARCHAR), turn + 1000, md5(text) FROM conversations
    WHERE role <> 'system' AND conv_id IN (SELECT conv_id FROM s)
    """,
)
def chat_store_cleared(t):
    """Sessions with a system turn cleared, then continued."""
    path = _stored_chat(t)
    cleared = t.conversations.filter(F.col("role") == "system").select(F.col("conv_id").cast("string").alias("session_id"))
    chatlog.clear_sessions(cleared, path)
    more = chat_entries(t).join(cleared.distinct(), "session_id", "left_semi").withColumn("id", F.col("id") + 1000)
    chatlog.append_entries(more, path, "continued")
    return _chat_rows(chatlog.load_all_history(t.spark, path))


@query(
    "chart_preview",
    """
    SELECT o_orderpriority AS series, pos, CAST(o_custkey AS VARCHAR) AS label, value FROM (
      SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY value DESC, o_custkey) - 1 AS pos FROM (
        SELECT o_orderpriority, o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders GROUP BY ALL))
    WHERE pos < 50
    """,
)
def chart_preview(t):
    """The first fifty points of every series, customers by what they ordered."""
    points = t.orders.groupBy(F.col("o_orderpriority").alias("series"), "o_custkey").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value")
    )
    falling = Window.partitionBy("series").orderBy(F.desc("value"), "o_custkey")
    numbered = points.withColumn("pos", (F.row_number().over(falling) - 1).cast("long"))
    return H.chart_preview(numbered).select("series", "pos", F.col("o_custkey").cast("string").alias("label"), "value")


@query(
    "json_lines_round_trip",
    """
    SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS id, role <> 'system' AS readable, md5(CASE WHEN role = 'system' THEN NULL ELSE text END) AS text_md5 FROM conversations
    """,
)
def json_lines_round_trip(t):
    """Entries written as JSON lines and read back record by record."""
    path = scratch_path(t.spark, "records")
    files.write_results(chat_entries(t), path)
    field = lambda name: F.get_json_object("entry_json", f"$.{name}")
    inner = field("entry_json")
    return files.read_records(t.spark, path).select(
        field("session_id").alias("session_id"), field("id").cast("long").alias("id"),
        F.try_parse_json(inner).isNotNull().alias("readable"),
        F.md5(F.coalesce(F.get_json_object(inner, "$.question"), F.get_json_object(inner, "$.answer"))).alias("text_md5"),
    )


@query(
    "csv_results",
    """
    SELECT CAST(user_id AS VARCHAR) AS user_id, '[' || string_agg('"' || event_type || '"', ',' ORDER BY event_type) || ']' AS kinds,
      '{"n":' || sum(n) || ',"top":' || max(n) || '}' AS counts
    FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id
    """,
)
def csv_results(t):
    """Nested columns written to CSV as JSON text, and read back."""
    per_kind = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    rows = per_kind.groupBy("user_id").agg(
        F.array_sort(F.collect_set("event_type")).alias("kinds"),
        F.struct(F.sum("n").alias("n"), F.max("n").alias("top")).alias("counts"),
    )
    path = scratch_path(t.spark, "results")
    files.write_results(rows, path, "csv")
    return t.spark.read.option("header", True).option("escape", '"').csv(path)


@query(
    "last_turns",
    """
    SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS id, CASE WHEN role = 'user' THEN text ELSE '' END AS question,
      CASE WHEN role = 'user' THEN '' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS answer FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role <> 'system')
    WHERE back <= 6
    """,
)
def last_turns(t):
    return chatlog.last_turns(chatlog.readable(chat_entries(t)))


@query(
    "export_records",
    """
    SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS id, CASE WHEN role = 'user' THEN text ELSE '' END AS question,
      CASE WHEN role = 'user' THEN '' ELSE text END AS generated_answer,
      CASE WHEN turn % 4 = 1 THEN '["chunk","' || role || '"]' END AS source_chunks,
      CASE WHEN turn % 2 = 1 AND turn % 4 <> 1 THEN '["p.1"]' END AS retrieved_context,
      CASE WHEN turn % 3 = 1 THEN 'reference' END AS reference_answer FROM conversations WHERE role <> 'system'
    """,
)
def export_records(t):
    return chatlog.export_records(chatlog.readable(chat_entries(t)))


def model_calls(t):
    """Events as model calls: the type is the model, the value the text size."""
    return t.events.select(
        F.col("event_id").alias("call_id"), F.col("event_type").alias("model"), "ts",
        usage.estimate_tokens(F.floor(F.col("value") * 300)).alias("tokens"),
    )


@query(
    "token_budget",
    """
    WITH c AS (SELECT event_id, event_type AS model, epoch_us(ts) AS us, greatest(1, CAST(floor(floor(value * 300) / 3) AS BIGINT)) AS tokens FROM events),
    u AS (SELECT *, sum(tokens) OVER w AS used, count(*) OVER w AS n FROM c
      WINDOW w AS (PARTITION BY model ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW))
    SELECT event_id AS call_id, model, tokens, CAST(used AS BIGINT) AS used_tokens, used > 7200 AND n > 1 AS over_budget FROM u
    """,
)
def token_budget(t):
    return usage.token_budget(model_calls(t)).drop("ts")


@query(
    "labelled_sources",
    """
    SELECT '[Source: orders ' || o_orderpriority || '.csv | Row ' || row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) || ']' AS label FROM orders
    """,
)
def labelled_sources(t):
    from .document_queries import order_table

    docs = D.union_documents(D.row_documents(order_table(t), "source", ["entry_id"]))
    return docs.select(D.context_label().alias("label"))


