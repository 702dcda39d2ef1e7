"""Queries that compute figures from ledgers, budgets and invoices."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import documents as D
from ..operators import finance as A
from . import duck as Q
from .document_queries import order_table
from .registry import query


def doubles(df, *columns):
    """Exact decimals as doubles for the comparison; no total of these tables overflows."""
    return df.drop("overflow").withColumns({c: F.col(c).cast("double") for c in columns})


def budget_rows(t):
    """Line items as budget lines: budget is the price, actual the discounted one."""
    flag = F.col("l_returnflag")
    return t.lineitem.select(
        F.concat(F.lit("budget "), "l_linestatus", F.lit(".xlsx")).alias("source"),
        F.when(flag == "A", "Expense").when(flag == "R", "REVENUE").otherwise("other").alias("type"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("budget"),
        (F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)")))
        .cast("decimal(18,2)").alias("actual"),
        (F.col("l_suppkey") % 50).alias("line"),
    )


BUDGET = """
    b AS (SELECT 'budget ' || l_linestatus || '.xlsx' AS source,
        CASE l_returnflag WHEN 'A' THEN 'expense' WHEN 'R' THEN 'revenue' ELSE 'other' END AS type,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS budget,
        CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2)) AS actual,
        l_suppkey % 50 AS line FROM lineitem)
"""


@query(
    "budget_actual_summary",
    f"""WITH {BUDGET},
    s AS (SELECT source, sum(budget) FILTER (type = 'expense') AS be, sum(actual) FILTER (type = 'expense') AS ae,
        sum(budget) FILTER (type = 'revenue') AS br, sum(actual) FILTER (type = 'revenue') AS ar FROM b GROUP BY source)
    SELECT source, CAST(be AS DOUBLE) AS budget_expenses, CAST(ae AS DOUBLE) AS actual_expenses,
      CAST(br AS DOUBLE) AS budget_revenue, CAST(ar AS DOUBLE) AS actual_revenue,
      CAST(br - be AS DOUBLE) AS budget_net, CAST(ar - ae AS DOUBLE) AS actual_net FROM s""",
)
def budget_actual_summary(t):
    return doubles(
        A.budget_actual_summary(budget_rows(t)),
        "budget_expenses", "actual_expenses", "budget_revenue", "actual_revenue", "budget_net", "actual_net",
    )


@query(
    "budget_variance",
    f"""WITH {BUDGET}, s AS (SELECT source, line, sum(budget) AS bu, sum(actual) AS ac FROM b GROUP BY ALL)
    SELECT source, line, CAST(bu AS DOUBLE) AS budget, CAST(ac AS DOUBLE) AS actual,
      CAST(ac - bu AS DOUBLE) AS variance,
      CAST(round(CAST(100 * CAST(ac - bu AS DOUBLE) / CAST(bu AS DOUBLE) AS DECIMAL(38,6)), 2) AS DOUBLE) AS variance_pct
    FROM s""",
)
def budget_variance(t):
    return doubles(
        A.variance(budget_rows(t), ["source", "line"]), "budget", "actual", "variance", "variance_pct"
    )


EXACT = """
    r AS (SELECT o_orderkey, o_orderpriority || '.csv' AS source,
        CASE WHEN o_orderkey % 5 = 0 THEN 'expense' ELSE 'revenue' END AS type,
        CASE o_orderkey % 4 WHEN 0 THEN (12345678901234567 + o_orderkey)::VARCHAR || '.5'
          WHEN 1 THEN '-' || (o_orderkey % 1000)::VARCHAR || '.005' WHEN 2 THEN '0.000000000001' ELSE '1.005' END AS budget,
        CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 64 = 0 THEN repeat('9', 30)
          ELSE (o_orderkey % 7)::VARCHAR || '.125' END AS actual FROM orders),
    v AS (SELECT source, type, CAST(budget AS DECIMAL(38,12)) AS budget,
        CASE WHEN length(actual) < 30 THEN CAST(actual AS DECIMAL(38,12)) END AS actual, length(actual) = 30 AS wide FROM r)
"""


@query(
    "totals_exact",
    f"""WITH {EXACT},
    s AS (SELECT source, sum(budget) FILTER (type = 'expense') AS be, sum(actual) FILTER (type = 'expense') AS ae,
        sum(budget) FILTER (type = 'revenue') AS br, sum(actual) FILTER (type = 'revenue') AS ar, bool_or(wide) AS overflow
      FROM v GROUP BY source)
    SELECT source, CAST(be AS VARCHAR) AS budget_expenses, CAST(ae AS VARCHAR) AS actual_expenses,
      CAST(br AS VARCHAR) AS budget_revenue, CAST(ar AS VARCHAR) AS actual_revenue, overflow,
      CAST(br - be AS VARCHAR) AS budget_net, CAST(ar - ae AS VARCHAR) AS actual_net FROM s""",
)
def totals_exact(t):
    """Amounts of 17 digits, of thousandths and less, and some too wide for any total."""
    key, remainder = F.col("o_orderkey"), F.col("o_orderkey") % 4
    budget = (
        F.when(remainder == 0, F.concat((F.lit(12345678901234567) + key).cast("string"), F.lit(".5")))
        .when(remainder == 1, F.concat(F.lit("-"), (key % 1000).cast("string"), F.lit(".005")))
        .when(remainder == 2, "0.000000000001").otherwise("1.005")
    )
    wide = (F.col("o_orderpriority") == "1-URGENT") & (key % 64 == 0)
    actual = F.when(wide, "9" * 30).otherwise(F.concat((key % 7).cast("string"), F.lit(".125")))
    row = F.concat(
        F.lit("type: "), F.when(key % 5 == 0, "expense").otherwise("revenue"),
        F.lit(" | budget_sar: "), budget, F.lit(" | actual_sar: "), actual,
    )
    docs = D.union_documents(t.orders.select(F.concat("o_orderpriority", F.lit(".csv")).alias("source"), row.alias("content")))
    sums = A.budget_actual_summary(A.ledger_columns(A.parse_row_sentences(docs)))
    return sums.select("source", "overflow", *[F.col(c).cast("string").alias(c) for c in sums.columns if c[:7] in ("budget_", "actual_")])


def payments(t):
    """Orders as entries of bank statements (three priorities) and ledgers."""
    p = F.col("o_orderpriority")
    return t.orders.select(
        F.when(p.isin("1-URGENT", "2-HIGH"), F.concat(F.lit("Bank_"), p, F.lit(".csv")))
        .when(p == "3-MEDIUM", F.lit("statement.csv"))
        .otherwise(F.concat(F.lit("ledger "), p, F.lit(".csv"))).alias("source"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.when(F.col("o_orderstatus") == "F", "Invoice").when(F.col("o_orderstatus") == "O", "pipeline")
        .otherwise("note").alias("record_type"),
        F.year("o_orderdate").cast("string").alias("stage_year"),
        (p != "5-LOW").alias("has_record_type"),
        F.col("o_orderkey").alias("row"),
        F.col("o_custkey").alias("customer_key"),
    )


PAYMENTS = """
    p AS (SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Bank_' || o_orderpriority || '.csv'
        WHEN o_orderpriority = '3-MEDIUM' THEN 'statement.csv' ELSE 'ledger ' || o_orderpriority || '.csv' END AS source,
        CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
        CASE o_orderstatus WHEN 'F' THEN 'invoice' WHEN 'O' THEN 'pipeline' ELSE 'note' END AS record_type,
        CAST(year(o_orderdate) AS VARCHAR) AS stage_year, o_orderpriority <> '5-LOW' AS typed,
        o_orderkey AS row, o_custkey AS customer_key FROM orders)
"""
BANK = "regexp_matches(lower(source), 'bank|statement')"


@query(
    "statement_totals",
    f"WITH {PAYMENTS} SELECT source, CAST(sum(amount) AS DOUBLE) AS statement_total FROM p WHERE {BANK} GROUP BY source",
)
def statement_totals(t):
    return doubles(A.statement_totals(payments(t)), "statement_total")


@query(
    "invoice_totals",
    f"""WITH {PAYMENTS} SELECT source, CASE WHEN bool_or(typed) THEN 'invoice' ELSE 'amount' END AS basis,
      CAST(CASE WHEN bool_or(typed) THEN sum(amount) FILTER (record_type = 'invoice') ELSE sum(amount) END AS DOUBLE) AS total
      FROM p WHERE NOT {BANK} GROUP BY source""",
)
def invoice_totals(t):
    return doubles(A.invoice_totals(payments(t)), "total")


@query(
    "stage_totals",
    f"""WITH {PAYMENTS} SELECT source, stage_year AS stage, CAST(sum(amount) AS DOUBLE) AS stage_total
      FROM p WHERE record_type = 'pipeline' AND stage_year <> '1995' GROUP BY ALL""",
)
def stage_totals(t):
    rows = payments(t).withColumn(
        "stage", F.when(F.col("stage_year") != "1995", F.col("stage_year"))
    )
    return doubles(A.stage_totals(rows), "stage_total")


def invoices(t):
    """Line items as invoices; supplier and quantity repeat very often, and
    quantity 50 is a missing amount."""
    return t.lineitem.select(
        F.concat(F.lit("invoices "), "l_returnflag", F.lit(".csv")).alias("source"),
        F.concat(F.lit("Supplier "), (F.col("l_suppkey") % 40).cast("string")).alias("customer"),
        F.when(F.col("l_quantity") < 50, F.col("l_quantity").cast("decimal(18,2)")).alias("amount"),
        F.concat_ws("-", F.lit("INV"), "l_orderkey", "l_linenumber", "l_partkey").alias("id"),
        F.col("l_orderkey").alias("row"),
    )


INVOICES = """
    i AS (SELECT 'invoices ' || l_returnflag || '.csv' AS source, 'Supplier ' || (l_suppkey % 40) AS customer,
        CASE WHEN l_quantity < 50 THEN CAST(l_quantity AS DECIMAL(18,2)) END AS amount,
        'INV-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, l_orderkey AS row FROM lineitem),
    g AS (SELECT *, count(*) OVER (PARTITION BY source, customer, amount) AS n_rows,
        row_number() OVER (PARTITION BY source, customer, amount ORDER BY row, id) AS place FROM i)
"""


@query(
    "duplicate_invoices",
    f"""WITH {INVOICES} SELECT source, customer, CAST(amount AS DOUBLE) AS amount, id, n_rows FROM g WHERE n_rows > 1""",
)
def duplicate_invoices(t):
    return doubles(A.duplicate_rows(invoices(t), spread_by=["id"]).drop("row"), "amount")


@query(
    "duplicate_invoice_lines",
    f"""WITH {INVOICES} SELECT source, customer, CAST(amount AS DOUBLE) AS amount, n_rows, (place - 1) // 20 + 1 AS line_no,
      'Potential duplicate invoice in ' || source || ': ' || string_agg(id, ', ' ORDER BY place)
        || ' have the same customer (' || customer || ') and amount (' || {Q.sar('amount')}
        || '); verify before counting both as separate revenue.' AS line
      FROM g WHERE n_rows > 1 GROUP BY source, customer, amount, n_rows, line_no""",
)
def duplicate_invoice_lines(t):
    return doubles(A.duplicate_invoice_lines(invoices(t), ids_per_line=20), "amount").withColumn(
        "line_no", F.col("line_no").cast("long")
    )


@query(
    "reconcile",
    """
    WITH l AS (SELECT o_orderkey // 3 AS reference, CAST(floor(o_totalprice / 20000) AS BIGINT) AS amount FROM orders),
    k AS (SELECT o_orderkey // 3 AS reference,
        CAST(floor((o_totalprice + CASE WHEN o_orderkey % 5 = 0 THEN 25000 ELSE 0 END) / 20000) AS BIGINT) AS amount
      FROM orders WHERE o_orderstatus <> 'P'),
    lc AS (SELECT reference, amount, count(*) AS n FROM l GROUP BY ALL),
    kc AS (SELECT reference, amount, count(*) AS n FROM k GROUP BY ALL),
    f AS (SELECT coalesce(lc.reference, kc.reference) AS reference, coalesce(lc.amount, kc.amount) AS amount,
        coalesce(lc.n, 0) AS nl, coalesce(kc.n, 0) AS nb FROM lc FULL JOIN kc
        ON lc.reference = kc.reference AND lc.amount = kc.amount),
    w AS (SELECT *, sum(nl - least(nl, nb)) OVER (PARTITION BY reference) AS xl,
        sum(nb - least(nl, nb)) OVER (PARTITION BY reference) AS xb FROM f),
    o AS (SELECT reference, amount, nl, nb, 'matched' AS status, least(nl, nb) AS n FROM w
      UNION ALL SELECT reference, amount, nl, nb, CASE WHEN xb > 0 THEN 'amount_mismatch' ELSE 'missing_in_bank' END,
        nl - least(nl, nb) FROM w
      UNION ALL SELECT reference, amount, nl, nb, CASE WHEN xl > 0 THEN 'amount_mismatch' ELSE 'missing_in_ledger' END,
        nb - least(nl, nb) FROM w)
    SELECT reference, CAST(amount AS BIGINT) AS amount, nl AS ledger_rows, nb AS bank_rows, status, n AS n_rows FROM o WHERE n > 0
    """,
)
def reconcile(t):
    price = F.col("o_totalprice")
    step = lambda c: F.floor(c / 20000).cast("long")
    reference = F.floor(F.col("o_orderkey") / 3).cast("long").alias("reference")
    ledger = t.orders.select(reference, step(price).alias("amount"))
    late = F.when(F.col("o_orderkey") % 5 == 0, 25000).otherwise(0)
    bank = t.orders.filter(F.col("o_orderstatus") != "P").select(reference, step(price + late).alias("amount"))
    return A.reconcile(ledger, bank)


def order_rows(t):
    docs = D.row_documents(order_table(t), "source", ["entry_id"])
    return A.parse_row_sentences(D.union_documents(docs))


@query(
    "parse_row_sentences",
    """
    SELECT 'orders ' || o_orderpriority || '.csv' AS source,
      row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS row,
      CAST(o_orderkey AS VARCHAR) AS entry_id, CAST(o_custkey AS VARCHAR) AS customer,
      CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status,
      CAST(o_totalprice AS DOUBLE) AS amount FROM orders
    """,
)
def parse_row_sentences(t):
    f = lambda name: F.try_element_at("fields", F.lit(name))
    return order_rows(t).select(
        "source", "row", f("entry_id").alias("entry_id"), f("customer").alias("customer"),
        f("status").alias("status"), f("amount_sar").cast("double").alias("amount"),
    )


@query(
    "parse_csv_blocks",
    """
    WITH r AS (SELECT 'region ' || r_name || '.xlsx' AS source, n_nationkey AS id, n_name AS name
      FROM nation JOIN region ON n_regionkey = r_regionkey
      UNION ALL SELECT 'segment ' || c_mktsegment || '.xlsx', c_custkey, c_name || ', "' || c_nationkey || '"' FROM customer),
    ok AS (SELECT source FROM r GROUP BY source HAVING count(*) <= 200)
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY id) AS row, CAST(id AS VARCHAR) AS id, name
    FROM r WHERE source IN (SELECT source FROM ok)
    """,
)
def parse_csv_blocks(t):
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("region "), "r_name", F.lit(".xlsx")).alias("source"),
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"),
    )
    customers = t.customer.select(
        F.concat(F.lit("segment "), "c_mktsegment", F.lit(".xlsx")).alias("source"),
        F.col("c_custkey").alias("id"),
        F.concat("c_name", F.lit(', "'), F.col("c_nationkey").cast("string"), F.lit('"')).alias("name"),
    )
    docs = D.full_table_documents(nations.unionByName(customers), "source", ["id"], ["id", "name"])
    rows = A.parse_csv_blocks(
        D.union_documents(docs).withColumn("doc_id", F.xxhash64("source")), "doc_id"
    )
    return rows.select(
        "source", "row", F.col("fields")["id"].alias("id"), F.col("fields")["name"].alias("name")
    )


QUESTIONS = (
    "What is the budget variance and net profit?", "Analyze revenue collection and billing leaks",
    "Show me the first entry", "Total of all invoices", "bank statement sum",
)


def fact_rows(t):
    """Budget lines and payments retrieved for each of the questions asked by
    a market segment's customers."""
    budget = budget_rows(t).select(
        "source", "type", "budget", "actual", (F.col("line") % 5).alias("query_id"),
        F.lit(True).alias("has_budget"), F.lit(False).alias("has_amount"),
    )
    paid = payments(t).select(
        "source", "amount", "record_type", F.col("stage_year").alias("stage"), "has_record_type",
        F.when(F.col("has_record_type"), F.concat(F.lit("C"), (F.col("customer_key") % 300).cast("string"))).alias("customer"),
        F.concat(F.lit("O"), F.col("row").cast("string")).alias("id"), "row",
        (F.floor(F.col("amount") / 100000) % 5).cast("long").alias("query_id"),
        F.col("has_record_type").alias("has_customer"),
        F.lit(False).alias("has_budget"), F.lit(True).alias("has_amount"),
    ).withColumn("amount", F.round("amount", -5).cast("decimal(18,2)"))
    return budget.unionByName(paid, allowMissingColumns=True)


def asked(t):
    names = F.array(*[F.lit(q) for q in QUESTIONS])
    return t.region.select(
        F.col("r_regionkey").cast("long").alias("query_id"),
        F.get(names, F.col("r_regionkey")).alias("text"),
        (F.col("r_regionkey") == 2).alias("needs_aggregation"),
    )


def _any(words):
    return Q.any_of("lower(text)", [w for w in words if w.isascii()])


LINES = f"""
    {BUDGET}, {PAYMENTS},
    q AS (SELECT r_regionkey AS query_id, list_extract({Q.sql_list(QUESTIONS)}, r_regionkey + 1) AS text,
        r_regionkey = 2 AS need FROM region),
    gate AS (SELECT query_id, need OR {_any(C.AGGREGATION_KEYWORDS)} AS calc, {_any(C.INVOICE_TOTAL_KEYWORDS)} AS inv,
        {_any(C.REVENUE_QUERY_KEYWORDS)} AS anom FROM q),
    bs AS (SELECT line % 5 AS query_id, source, sum(budget) FILTER (type = 'expense') AS be, sum(actual) FILTER (type = 'expense') AS ae,
        sum(budget) FILTER (type = 'revenue') AS br, sum(actual) FILTER (type = 'revenue') AS ar FROM b GROUP BY ALL),
    pm AS (SELECT CAST(floor(amount / 100000) AS BIGINT) % 5 AS query_id, source, CAST(round(amount, -5) AS DECIMAL(18,2)) AS amount, record_type, stage_year,
        typed, row, CASE WHEN typed THEN 'C' || (customer_key % 300) END AS customer, 'O' || row AS id FROM p),
    ps AS (SELECT query_id, source, sum(amount) AS total, sum(amount) FILTER (record_type = 'invoice') AS invoices,
        bool_or(typed) AS typed FROM pm GROUP BY ALL),
    st AS (SELECT query_id, source, stage_year AS stage, sum(amount) AS total FROM pm WHERE record_type = 'pipeline' GROUP BY ALL),
    du AS (SELECT query_id, source, customer, amount, string_agg(id, ', ' ORDER BY row) AS ids FROM pm
      WHERE typed AND record_type = 'invoice' GROUP BY ALL HAVING count(*) > 1),
    ln AS (
      SELECT query_id, 1 AS section, source, 1 AS seq, 'Total budgeted expenses (' || source || '): ' || {Q.sar('be')} AS line FROM bs JOIN gate USING (query_id) WHERE calc
      UNION ALL SELECT query_id, 1, source, 2, 'Total actual expenses (' || source || '): ' || {Q.sar('ae')} FROM bs JOIN gate USING (query_id) WHERE calc
      UNION ALL SELECT query_id, 1, source, 3, 'Total budgeted revenue (' || source || '): ' || {Q.sar('br')} FROM bs JOIN gate USING (query_id) WHERE calc
      UNION ALL SELECT query_id, 1, source, 4, 'Total actual revenue (' || source || '): ' || {Q.sar('ar')} FROM bs JOIN gate USING (query_id) WHERE calc
      UNION ALL SELECT query_id, 1, source, 5, 'Budgeted net profit (' || source || '): ' || {Q.sar('(br - be)', True)} FROM bs JOIN gate USING (query_id) WHERE calc
      UNION ALL SELECT query_id, 1, source, 6, 'Actual net profit (' || source || '): ' || {Q.sar('(ar - ae)', True)} FROM bs JOIN gate USING (query_id) WHERE calc
      UNION ALL SELECT query_id, 1, source, 7, 'Bank statement total (' || source || '): ' || {Q.sar('total')} FROM ps JOIN gate USING (query_id) WHERE calc AND {BANK}
      UNION ALL SELECT query_id, 1, source, 8, 'Invoice amount total before duplicate review (' || source || '): ' || {Q.sar('invoices')} FROM ps JOIN gate USING (query_id) WHERE calc AND inv AND typed AND NOT {BANK}
      UNION ALL SELECT query_id, 1, source, 10, 'Amount total (' || source || '): ' || {Q.sar('total')} FROM ps JOIN gate USING (query_id) WHERE calc AND inv AND NOT typed AND NOT {BANK}
      UNION ALL SELECT query_id, 1, source, 9, 'Pipeline stage total - ' || stage || ' (' || source || '): ' || {Q.sar('total')} FROM st JOIN gate USING (query_id) WHERE calc AND inv AND NOT {BANK}
      UNION ALL SELECT query_id, 2, source, 11, 'Potential duplicate invoice in ' || source || ': ' || ids || ' have the same customer ('
        || customer || ') and amount (' || {Q.sar('amount')} || '); verify before counting both as separate revenue.' FROM du JOIN gate USING (query_id) WHERE anom)
"""


@query(
    "verified_lines",
    f"WITH {LINES} SELECT CAST(query_id AS BIGINT) AS query_id, source, CAST(section AS BIGINT) AS section, CAST(seq AS BIGINT) AS seq, line FROM ln WHERE line IS NOT NULL",
)
def verified_lines(t):
    return A.verified_lines(asked(t), fact_rows(t)).withColumns(
        {"section": F.col("section").cast("long"), "seq": F.col("seq").cast("long")}
    )


@query(
    "verified_block",
    f"""WITH {LINES}, sec AS (SELECT query_id, section, CASE section WHEN 1 THEN {Q.quote(C.CALCULATIONS_TITLE)}
        ELSE {Q.quote(C.ANOMALIES_TITLE)} END || chr(10) || string_agg('- ' || line, chr(10) ORDER BY source, seq, line) AS part
      FROM ln WHERE line IS NOT NULL GROUP BY query_id, section)
    SELECT CAST(query_id AS BIGINT) AS query_id, string_agg(part, chr(10) || chr(10) ORDER BY section) AS block FROM sec GROUP BY query_id""",
)
def verified_block(t):
    return A.verified_block(asked(t), fact_rows(t))
