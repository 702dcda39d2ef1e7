from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgermill.operators import documents as D
from ledgermill.operators import finance as A

BUDGET = [
    ("SaaS Revenue", "revenue", 1200000, 980000), ("Services Revenue", "revenue", 400000, 455000),
    ("Cloud Infrastructure", "expense", 150000, 210000), ("Marketing", "expense", 300000, 180000),
    ("Salaries", "expense", 900000, 905000), ("Travel", "expense", 50000, 71000),
    ("Office Rent", "expense", 90000, 90000), ("Software Licenses", "expense", 60000, 58000),
]


@pytest.fixture(scope="module")
def block(spark):
    def build(question, contents, source, needs=True):
        docs = D.union_documents(spark.createDataFrame([(i, f"CSV: {source}\n{c}", source) for i, c in enumerate(contents)], "row long, content string, source string"))
        rows = A.ledger_columns(A.parse_row_sentences(docs)).withColumn("query_id", F.lit(1).cast("long"))
        queries = spark.createDataFrame([(1, question, needs)], "query_id long, text string, needs_aggregation boolean")
        found = A.verified_block(queries, rows).collect()
        return found[0]["block"] if found else ""

    return build


def test_budget_and_net_profit(block):
    lines = [f"line_item: {n} | type: {t} | budget_sar: {b} | actual_sar: {a}" for n, t, b, a in BUDGET]
    text = block("What is the FP&A budget actual variance and net profit?", lines, "budget.xlsx")
    for part in ("Total budgeted expenses (budget.xlsx): 1,550,000 SAR", "Total actual expenses (budget.xlsx): 1,514,000 SAR",
                 "Budgeted net profit (budget.xlsx): +50,000 SAR", "Actual net profit (budget.xlsx): -79,000 SAR"):
        assert part in text
    assert block("list the first line", lines, "budget.xlsx", needs=False) == ""


def test_duplicate_invoices_are_named(block):
    lines = [f"record_type: invoice | id: INV-{i} | customer: Acme Retail | amount_sar: 12000 | status: paid" for i in (501, 504)]
    text = block("Analyze revenue collection and billing leaks", lines, "revops.csv")
    assert "VERIFIED_ANOMALIES" in text
    assert "Potential duplicate invoice in revops.csv: INV-501, INV-504 have the same customer (Acme Retail) and amount (12,000 SAR)" in text
    assert "Invoice amount total before duplicate review (revops.csv): 24,000 SAR" in text


def test_bank_total(block):
    lines = [f"payment_id: B-{i} | amount_sar: {a}" for i, a in enumerate([5000, 7300, 8000, 6000, 4000, 7000])]
    assert "Bank statement total (bank_statement.csv): 37,300 SAR" in block("What is the bank statement total?", lines, "bank_statement.csv")


def test_hot_duplicate_group_lists_every_id(spark):
    rows = spark.range(300).select(
        F.lit("a.csv").alias("source"), F.lit(None).cast("string").alias("customer"), F.lit(5).cast("decimal(18,2)").alias("amount"),
        F.format_string("I%03d", "id").alias("id"), F.col("id").alias("row"),
    )
    lines = A.duplicate_invoice_lines(rows, ids_per_line=7).orderBy("line_no").collect()
    listed = [i for r in lines for i in r["line"].split(": ")[1].split(" have")[0].split(", ")]
    assert listed == [f"I{i:03d}" for i in range(300)] and len(lines) == 43


def test_reconcile_pairs_copies_one_to_one(spark):
    book = lambda rows: spark.createDataFrame([(r, Decimal(a)) for r, a in rows], "reference string, amount decimal(18,2)")
    ledger = book([("A", 5), ("A", 5), ("A", 5), ("B", 7), ("C", 1), (None, 3)])
    bank = book([("A", 5), ("B", 8), ("D", 2), (None, 3)])
    got = {(r["reference"], int(r["amount"]), r["status"]): r["n_rows"] for r in A.reconcile(ledger, bank).collect()}
    assert got == {
        ("A", 5, "matched"): 1, ("A", 5, "missing_in_bank"): 2, ("B", 7, "amount_mismatch"): 1, ("B", 8, "amount_mismatch"): 1,
        ("C", 1, "missing_in_bank"): 1, ("D", 2, "missing_in_ledger"): 1, (None, 3, "matched"): 1,
    }


def test_money_text(one):
    assert one(lambda c: A.format_sar(c), "1234.5") == "1,234.50 SAR"
    assert one(lambda c: A.format_sar(c, True), "50000") == "+50,000 SAR"


def test_totals_are_exact_or_reported(spark):
    rows = [("a", "12345678901234567.5"), ("a", "1.005"), ("a", "-0.000000000001"), ("a", None), ("b", "9" * 25), ("b", "9" * 25),
            ("c", "1" * 27), ("c", "2"), ("d", "0.0000000000001"), ("e", "n/a")]
    frame = spark.createDataFrame([(s, {"amount_sar": v}) for s, v in rows], "source string, fields map<string,string>")
    ledger = A.ledger_columns(frame)
    got = {r["source"]: (r["total"], r["overflow"]) for r in A.invoice_totals(ledger.withColumn("has_record_type", F.lit(False))).collect()}
    assert got["a"] == (Decimal("12345678901234568.504999999999"), False)
    assert got["b"] == (None, True) and got["c"] == (Decimal(2), True) and got["d"] == (Decimal(0), True)
    assert got["e"] == (Decimal(0), False)


def test_amounts_too_wide_are_not_equal_invoices(spark):
    rows = [(k, {"amount_sar": v, "customer": "x", "id": str(k)}) for k, v in enumerate(["1" * 30, "2" * 30, "1" * 30, "5"])]
    ledger = A.ledger_columns(spark.createDataFrame(rows, "row long, fields map<string,string>").withColumn("source", F.lit("s")))
    found = A.duplicate_invoice_lines(ledger, ["source", "customer", "amount", "amount_raw"]).collect()
    assert [r["line"].split(": ")[1].split(" have")[0] for r in found] == ["0, 2"] and "1" * 30 in found[0]["line"]
