"""Figures computed from ledger, budget and invoice rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.amounts import exact_sum, is_unreadable, money, subtract, sum_overflows
from ..functions.text import contains_any, is_blank, last_wins, let, normalize_arabic, strip
from .documents import source_name
from .ordering import null_safe_join, number_rows, spread_join

# --------------------------------------------------------------------------
# rows back from documents
# --------------------------------------------------------------------------

def clean_value(c: Column) -> Column:
    """Trimmed text; empty, nan, none and null become NULL; amounts such as
    ``12,000 SAR`` become plain numbers."""

    def body(t: Column) -> Column:
        number = strip(F.regexp_replace(t, r",|SAR|sar", ""))
        return (
            F.when((t == "") | F.lower(t).isin("nan", "none", "null"), None)
            .when(
                number.rlike(r"^-?\d+(?:\.\d+)?$"),
                F.regexp_replace(number, r"\.0+$", ""),
            )
            .otherwise(t)
        )

    return let(strip(c), body)


def row_fields(text: Column) -> Column:
    """``a: 1 | b: 2`` in a text's last line -> MAP<STRING, STRING>, else NULL."""
    line = F.element_at(F.split(F.regexp_replace(text, r"\n$", ""), r"\r\n|\n|\r", -1), -1)

    def pairs(row: Column) -> Column:
        parts = F.filter(F.split(row, r" \| ", -1), lambda p: p.contains(":"))
        keyed = F.transform(
            parts,
            lambda p: F.struct(
                strip(F.substring_index(p, ":", 1)).alias("key"),
                clean_value(F.substring(p, F.instr(p, ":") + 1, F.length(p))).alias("value"),
            ),
        )
        return F.filter(keyed, lambda p: p.key != "")

    return let(
        line,
        lambda row: F.when(
            row.contains(" | ") & row.contains(":"),
            let(pairs(row), lambda ps: F.when(F.size(ps) > 0, last_wins(ps))),
        ),
    )


def parse_row_sentences(docs: DataFrame) -> DataFrame:
    """Adds ``source`` and ``fields`` for documents that hold a row sentence."""
    return (
        docs.withColumn("fields", row_fields(F.col("content")))
        .filter(F.col("fields").isNotNull())
        .withColumn("source", source_name())
    )


def parse_csv_blocks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of the CSV blocks inside full-table documents, one map per row."""
    blocks = docs.select(
        key,
        source_name().alias("source"),
        F.posexplode(
            F.regexp_extract_all(
                "content", F.lit(r"CSV:\n([\s\S]*?)(?=\n\nSource file:|\z)"), F.lit(1)
            )
        ).alias("block", "csv"),
    )

    def cells(line: Column) -> Column:
        raw = F.regexp_extract_all(
            F.concat(line, F.lit(",")), F.lit(r'("(?:[^"]|"")*"|[^,]*),'), F.lit(1)
        )
        return F.transform(
            raw,
            lambda c: F.when(
                c.startswith('"'),
                F.replace(F.regexp_replace(c, r'^"|"$', ""), F.lit('""'), F.lit('"')),
            ).otherwise(c),
        )

    # a line ends at a break outside quotes; a quote that is never closed is a plain character
    lines = F.transform(
        F.regexp_extract_all(strip(F.col("csv")), F.lit(r'((?:"[^"]*+"|[^"\n]++|")*+)(?:\n|\z)'), F.lit(1)),
        lambda x: F.regexp_replace(x, r"\r$", ""),
    )
    rows = blocks.select(
        key, "source", "block", cells(lines[0]).alias("_names"),
        F.posexplode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("pos", "line"),
    ).filter(~is_blank(F.col("line")))
    pairs = F.transform(
        F.arrays_zip(F.col("_names").alias("key"), cells(F.col("line")).alias("value")),
        lambda p: F.struct(strip(p.key).alias("key"), clean_value(p.value).alias("value")),
    )
    return rows.select(
        key, "source", "block", (F.col("pos") + 1).cast("long").alias("row"),
        last_wins(F.filter(pairs, lambda p: p.key.isNotNull())).alias("fields"),
    )


def ledger_columns(rows: DataFrame) -> DataFrame:
    """Typed columns used by the calculations, from a ``fields`` map.

    ``unreadable`` marks rows with a number of more digits than an amount has,
    ``amount_raw`` keeps its text if it is the amount.
    """
    field = lambda name: F.try_element_at("fields", F.lit(name))
    return rows.withColumns(
        {
            "type": field("type"),
            "budget": money(field("budget_sar")),
            "actual": money(field("actual_sar")),
            "amount": money(field("amount_sar")),
            "amount_raw": F.when(is_unreadable(field("amount_sar")), field("amount_sar")),
            "unreadable": reduce(
                lambda a, b: a | b, [is_unreadable(field(n)) for n in ("budget_sar", "actual_sar", "amount_sar")]
            ),
            "record_type": field("record_type"),
            "stage": field("stage"),
            "customer": field("customer"),
            "id": field("id"),
            "has_budget": F.map_contains_key("fields", "budget_sar")
            & F.map_contains_key("fields", "actual_sar")
            & F.map_contains_key("fields", "type"),
            "has_amount": F.map_contains_key("fields", "amount_sar"),
            "has_record_type": F.map_contains_key("fields", "record_type"),
            "has_customer": F.map_contains_key("fields", "customer"),
        }
    )


# --------------------------------------------------------------------------
# totals
# --------------------------------------------------------------------------

def _total(rows: DataFrame, name: str, when: Column) -> Column:
    """Sum over matching rows: NULL without such rows, 0 when all are null."""
    return F.when(F.count_if(when) > 0, exact_sum(rows, name, when))


def _overflow(rows: DataFrame, **sums: Column | None) -> Column:
    """Whether a total misses something: an amount or a sum has too many digits."""
    missing = [sum_overflows(rows, name, when) for name, when in sums.items()]
    if "unreadable" in rows.columns:
        missing.append(F.coalesce(F.max("unreadable"), F.lit(False)))
    return reduce(lambda a, b: a | b, missing)


def budget_actual_summary(rows: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Budgeted and actual expenses, revenue and net profit per source, in one
    pass over ``rows(source, type, budget, actual)``; ``overflow`` says whether
    one of them misses something."""
    group = group or ["source"]
    expense = F.lower("type") == "expense"
    revenue = F.lower("type") == "revenue"
    sums = rows.groupBy(*group).agg(
        _total(rows, "budget", expense).alias("budget_expenses"),
        _total(rows, "actual", expense).alias("actual_expenses"),
        _total(rows, "budget", revenue).alias("budget_revenue"),
        _total(rows, "actual", revenue).alias("actual_revenue"),
        (_overflow(rows, budget=expense, actual=expense) | _overflow(rows, budget=revenue, actual=revenue)).alias("overflow"),
    )
    return net_profit(sums)


def net_profit(sums: DataFrame) -> DataFrame:
    """Revenue less expenses; NULL unless the source has both."""
    return sums.withColumn(
        "budget_net", subtract(F.col("budget_revenue"), F.col("budget_expenses"))
    ).withColumn("actual_net", subtract(F.col("actual_revenue"), F.col("actual_expenses")))


def variance(rows: DataFrame, group: list[str]) -> DataFrame:
    """Actual less budget per group, and its share of the budget in percent."""
    sums = rows.groupBy(*group).agg(
        exact_sum(rows, "budget").alias("budget"),
        exact_sum(rows, "actual").alias("actual"),
        _overflow(rows, budget=None, actual=None).alias("overflow"),
    )
    return sums.withColumn("variance", subtract(F.col("actual"), F.col("budget"))).withColumn(
        "variance_pct",
        F.round(
            F.try_divide(F.lit(100) * F.col("variance"), F.col("budget")).cast("decimal(38,6)"), 2
        ).cast("decimal(18,2)"),
    )


def is_bank_source(source: Column) -> Column:
    return contains_any(F.lower(source), C.BANK_SOURCE_WORDS)


def statement_totals(rows: DataFrame) -> DataFrame:
    return (
        rows.filter(is_bank_source(F.col("source")))
        .groupBy("source")
        .agg(exact_sum(rows, "amount").alias("statement_total"), _overflow(rows, amount=None).alias("overflow"))
    )


def invoice_totals(rows: DataFrame) -> DataFrame:
    """Per non-bank source: the sum of its invoices, or the plain total when
    its rows carry no record type."""
    is_invoice = F.lower("record_type") == "invoice"
    typed = F.max(F.col("has_record_type"))
    return (
        rows.filter(~is_bank_source(F.col("source")))
        .groupBy("source")
        .agg(
            F.when(typed, F.lit("invoice")).otherwise(F.lit("amount")).alias("basis"),
            F.when(typed, _total(rows, "amount", is_invoice)).otherwise(exact_sum(rows, "amount")).alias("total"),
            F.when(typed, F.count_if(is_invoice)).otherwise(F.lit(1)).alias("_n"),
            F.when(typed, _overflow(rows, amount=is_invoice)).otherwise(_overflow(rows, amount=None)).alias("overflow"),
        )
        .filter("_n > 0").drop("_n")
    )


def stage_totals(rows: DataFrame, group: list[str] | None = None) -> DataFrame:
    group = group or ["source"]
    return (
        rows.filter((F.lower("record_type") == "pipeline") & F.col("stage").isNotNull())
        .groupBy(*group, "stage")
        .agg(exact_sum(rows, "amount").alias("stage_total"), _overflow(rows, amount=None).alias("overflow"))
    )


# --------------------------------------------------------------------------
# duplicates and reconciliation
# --------------------------------------------------------------------------

def duplicate_groups(rows: DataFrame, group: list[str]) -> DataFrame:
    return (
        rows.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .filter("n_rows > 1")
    )


def duplicate_rows(
    rows: DataFrame, group: list[str] | None = None, spread_by: list[str] | None = None
) -> DataFrame:
    """Rows that share (source, customer, amount) with another row; nulls are
    equal to each other. The counts are joined back; a much-copied invoice is
    dealt over as many tasks as its count asks for."""
    group = group or ["source", "customer", "amount"]
    return spread_join(rows, duplicate_groups(rows, group), group, spread_by or ["row"], size="n_rows")


def duplicate_invoice_lines(
    rows: DataFrame,
    group: list[str] | None = None,
    order_by: str = "row",
    ids_per_line: int = 1000,
) -> DataFrame:
    """One warning per group of equal invoices, listing its ids in row order.

    A group with more than ``ids_per_line`` ids gives several numbered lines;
    together they list every id.
    """
    group = group or ["source", "customer", "amount"]
    suspects = duplicate_rows(rows, group, [order_by, "id"])
    numbered = number_rows(suspects, group, [order_by, "id"], row="_at")
    lines = (
        numbered.withColumn("line_no", F.floor((F.col("_at") - 1) / ids_per_line) + 1)
        .groupBy(*group, "n_rows", "line_no")
        .agg(
            F.array_sort(
                F.collect_list(F.when(F.col("id").isNotNull(), F.struct("_at", "id")))
            ).alias("_ids")
        )
    )
    ids = F.array_join(F.transform("_ids", lambda s: s["id"].cast("string")), ", ")
    raw = F.concat("amount_raw", F.lit(" SAR")) if "amount_raw" in group else F.lit(None).cast("string")
    text = F.concat(
        F.lit("Potential duplicate invoice in "), F.col("source"), F.lit(": "), ids,
        F.lit(" have the same customer ("), F.coalesce("customer", F.lit("nan")),
        F.lit(") and amount ("), F.coalesce(format_sar(F.col("amount")), raw),
        F.lit("); verify before counting both as separate revenue."),
    )
    return lines.select(*group, "n_rows", "line_no", text.alias("line"))


def reconcile(ledger: DataFrame, bank: DataFrame) -> DataFrame:
    """Match two books on (reference, amount), copies pairing one to one.

    Both sides are counted per key first, so a key with very many copies is
    two numbers, not a cross product. What is left over on one side is an
    amount mismatch when the other side has leftovers of the same reference,
    and missing there otherwise.
    """
    keys = ["reference", "amount"]
    sides = ledger.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("b")).unionByName(
        bank.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("b"))
    )
    counted = sides.groupBy(*keys).agg(
        F.sum("l").alias("ledger_rows"), F.sum("b").alias("bank_rows")
    )
    counted = counted.withColumn("_both", F.least("ledger_rows", "bank_rows"))
    left = (
        counted.groupBy("reference")
        .agg(
            F.sum(F.col("ledger_rows") - F.col("_both")).alias("_l"),
            F.sum(F.col("bank_rows") - F.col("_both")).alias("_b"),
        )
    )
    joined = null_safe_join(counted, left, ["reference"])
    extra_l = F.col("ledger_rows") - F.col("_both")
    extra_b = F.col("bank_rows") - F.col("_both")
    def outcome(status: Column, n: Column) -> Column:
        return F.struct(status.alias("status"), n.alias("n_rows"))

    def leftover(other: str, missing: str) -> Column:
        return F.when(F.col(other) > 0, F.lit("amount_mismatch")).otherwise(F.lit(missing))

    outcomes = F.array(
        outcome(F.lit("matched"), F.col("_both")),
        outcome(leftover("_b", "missing_in_bank"), extra_l),
        outcome(leftover("_l", "missing_in_ledger"), extra_b),
    )
    return (
        joined.select(*keys, "ledger_rows", "bank_rows", F.inline(outcomes))
        .filter("n_rows > 0")
    )


# --------------------------------------------------------------------------
# verified lines
# --------------------------------------------------------------------------

def format_sar(c: Column, signed: bool = False) -> Column:
    """``1,234 SAR`` or ``1,234.50 SAR``, with a plus sign when asked."""

    def body(v: Column) -> Column:
        text = F.when(v == F.floor(v), F.format_number(v, 0)).otherwise(F.format_number(v, 2))
        plus = F.when(v > 0, F.lit("+")).otherwise(F.lit("")) if signed else F.lit("")
        return F.concat(plus, text, F.lit(" SAR"))

    return let(c.cast("decimal(28,2)"), body)


def wants_calculation(text: Column, needs_aggregation: Column | None = None) -> Column:
    by_word = contains_any(normalize_arabic(F.lower(text)), C.AGGREGATION_KEYWORDS)
    if needs_aggregation is None:
        return by_word
    return F.coalesce(needs_aggregation, F.lit(False)) | by_word


def wants_invoice_totals(text: Column) -> Column:
    return contains_any(normalize_arabic(F.lower(text)), C.INVOICE_TOTAL_KEYWORDS)


def wants_anomalies(text: Column) -> Column:
    return contains_any(normalize_arabic(F.lower(text)), C.REVENUE_QUERY_KEYWORDS)


def verified_lines(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Computed facts per question: ``(query_id, section, source, seq, line)``.

    ``queries(query_id, text[, needs_aggregation])``; ``rows`` are the typed
    rows (see :func:`ledger_columns`) retrieved for each question, with
    ``query_id`` and a row number ``row``. Sums are grouped by question and
    source before any question text is joined.
    """
    group = ["query_id", "source"]
    need = F.col("needs_aggregation") if "needs_aggregation" in queries.columns else None
    gates = queries.select(
        "query_id",
        wants_calculation(F.col("text"), need).alias("_calc"),
        wants_invoice_totals(F.col("text")).alias("_inv"),
        wants_anomalies(F.col("text")).alias("_anom"),
    )

    def named(title: str, value: str, signed: bool = False) -> Column:
        return F.concat(
            F.lit(title + " ("), F.col("source"), F.lit("): "), format_sar(F.col(value), signed)
        )

    def spread(table: DataFrame, gate: Column, section: int, entries) -> DataFrame:
        lines = F.array(
            *[F.struct(F.lit(seq).alias("seq"), line.alias("line")) for seq, line in entries]
        )
        return (
            table.join(gates, "query_id")
            .filter(gate)
            .select("query_id", F.lit(section).alias("section"), "source", F.inline(lines))
            .filter(F.col("line").isNotNull())
        )

    budget = budget_actual_summary(rows.filter("has_budget"), group)
    bank = is_bank_source(F.col("source"))
    invoice = F.lower("record_type") == "invoice"
    amounts = rows.filter("has_amount").groupBy(*group).agg(
        exact_sum(rows, "amount").alias("_all"),
        _total(rows, "amount", invoice).alias("_invoices"),
        F.max("has_record_type").alias("_typed"),
    )
    stages = stage_totals(rows.filter("has_amount"), group)
    invoices = rows.filter(
        F.col("has_customer") & F.col("has_amount")
        & (~F.col("has_record_type") | F.coalesce(invoice, F.lit(False)))
    )
    same = ["query_id", "source", "customer", "amount", *(["amount_raw"] if "amount_raw" in rows.columns else [])]
    duplicates = duplicate_invoice_lines(invoices, same)
    parts = [
        spread(budget, F.col("_calc"), 1, [
            (1, named("Total budgeted expenses", "budget_expenses")),
            (2, named("Total actual expenses", "actual_expenses")),
            (3, named("Total budgeted revenue", "budget_revenue")),
            (4, named("Total actual revenue", "actual_revenue")),
            (5, named("Budgeted net profit", "budget_net", True)),
            (6, named("Actual net profit", "actual_net", True)),
        ]),
        spread(amounts, F.col("_calc"), 1, [
            (7, F.when(bank, named("Bank statement total", "_all"))),
            (8, F.when(~bank & F.col("_inv") & F.col("_typed"),
                       named("Invoice amount total before duplicate review", "_invoices"))),
            (10, F.when(~bank & F.col("_inv") & ~F.col("_typed"), named("Amount total", "_all"))),
        ]),
        spread(stages, F.col("_calc") & F.col("_inv") & ~bank, 1, [
            (9, F.concat(F.lit("Pipeline stage total - "), F.col("stage"), F.lit(" ("),
                         F.col("source"), F.lit("): "), format_sar(F.col("stage_total")))),
        ]),
        spread(duplicates, F.col("_anom"), 2, [(11, F.col("line"))]),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def verified_block(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """The text block per question that is put before its context."""
    lines = verified_lines(queries, rows)
    sections = lines.groupBy("query_id", "section").agg(
        F.array_sort(F.collect_list(F.struct("source", "seq", "line"))).alias("_l")
    )
    title = F.when(F.col("section") == 1, F.lit(C.CALCULATIONS_TITLE)).otherwise(
        F.lit(C.ANOMALIES_TITLE)
    )
    text = F.concat(
        title, F.lit("\n"),
        F.array_join(F.transform("_l", lambda l: F.concat(F.lit("- "), l.line)), "\n"),
    )
    return (
        sections.select("query_id", "section", text.alias("_t"))
        .groupBy("query_id")
        .agg(
            F.array_join(
                F.array_sort(F.collect_list(F.struct("section", "_t")))["_t"], "\n\n"
            ).alias("block")
        )
    )
