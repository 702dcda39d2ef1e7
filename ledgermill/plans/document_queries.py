"""Queries over documents, sheets, tables and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import documents as D
from ..operators import incremental as I
from ..session import scratch_path
from ..sources import files
from . import duck as Q
from .registry import query

SUMMARY = ["source", "row", "total_rows", "content"]


def order_table(t):
    """Orders as one ledger file per priority; a third kind of cell is blank."""
    return t.orders.select(
        F.concat(F.lit("orders "), "o_orderpriority", F.lit(".csv")).alias("source"),
        F.col("o_orderkey").alias("entry_id"),
        F.col("o_custkey").alias("customer"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount_sar"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
    )


@query(
    "row_documents_orders",
    """
    WITH r AS (
      SELECT 'orders ' || o_orderpriority || '.csv' AS source, o_orderkey, o_custkey,
        CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status,
        CAST(o_totalprice AS DECIMAL(18,2)) AS amount, strftime(o_orderdate, '%Y-%m-%d') AS d
      FROM orders)
    SELECT source,
      row_number() OVER (PARTITION BY source ORDER BY o_orderkey) AS "row",
      count(*) OVER (PARTITION BY source) AS total_rows,
      'CSV: ' || source || chr(10) || concat_ws(' | ', 'entry_id: ' || o_orderkey,
        'customer: ' || o_custkey, 'status: ' || status, 'amount_sar: ' || amount,
        'date: ' || d) AS content
    FROM r
    """,
)
def row_documents_orders(t):
    return D.row_documents(order_table(t), "source", ["entry_id"]).select(*SUMMARY)


@query(
    "row_documents_customer",
    """
    WITH r AS (
      SELECT 'customers.csv' AS source, c_custkey,
        CASE WHEN c_mktsegment = 'MACHINERY' THEN '  '
             WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE c_mktsegment END AS segment,
        CASE WHEN c_acctbal < 5000 THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) END AS balance
      FROM customer)
    SELECT source, "row", total_rows, content FROM (
      SELECT source,
        row_number() OVER (ORDER BY c_custkey) AS "row", count(*) OVER () AS total_rows,
        concat_ws(' | ', CASE WHEN trim(segment) <> '' THEN 'segment: ' || segment END,
          'balance: ' || balance) AS text,
        'CSV: ' || source || chr(10) || text AS content
      FROM r) WHERE text <> ''
    """,
)
def row_documents_customer(t):
    """One file holds every row, and rows without any value are skipped."""
    segment = F.col("c_mktsegment")
    rows = t.customer.select(
        F.lit("customers.csv").alias("source"),
        F.col("c_custkey").alias("_key"),
        F.when(segment == "MACHINERY", F.lit("  ")).when(segment != "FURNITURE", segment).alias("segment"),
        F.when(F.col("c_acctbal") < 5000, F.col("c_acctbal").cast("decimal(18,2)")).alias("balance"),
    )
    return D.row_documents(rows, "source", ["_key"]).select(*SUMMARY)


def order_grid(t):
    """Orders as sheets (one per status) with a banner, a blank row and a
    header before every 250th order key; the header wording alternates."""
    o = t.orders
    key = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    data = F.array(
        text(key), text(F.col("o_totalprice").cast("decimal(18,2)")),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")), F.lit(" open "),
    )
    first = F.pmod(key, F.lit(250)) == 0
    header = F.when(
        F.pmod(key, F.lit(500)) == 0,
        F.array(F.lit(" Order"), F.lit("Total"), F.lit("Priority")),
    ).otherwise(F.array(F.lit("Key"), none, F.lit("Rank"), F.lit("State")))
    line = lambda at, cells: F.struct(
        (key * 4 + at).alias("row_no"), cells.alias("cells")
    )
    rows = F.when(
        first,
        F.array(
            line(0, F.array(F.lit("Section banner"), none, none)),
            line(1, F.array(none, F.lit(" "), none)),
            line(2, header),
            line(3, data),
        ),
    ).otherwise(F.array(line(3, data)))
    return o.select(
        F.lit("book.xlsx").alias("source"), F.col("o_orderstatus").alias("sheet"), F.inline(rows)
    )


@query(
    "sheet_documents",
    """
    WITH h AS (
      SELECT o_orderstatus AS sheet, o_orderkey * 4 + 2 AS row_no, o_orderkey % 500 = 0 AS even
      FROM orders WHERE o_orderkey % 250 = 0),
    d AS (
      SELECT o_orderstatus AS sheet, o_orderkey * 4 + 3 AS row_no, o_orderkey AS k,
        CAST(o_totalprice AS DECIMAL(18,2)) AS total,
        CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS priority,
        row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn,
        count(*) OVER (PARTITION BY o_orderstatus) AS n
      FROM orders),
    j AS (SELECT d.*, h.even FROM d ASOF LEFT JOIN h ON d.sheet = h.sheet AND d.row_no >= h.row_no)
    SELECT sheet AS sheet_name, rn AS "row", n AS total_rows,
      CASE WHEN n > 1500 THEN (rn - 1) // 1500 + 1 END AS part,
      'Sheet: ' || sheet || CASE WHEN n > 1500 THEN ' (Part ' || ((rn - 1) // 1500 + 1) || '/'
        || ((n + 1499) // 1500) || ')' ELSE '' END || chr(10) || concat_ws(' | ',
        CASE WHEN even IS NULL THEN 'Column 1' WHEN even THEN 'Order' ELSE 'Key' END || ': ' || k,
        CASE WHEN even IS NULL OR NOT even THEN 'Column 2' ELSE 'Total' END || ': ' || total,
        CASE WHEN even IS NULL THEN 'Column 3' WHEN even THEN 'Priority' ELSE 'Rank' END || ': ' || priority,
        CASE WHEN even IS NULL OR even THEN 'Column 4' ELSE 'State' END || ':  open ') AS content
    FROM j
    """,
)
def sheet_documents(t):
    return D.sheet_documents(order_grid(t)).select(
        "sheet_name", "row", "total_rows", F.col("part").cast("long").alias("part"), "content"
    )


def texts_with_tables(t):
    """Every document followed by a table of its own columns."""
    table = F.concat(
        F.lit("\n| Doc | Lang | Chars |\n|---|:--|--|\n| "), F.col("doc_id").cast("string"),
        F.lit(" | "), F.when(F.col("lang") != "fr", F.col("lang")).otherwise(""),
        F.lit(" | "), F.col("n_chars").cast("string"),
        F.lit(" |\n| second | row |\nplain line\n| not a table |\n"),
    )
    return t.documents.select("doc_id", F.concat("text", table).alias("text"))


TABLE_TEXTS = """
    WITH src AS (
      SELECT doc_id, text || chr(10) || '| Doc | Lang | Chars |' || chr(10) || '|---|:--|--|' || chr(10)
        || '| ' || doc_id || ' | ' || CASE WHEN lang <> 'fr' THEN lang ELSE '' END || ' | ' || n_chars
        || ' |' || chr(10) || '| second | row |' || chr(10) || 'plain line' || chr(10)
        || '| not a table |' || chr(10) AS text FROM documents),
    l AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)),
        lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS ls FROM src),
    e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM l),
    o AS (SELECT *, starts_with(line, '|') AS pipe,
        starts_with(line, '|') AND ends_with(line, '|') AND coalesce(regexp_matches(
          lead(line) OVER (PARTITION BY doc_id ORDER BY pos), '^\\|[\\s:\\-|]+\\|$'), false) AS opens,
        sum(CASE WHEN starts_with(line, '|') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island
      FROM e),
    m AS (SELECT *, min(CASE WHEN opens THEN pos END) OVER (PARTITION BY doc_id, island ORDER BY pos) AS head FROM o)
"""


@query(
    "markdown_tables",
    TABLE_TEXTS
    + """,
    b AS (SELECT m.doc_id, m.pos,
        list_transform(string_split(regexp_replace(h.line, '^\\|+|\\|+$', '', 'g'), '|'), lambda x: trim(x)) AS labels,
        list_transform(string_split(regexp_replace(m.line, '^\\|+|\\|+$', '', 'g'), '|'), lambda x: trim(x)) AS vals
      FROM m JOIN m h ON h.doc_id = m.doc_id AND h.pos = m.head
      WHERE m.pipe AND m.pos > m.head + 1),
    s AS (SELECT doc_id, pos AS line_no, array_to_string(list_filter(list_transform(
        range(1, least(len(labels), len(vals)) + 1), lambda i:
          CASE WHEN vals[i] = '' THEN NULL WHEN labels[i] = '' THEN vals[i] ELSE labels[i] || ': ' || vals[i] END),
        lambda x: x IS NOT NULL), ' | ') AS sentence FROM b)
    SELECT doc_id, line_no, sentence FROM s WHERE sentence <> ''
    """,
)
def markdown_tables(t):
    return D.markdown_tables(texts_with_tables(t))


@query(
    "markdown_plain_text",
    TABLE_TEXTS
    + """
    SELECT doc_id, md5(coalesce(string_agg(CASE WHEN NOT (pipe AND head IS NOT NULL) AND line <> ''
      THEN line END, chr(10) ORDER BY pos), '')) AS plain_md5 FROM m GROUP BY doc_id
    """,
)
def markdown_plain_text(t):
    return D.markdown_plain_text(texts_with_tables(t)).select(
        "doc_id", F.md5("plain").alias("plain_md5")
    )


def all_documents(t):
    """Prose, web pages and chat turns as one document set."""
    prose = t.documents.select(
        F.col("text").alias("content"), F.concat("source", F.lit(".pdf")).alias("source"),
        F.col("doc_id").cast("int").alias("page"),
    )
    web = t.pages.select(
        F.col("html").alias("content"), F.lit("site.xlsx").alias("source"),
        F.concat(F.lit("sheet "), (F.col("page_id") % 7).cast("string")).alias("sheet_name"),
        F.col("page_id").alias("row"), F.lit(True).alias("table_row"),
    )
    chat = t.conversations.select(
        F.col("text").alias("content"), F.col("turn").alias("row"),
        F.when(F.col("role") == "system", F.lit("scan_table")).alias("extracted_from"),
        F.when(F.col("role") == "user", F.lit("chat upload.csv")).alias("source_file"),
    )
    return D.union_documents(prose, web, chat)


ALL_DOCUMENTS = """
    WITH u AS (
      SELECT text AS content, source || '.pdf' AS source, NULL AS source_file, NULL AS sheet_name,
        doc_id AS page, NULL AS "row", false AS table_row, NULL AS extracted_from FROM documents
      UNION ALL SELECT html, 'site.xlsx', NULL, 'sheet ' || (page_id % 7), NULL, page_id, true, NULL FROM pages
      UNION ALL SELECT text, 'unknown', CASE WHEN role = 'user' THEN 'chat upload.csv' END, NULL, NULL, turn, false,
        CASE WHEN role = 'system' THEN 'scan_table' END FROM conversations),
    d AS (SELECT content, source, coalesce(source_file, source) AS source_file, sheet_name, page, "row",
        table_row, extracted_from FROM u)
"""


@query(
    "union_documents",
    ALL_DOCUMENTS
    + """
    SELECT md5(content) AS content_md5, source, source_file, sheet_name, CAST(page AS BIGINT) AS page,
      CAST("row" AS BIGINT) AS "row" FROM d
    """,
)
def union_documents(t):
    return all_documents(t).select(
        F.md5("content").alias("content_md5"), "source", "source_file", "sheet_name",
        F.col("page").cast("long").alias("page"), "row",
    )


@query(
    "source_labels",
    ALL_DOCUMENTS
    + """
    SELECT CASE WHEN page IS NOT NULL THEN source_file || ' p.' || page
        WHEN sheet_name <> '' THEN source_file || ' / Sheet: ' || sheet_name ELSE source_file END AS source_label,
      '[Source: ' || source_file || CASE WHEN page IS NOT NULL THEN ' | Page ' || page
        WHEN sheet_name <> '' THEN ' | Sheet: ' || sheet_name
        WHEN "row" IS NOT NULL THEN ' | Row ' || "row" ELSE '' END || ']' AS context_label,
      table_row OR regexp_matches(lower(source), '\\.(csv|xlsx|xls)$')
        OR coalesce(ends_with(extracted_from, '_table'), false) AS is_tabular
    FROM d
    """,
)
def source_labels(t):
    return all_documents(t).select(
        D.source_label().alias("source_label"), D.context_label().alias("context_label"),
        D.is_tabular_row().alias("is_tabular"),
    )


@query(
    "file_manifest",
    """
    WITH p AS (SELECT page_id, url || '/report.v1' || CASE page_id % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '.xlsx'
        WHEN 2 THEN '.csv' WHEN 3 THEN '.jpeg' WHEN 4 THEN '.md' ELSE '' END AS path FROM pages),
    e AS (SELECT *, regexp_extract(path, '([^/\\\\]*)$', 1) AS source,
        lower(regexp_extract(path, '[^./]\\.([^./]*)$', 1)) AS extension FROM p),
    k AS (SELECT *, CASE WHEN extension = 'pdf' THEN 'PDF' WHEN extension IN ('xlsx', 'xls') THEN 'Excel'
        WHEN extension = 'csv' THEN 'CSV'
        WHEN extension IN ('png', 'jpg', 'jpeg', 'bmp', 'tiff', 'tif', 'webp') THEN 'Image' END AS file_type FROM e)
    SELECT page_id, source, extension, file_type,
      coalesce(file_type IN ('Excel', 'CSV'), false) AS is_structured,
      CASE WHEN file_type IS NULL THEN 'unsupported' ELSE 'supported' END AS status FROM k
    """,
)
def file_manifest(t):
    ends = F.element_at(
        F.array(*[F.lit(e) for e in (".PDF", ".xlsx", ".csv", ".jpeg", ".md", "")]),
        (F.col("page_id") % 6 + 1).cast("int"),
    )
    paths = t.pages.select("page_id", F.concat("url", F.lit("/report.v1"), ends).alias("path"))
    return files.file_manifest(paths).drop("path")


@query(
    "incremental_new",
    """
    WITH known AS (SELECT DISTINCT text FROM documents WHERE lang IN ('fr', 'de'))
    SELECT min(doc_id) AS doc_id, md5(text) AS content_md5 FROM documents
    WHERE text NOT IN (SELECT text FROM known) GROUP BY text
    """,
)
def incremental_new(t):
    docs = t.documents.select("doc_id", "lang", F.col("text").alias("content"))
    seen = docs.filter(F.col("lang").isin("fr", "de")).select(
        I.fingerprint(F.col("content")).alias("fingerprint")
    )
    return I.incremental_new(docs, seen.distinct()).select(
        "doc_id", F.md5("content").alias("content_md5")
    )


@query(
    "manifest_round_trip",
    """
    WITH known AS (SELECT DISTINCT text FROM documents WHERE lang IN ('fr', 'de'))
    SELECT min(doc_id) AS doc_id, md5(text) AS content_md5, (SELECT count(DISTINCT text) FROM documents) AS n_recorded
    FROM documents WHERE text NOT IN (SELECT text FROM known) GROUP BY text
    """,
)
def manifest_round_trip(t):
    """Two batches over a stored manifest, each run twice; the second finds what the first left."""
    path = scratch_path(t.spark, "manifest")
    docs = t.documents.select("doc_id", "lang", F.col("text").alias("content"))
    for batch, part in enumerate((docs.filter(F.col("lang").isin("fr", "de")), docs)):
        for _ in range(2):
            fresh = I.process_new(part, path, "run-1", batch)
    recorded = I.read_manifest(t.spark, path).agg(F.count(F.lit(1))).scalar()
    return fresh.select("doc_id", F.md5("content").alias("content_md5"), recorded.alias("n_recorded"))


@query(
    "small_table_test",
    """
    SELECT 'nation ' || c_nationkey || '.csv' AS source, count(*) AS n_rows,
      CAST(floor(sum(length(c_custkey || ',' || c_name || ',' || CAST(c_acctbal AS DECIMAL(18,2))
        || ',' || c_mktsegment)) / 3) AS BIGINT) AS est_tokens,
      n_rows <= 200 AND est_tokens <= 6000 AS is_small
    FROM customer GROUP BY c_nationkey
    """,
)
def small_table_test(t):
    rows = t.customer.withColumn("balance", F.col("c_acctbal").cast("decimal(18,2)")).withColumn(
        "source", F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"), F.lit(".csv"))
    )
    return D.small_table_test(rows, "source", ["c_custkey", "c_name", "balance", "c_mktsegment"])


@query(
    "full_table_documents",
    """
    WITH r AS (
      SELECT 'region ' || r_name || '.xlsx' AS source, 'nations' AS sheet, n_nationkey AS id, n_name AS name
      FROM nation JOIN region ON n_regionkey = r_regionkey
      UNION ALL
      SELECT 'region ' || r_name || '.xlsx', 'suppliers', s_suppkey, s_name
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      UNION ALL
      SELECT 'orders.xlsx', o_orderstatus, o_orderkey, o_orderpriority FROM orders),
    ok AS (SELECT source FROM r GROUP BY source
      HAVING count(*) <= 200 AND floor(sum(length(id || ',' || name)) / 3) <= 6000),
    s AS (SELECT source, sheet, count(*) AS n, 'Source file: ' || source || chr(10) || 'Sheet: ' || sheet
        || chr(10) || 'Rows: ' || count(*) || chr(10) || 'CSV:' || chr(10) || 'id,name' || chr(10)
        || string_agg(id || ',' || name, chr(10) ORDER BY id) AS block
      FROM r WHERE source IN (SELECT source FROM ok) GROUP BY source, sheet)
    SELECT source, CAST(sum(n) AS BIGINT) AS total_rows,
      string_agg(block, chr(10) || chr(10) ORDER BY sheet) AS content FROM s GROUP BY source
    """,
)
def full_table_documents(t):
    home = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.concat(F.lit("region "), F.col("r_name"), F.lit(".xlsx")).alias("source")
    nations = home.select(name, F.lit("nations").alias("sheet"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    suppliers = t.supplier.join(home, F.col("s_nationkey") == F.col("n_nationkey")).select(
        name, F.lit("suppliers").alias("sheet"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")
    )
    orders = t.orders.select(
        F.lit("orders.xlsx").alias("source"), F.col("o_orderstatus").alias("sheet"),
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"),
    )
    rows = nations.unionByName(suppliers).unionByName(orders)
    return D.full_table_documents(rows, "source", ["id"], ["id", "name"], "sheet").select(
        "source", "total_rows", "content"
    )


def corpus(t, spread=True):
    """All documents; without ``spread`` their texts stay in their splits."""
    table = t.spread("documents") if spread else t.documents
    return D.union_documents(table.select("doc_id", F.col("text").alias("content"), "source"))


@query(
    "chunk_documents",
    """
    WITH d AS (SELECT doc_id, text, greatest(1, CAST(ceil((length(text) - 100) / 1400.0) AS BIGINT)) AS n FROM documents),
    c AS (SELECT doc_id, text, unnest(range(0, n)) AS chunk_no FROM d)
    SELECT doc_id, chunk_no, md5(substr(text, chunk_no * 1400 + 1, 1500)) AS chunk_md5,
      CAST(length(substr(text, chunk_no * 1400 + 1, 1500)) AS BIGINT) AS n_chars FROM c
    """,
)
def chunk_documents(t):
    return D.chunk_documents(corpus(t)).select(
        "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"),
        F.md5("content").alias("chunk_md5"), F.length("content").cast("long").alias("n_chars"),
    )


def _paragraph_cut() -> str:
    ends = [f"length(regexp_extract(b, '(?s)^.*{mark}'))" for mark in ("\\n\\n", "\\n", " ")]
    inner = ", ".join(f"CASE WHEN {end} * 2 > {STEP} THEN {end} END" for end in ends)
    return f"CASE WHEN i = len(bs) THEN length(b) ELSE coalesce({inner}, {STEP}) END"


STEP = D.paragraph_step(C.CHUNK_SIZE, C.CHUNK_OVERLAP)
PARAGRAPHS = rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(text, '(?s).{{1,{STEP}}}') AS bs FROM documents),
    b AS (SELECT doc_id, i, bs[i] AS b, {_paragraph_cut().replace('(b,', '(bs[i],').replace('length(b)', 'length(bs[i])')} AS cut
      FROM (SELECT *, unnest(range(1, len(bs) + 1)) AS i FROM d)),
    l AS (SELECT *, lag(b) OVER w AS pb, lag(cut) OVER w AS pc FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    p AS (SELECT doc_id, i, {Q.strip(rf"(coalesce(regexp_replace(substring(pb, greatest(pc - {C.CHUNK_OVERLAP} + 1, 1), least(pc, {C.CHUNK_OVERLAP})), '^\S*\s', '') || substring(pb, pc + 1), '') || substring(b, 1, cut))")} AS t FROM l)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_no, md5(t) AS chunk_md5, length(t) AS n_chars
    FROM p WHERE t <> ''
"""


@query("chunk_by_paragraph", PARAGRAPHS)
def chunk_by_paragraph(t):
    return D.chunk_by_paragraph(corpus(t)).select(
        "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"),
        F.md5("content").alias("chunk_md5"), F.length("content").cast("long").alias("n_chars"),
    )


@query(
    "document_info",
    """
    SELECT source AS filename, count(*) AS pages,
      CAST(sum(greatest(1, ceil((length(text) - 100) / 1400.0))) AS BIGINT) AS chunks
    FROM documents GROUP BY source
    """,
)
def document_info(t):
    docs = corpus(t)
    return D.document_info(docs, D.chunk_documents(docs)).select("filename", "pages", "chunks")

