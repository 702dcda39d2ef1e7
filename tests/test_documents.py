from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgermill.operators import documents as D
from ledgermill.operators import finance as A
from ledgermill.operators import incremental as I
from ledgermill.operators.ordering import SEGMENT, number_rows, spread_join, place_rows
from ledgermill.sources import chatlog, files


def test_csv_rows_to_documents_and_back(spark, tmp_path):
    (tmp_path / "ledger.csv").write_text("entry_id,amount_sar,note\nE-101,1000,\n,,\nE-102,2000.5,ok\n")
    table = files.read_table(spark, str(tmp_path / "ledger.csv"))
    docs = D.union_documents(D.row_documents(table, "_source", ["_block", "_seq"])).orderBy("row")
    rows = docs.collect()
    assert [r["row"] for r in rows] == [1, 3] and {r["total_rows"] for r in rows} == {3}
    assert rows[0]["content"] == "CSV: ledger.csv\nentry_id: E-101 | amount_sar: 1000.0"
    assert rows[0]["source_file"] == "ledger.csv" and rows[0]["table_row"]
    parsed = A.parse_row_sentences(docs).orderBy("row").collect()
    assert parsed[1]["fields"] == {"entry_id": "E-102", "amount_sar": "2000.5", "note": "ok"}
    chunks = D.chunk_documents(docs)
    assert chunks.count() == 2  # table rows are never split


def test_row_sentences(spark):
    texts = ["x\na: 1 | a: 2,000 SAR | : 3 | b: nan | c", "no pipe: here", "a: b | c"]
    docs = spark.createDataFrame([(t,) for t in texts], "content string").select(A.row_fields(F.col("content")).alias("f"))
    assert [r["f"] for r in docs.collect()] == [{"a": "2000", "b": None}, None, {"a": "b"}]


def test_header_rows(one):
    header = ["entry_id", "date", "description", "counterparty", "amount_sar", "vat_number", "invoice_number"]
    entry = ["E-101", "2026-05-02 00:00:00", "Office rent May", "Al Rajhi Properties", "15000", "310123456700003", "INV-2026-101"]
    is_header = lambda cells: one(lambda _: D.is_header_row(F.array(*[F.lit(c) for c in cells])), "")
    assert is_header(header) and not is_header(entry) and not is_header(["Only one", " "])


def test_sheet_sections(spark):
    rows = [
        (0, ["Report"]), (1, ["1", "2"]), (2, ["Name", "Total", None]), (3, ["a1", "5", "x"]),
        (4, [None, " "]), (5, ["Deal", "Stage"]), (6, ["D-1", "open"]), (7, ["lonely"]),
    ]
    grid = spark.createDataFrame([("f.xlsx", "S", n, c) for n, c in rows], "source string, sheet string, row_no long, cells array<string>")
    for segments in (1, 3, 50):
        out = D.sheet_documents(grid, part_rows=2, segments=segments).orderBy("row").collect()
        assert [r["content"] for r in out] == [
            "Sheet: S (Part 1/2)\nColumn 1: 1 | Column 2: 2",
            "Sheet: S (Part 1/2)\nName: a1 | Total: 5 | Column 3: x",
            "Sheet: S (Part 2/2)\nDeal: D-1 | Stage: open",
        ]


def test_markdown_tables(spark):
    text = "intro\n| a | b |\n|---|---|\n| 1 | |\n| 2 | 3 | 4 |\nend\n| x | y |\nno table"
    docs = spark.createDataFrame([(1, text), (2, "plain\n\n text ")], "doc_id long, text string")
    assert [r["sentence"] for r in D.markdown_tables(docs).orderBy("line_no").collect()] == ["a: 1", "a: 2 | b: 3"]
    plain = {r["doc_id"]: r["plain"] for r in D.markdown_plain_text(docs).collect()}
    assert plain == {1: "intro\nend\n| x | y |\nno table", 2: "plain\ntext"}


def test_small_and_large_tables(spark):
    large = spark.range(501).select(F.lit("large.csv").alias("source"), "id", (F.col("id") * 2).alias("amount_sar"))
    small = spark.createDataFrame([("p.csv", 201, 75000), ("p.csv", 202, 90000)], "source string, id long, amount_sar long")
    docs = D.full_table_documents(large.unionByName(small), "source", ["id"], ["id", "amount_sar"]).collect()
    assert [d["content"] for d in docs] == ["Source file: p.csv\nRows: 2\nCSV:\nid,amount_sar\n201,75000\n202,90000"]
    assert docs[0]["table_full_context"] and docs[0]["total_rows"] == 2


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n", max_size=300), min_size=1, max_size=8))
def test_chunks_rebuild_the_text(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    docs = D.union_documents(frame)
    for row in D.chunk_documents(docs, 40, 10).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "content"))).alias("c")).collect():
        pieces = [c["content"] for c in row["c"]]
        assert pieces[0] + "".join(p[10:] for p in pieces[1:]) == texts[row["doc_id"]]
        assert all(len(p) <= 40 for p in pieces)
    words = D.chunk_by_paragraph(docs, 40, 10).groupBy("doc_id").agg(F.concat_ws(" ", F.collect_list("content")).alias("c"), F.max(F.length("content")).alias("n")).collect()
    for row in words:
        assert row["n"] <= 40
        assert set(texts[row["doc_id"]].replace("\n", " ").replace(" ", "")) == set(row["c"].replace("\n", " ").replace(" ", ""))


def test_numbering_does_not_depend_on_segments(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 1000).alias("k"))
    rows = rows.withColumn("g", F.when(F.col("g") == 2, None).otherwise(F.col("g")))
    want = {(r["g"], r["k"]): (r["row"], r["n"]) for r in number_rows(rows, ["g"], ["k"], total="n", segments=1).collect()}
    for segments in (2, 7, 300):
        got = {(r["g"], r["k"]): (r["row"], r["n"]) for r in number_rows(rows, ["g"], ["k"], total="n", segments=segments).collect()}
        assert got == want
    assert sorted(v[0] for k, v in want.items() if k[0] is None) == list(range(1, 334))


def test_numbering_by_text_order(spark):
    rows = spark.range(500).select((F.col("id") % 2).alias("g"), F.md5(F.col("id").cast("string")).alias("k"))
    got = number_rows(rows, ["g"], ["k"], row="at", total="n").collect()
    for g in (0, 1):
        mine = sorted((r["at"], r["k"]) for r in got if r["g"] == g)
        assert [a for a, _ in mine] == list(range(1, 251)) and [k for _, k in mine] == sorted(k for _, k in mine)
    assert {r["n"] for r in got} == {250}


def test_spread_join_matches_plain_join(spark):
    left = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    right = right.withColumn("n", F.lit(50))
    for task_rows in (7, 1000):
        got = spread_join(left, right, ["k"], ["id"], size="n", task_rows=task_rows)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").select("k", "id", "v", "n").collect()))


def test_equal_order_keys_spread_over_segments(spark):
    rows = spark.range(20_000).select(F.lit("s").alias("g"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("k"))
    placed = place_rows(rows, ["g"], ["k"], 8)
    sizes = [r["count"] for r in placed.groupBy(SEGMENT).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * 20_000 / 8
    numbered = number_rows(rows, ["g"], ["k"], segments=8).collect()
    assert sorted(r["row"] for r in numbered) == list(range(1, 20_001))
    assert [r["k"] for r in sorted(numbered, key=lambda r: r["row"])] == sorted(r["k"] for r in numbered)


def test_incremental_runs_add_nothing_twice(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, content string")
    empty = spark.createDataFrame([], "fingerprint string")
    first = I.incremental_new(docs, empty)
    assert sorted(r["doc_id"] for r in first.collect()) == [1, 2]
    assert I.incremental_new(docs, first.select("fingerprint")).count() == 0
    assert I.new_fingerprints(docs, empty).count() == 2


def test_records_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["x", "y"], "a,b")], "b long, a array<string>, c string")
    files.write_results(rows, str(tmp_path / "out"), "csv")
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert back.columns == ["a", "b", "c"] and tuple(back.first()) == ('["x","y"]', "1", "a,b")
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n\nbroken\n[1]\n{"b": 2}\n')
    assert sorted(r["entry_json"] for r in files.read_records(spark, str(tmp_path / "r.jsonl")).collect()) == ['{"a": 1}', '{"b": 2}']


def test_manifest_of_a_folder(spark, tmp_path):
    for name in ("a.PDF", "b.csv", "c.md", "d.webp", "noext"):
        (tmp_path / name).write_text("x")
    found = files.file_manifest(files.list_files(spark, str(tmp_path))).collect()
    assert {r["source"]: (r["file_type"], r["status"]) for r in found} == {
        "a.PDF": ("PDF", "supported"), "b.csv": ("CSV", "supported"), "c.md": (None, "unsupported"),
        "d.webp": ("Image", "supported"), "noext": (None, "unsupported"),
    }


def test_chat_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("s1", i, '{"question": "q%d", "answer": "a"}' % i, float(i)) for i in range(9)] + [("s2", 1, "{bad", 0.0), ("s2", 2, '{"answer": "z"}', 0.0)]
    chatlog.append_entries(spark.createDataFrame(rows, chatlog.ENTRY_SCHEMA), path)
    assert [r["id"] for r in chatlog.load_history(spark, path, "s2").collect()] == [2]
    turns = chatlog.last_turns(chatlog.load_all_history(spark, path)).filter("session_id = 's1'").orderBy("id").collect()
    assert [r["question"] for r in turns] == ["q3", "q4", "q5", "q6", "q7", "q8"]
    chatlog.clear_session(spark, path, "s1")
    assert {r["session_id"] for r in chatlog.load_all_history(spark, path).collect()} == {"s2"}
    chatlog.append_entries(spark.createDataFrame([("s1", 20, "{}", 1.0)], chatlog.ENTRY_SCHEMA), path)
    assert [r["id"] for r in chatlog.load_history(spark, path, "s1").collect()] == [20]
