"""Cases that tidy tables do not hold: nulls, repeats, odd formats."""

import pytest
from pyspark.sql import functions as F

from ledgermill.operators import charts, documents, evaluation, finance, ordering, retrieval, verify


@pytest.mark.parametrize(
    "value, text",
    [(12345678.123456789, "12345678.12345679"), (0.0001, "0.0001"), (1e22, "1" + "0" * 22 + ".0"), (-1.5e-9, "-0.0000000015"),
     (1234567.5, "1234567.5"), (1e7, "10000000.0"), (-2.5e16, "-25000000000000000.0"), (0.0, "0.0")],
)
def test_cells_keep_all_digits(spark, value, text):
    frame = spark.createDataFrame([(value,)], "x double")
    assert frame.select(documents.cell_text("x", frame.schema["x"].dataType)).first()[0] == text


def test_sheets_without_a_name(spark):
    rows = [("s", None, 1, ["name", "amount"]), ("s", None, 2, ["a", "1"]), (None, "t", 1, ["name", "amount"]), (None, "t", 2, ["b", "2"])]
    grid = spark.createDataFrame(rows, "source string, sheet string, row_no long, cells array<string>")
    assert {r["content"].split("\n")[0] for r in documents.sheet_documents(grid).collect()} == {"Sheet: ", "Sheet: t"}


def test_csv_blocks_with_quoted_breaks_and_names(spark):
    frame = spark.createDataFrame([("s", 1, "x\ny"), ("s", 2, 'say "z", ok')], 'src string, id int, `note, long` string')
    table = documents.full_table_documents(frame, "src", ["id"], ["id", "note, long"]).withColumn("doc_id", F.lit(1))
    rows = sorted((r["fields"] for r in finance.parse_csv_blocks(table).collect()), key=lambda f: f["id"])
    assert rows == [{"id": "1", "note, long": "x\ny"}, {"id": "2", "note, long": 'say "z", ok'}]


def test_reply_with_a_repeated_key(spark):
    frame = spark.createDataFrame([(1, '[{"Label":"a","label":"b","value":1}]')], "query_id long, reply string")
    assert [(r["label"], r["value"]) for r in charts.clean_series(frame).collect()] == [("b", 1.0)]


def test_ties_round_to_even(spark):
    frame = spark.range(1).select(*[evaluation.round_even(F.lit(x), 2).alias(str(i)) for i, x in enumerate((0.125, 0.625, 0.135, 1 / 3))])
    assert list(frame.first()) == [0.12, 0.62, 0.14, 0.33]


def test_check_without_a_verdict_is_bad(spark):
    checks = spark.createDataFrame(
        [(1, 1, "5", None, None, "a", "a")],
        "answer_id long, attempt long, number_in_answer string, row_label_in_source string, matches_question_intent boolean, "
        "source_file_claimed string, source_file_actual string",
    )
    row = verify.check_outcomes(checks).first()
    assert row["is_bad"] and "'None'" in row["note"]


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_vectors_at_every_size_and_with_nulls(spark, metric):
    far = [[1e6 + i * 0.5, 1e6 - i * 0.25 + (i % 3)] for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(far)) + [(90, None), (91, [1.0]), (92, [None, 1.0])], "doc_id long, embedding array<double>")
    asks = spark.createDataFrame([(i, far[i]) for i in range(0, 60, 7)] + [(99, None)], "query_id long, embedding array<double>")
    answers = [
        sorted((r["query_id"], r["rank"], r["doc_id"]) for r in retrieval.vector_topk(asks, docs, 3, metric=metric, block_bytes=size).collect())
        for size in (1 << 20, 40)
    ]
    assert answers[0] == answers[1] and len(answers[0]) == 27
    if metric == "l2":
        assert all(q == d for q, rank, d in answers[0] if rank == 0)
        cells = retrieval.vector_topk_blocks(asks, docs, 3, metric=metric)
        assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in cells.collect()) == answers[0]


def test_terms_are_counted_in_their_row(spark):
    frame = spark.createDataFrame([(1, "b a b 7"), (2, ""), (3, None)], "doc_id long, content string")
    found = retrieval.build_postings(frame)
    assert sorted((r["doc_id"], r["dl"], r["term"], r["tf"]) for r in found.collect()) == [(1, 5, "7", 2), (1, 5, "a", 1), (1, 5, "b", 2)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_segments_follow_the_rows(spark):
    keys = [10**12] + list(range(20000)) + [7] * 500
    frame = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long")
    cut = ordering.with_segments(frame, "k", 8)
    sizes = [r["count"] for r in cut.groupBy(ordering.SEGMENT).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 1.5 * len(keys) / 8
    spans = sorted(map(tuple, cut.groupBy(ordering.SEGMENT).agg(F.min("k"), F.max("k")).collect()))
    assert all(a[2] < b[1] for a, b in zip(spans, spans[1:]))
