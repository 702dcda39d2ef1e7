"""Texts that are only looked up by their hits are not dealt over the cores."""

import pytest
from ledgermill.operators import retrieval as R
from ledgermill.operators.documents import union_documents
from ledgermill.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["dedupe_hits", "assembled_context"])
def test_no_text_is_dealt(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan


def test_few_and_many_hits_alike(spark, monkeypatch):
    hits = spark.createDataFrame(
        [(1, 1, 0.5, 0), (1, 2, 0.4, 1), (1, 3, 0.3, 2), (2, 3, 0.9, 0), (2, 9, 0.1, 1)],
        "query_id long, doc_id long, score double, rank long",
    )
    docs = spark.createDataFrame([(1, " a"), (2, "a "), (3, "b"), (4, "a"), (5, None)], "doc_id long, content string")
    few = sorted(map(tuple, R.dedupe_hits(hits, docs).collect()))
    monkeypatch.setattr(R, "BROADCAST_HITS", 0)
    assert few == sorted(map(tuple, R.dedupe_hits(hits, docs).collect()))
    assert [r[:2] for r in few] == [(1, 1), (1, 3), (2, 3)]


def test_context_of_few_and_many_hits_alike(spark, monkeypatch):
    hits = spark.createDataFrame([(1, 2, 0), (1, 1, 1), (2, 9, 0)], "query_id long, doc_id long, rank long")
    docs = spark.createDataFrame([(i, f"t{i}", "s") for i in range(5)], "doc_id long, content string, source string")
    docs = union_documents(docs)
    assert "LeftSemi" in R.assemble_context(hits, docs)._jdf.queryExecution().optimizedPlan().toString()
    few = sorted(map(tuple, R.assemble_context(hits, docs).collect()))
    monkeypatch.setattr(R, "BROADCAST_HITS", 0)
    assert few == sorted(map(tuple, R.assemble_context(hits, docs).collect()))
    assert [r[0] for r in few] == [1] and few[0][2] == 2
