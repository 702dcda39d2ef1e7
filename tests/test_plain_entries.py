"""Entries read in plain Python: as the expressions have them, and which are left to these."""

import json

import pytest
from ledgermill.operators import evaluation as E
from ledgermill.operators import plain_entries as P
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCES = ["[Source: a.csv | Row 5]\nTotal price: 1,250.50 SAR | Customer: 7", "Fee 12.5% agreed\n- Penalty: (3) bn", "plain note"]
PLAIN = [
    {"question": "total price?", "answer": "- Total price was 1250.5 SAR.\n- Fee 13%\n1. Customer 7 2) Penalty -3 bn", "source_texts": SOURCES},
    {"question": None, "retrieved": [["Total 5m", None], {"b": True, "a": "x 5,000,000"}, 7, "total: $5 mn"], "source_chunks": ["total 5,000,000 usd", "b: True"]},
    {"answer": "unnamed: 4 rated 3.7/5 by num_5 of 9", "source_texts": "rated 3.7 by 9 num_5"},
    {"question": "ما هو السعر؟", "answer": "- السعر ١٢٫٥ ريال هو َ 3 من 4\n• 5٪ é", "source_texts": ["السعر 12 3 ريال", "5% é | x"]},
    {"answer": "fee 7", "expected_items": ["Fee: 7", "fee 7", "7 fee"], "confidence": 0.5},
    {"answer": "fee 7", "relevant": ["fee 7"], "source_texts": ["fee 7"]},
    {"answer": "no relevant documents for 2024", "source_texts": []},
    {"answer": "x" * 90 + " 5 " + "word " * 60, "source_texts": ["word 5 \t x"]},
    {"question": "weather", "answer": ["a 5", "b: 5", "c 5"], "source_texts": ["a 5 z", "z 5 a", "d 6"]},
]
LEFT = [
    '{"answer": 1.5, "relevant": ["1.5"]}', '{"answer": "5", "answer": "6", "source_texts": "5"}', '{"answer": "5"',
    '{"answer": "5\\u2028", "source_texts": ["5"]}', '{"answer": {"a": {"b": 5}}, "relevant": ["a"]}', "not json",
    '{"answer": "5 \\u0130", "source_texts": ["5 \\u0130"]}', '{"answer": 12345678901234567890, "relevant": ["1"]}',
]
NONE = ["[5]", "{}", '{"answer": "5"}', '{"source_texts": "5"}', None]


@pytest.fixture(scope="module")
def log(spark):
    rows = [json.dumps(e, ensure_ascii=i % 2 == 0) for i, e in enumerate(PLAIN)] + LEFT + NONE
    return spark.createDataFrame(list(enumerate(rows)), "entry_id long, entry_json string").cache()


def by_expressions(entries, tell, shape, *_, **__):
    told = [F.lit(None).cast(f.dataType).alias(f"told_{f.name}") for f in T._parse_datatype_string(shape).fields]
    return entries.select("entry_id", "entry_json", F.lit(False).alias("told"), *told)


def both_ways(monkeypatch, query):
    plain = sorted(map(repr, query().collect()))
    monkeypatch.setattr(P, "read_entries", by_expressions)
    assert plain == sorted(map(repr, query().collect())) and plain


def plans(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_what_is_left(log):
    found = {r.entry_id: r.told for r in P.read_entries(log, P.counts(True), P.COUNTS).collect()}
    assert found == {i: i < len(PLAIN) for i in range(len(PLAIN) + len(LEFT))}


@pytest.mark.parametrize("options", [{}, {"normalize": False, "apply_filter": False}])
def test_evaluate_history(log, monkeypatch, options):
    assert "MapInArrow" in plans(E.evaluate_history(log, **options))
    both_ways(monkeypatch, lambda: E.evaluate_history(log, **options))


def test_false_positives(log, monkeypatch):
    assert "MapInArrow" in plans(E.false_positives(log))
    both_ways(monkeypatch, lambda: E.false_positives(log))


@pytest.mark.parametrize("options", [{}, {"apply_filter": False}, {"retrieved_key": "answer", "relevant_key": "relevant"}])
def test_history_records(log, monkeypatch, options):
    assert "MapInArrow" in plans(E.history_records(log, **options))
    both_ways(monkeypatch, lambda: E.history_records(log, **options))


def test_false_positive_report(log, monkeypatch):
    assert "MapInArrow" in plans(E.false_positive_report(log))
    both_ways(monkeypatch, lambda: E.false_positive_report(log))
