"""Texts of an entry are described once, and bound values are not copied."""

import json

from ledgermill.functions import numbers as N
from ledgermill.functions.text import let, strip, strip_text
from ledgermill.operators import evaluation as E
from pyspark.sql import functions as F

ODD = [
    "", " ", "Total: 1,250.50 SAR", "Unnamed: 3 price 5%", "rated 3.7/5 on 2024", "3 out of 4 high", "3 من 5 السعر",
    "الإجمالي ١٢٣ ريال", "num_5 and 5", "pct_ 7 million", " 5 $", "a \u0085", "\t5\n ", "(5) bn\x0b", "é 7", "out 4",
]


def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(99, None)], "id long, t string")


def test_described_once_like_twice(spark):
    t = F.col("t")
    for row in texts(spark).select(
        "t", N.describe_both(t).alias("b"), N.describe(t).alias("d"), N.describe_plain(t).alias("p")
    ).collect():
        assert (row.b.text, row.b.numbers, row.b.words) == (row.d.text, row.d.numbers, row.d.words), row.t
        assert row.b.plain == row.p, row.t


def test_strip_text_is_strip(spark):
    for row in texts(spark).select("t", strip_text(F.col("t")).alias("a"), strip(F.col("t")).alias("b")).collect():
        assert row.a == row.b, row.t


def test_bound_values_are_not_copied(spark):
    twice = let(F.col("t"), lambda a: let(F.concat(a, a), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    found = texts(spark).select(twice.alias("r"), "t")
    assert all(r.r.a == r.t and r.r.b == (None if r.t is None else r.t * 2) for r in found.collect())
    # a transformed array copies each of its elements
    assert "transform(" not in found._jdf.queryExecution().optimizedPlan().toString()


def entries(spark):
    told = [
        {"question": "", "answer": ["total 5 SAR", "total: 5 sar", "fee 7%"], "source_texts": ["total 5 SAR | fee 8", "x"]},
        {"question": "fee?", "answer": "- fee 7%\n- fee 9", "expected_items": ["Fee 7 %"], "source_texts": "fee 7%"},
        {"answer": None, "source_texts": []},
        {"answer": "unnamed: 4 rated 3/5 by 9", "source_texts": ["rated 3/5 by 9"]},
    ]
    rows = [(i, json.dumps(t, ensure_ascii=False)) for i, t in enumerate(told)] + [(8, "no json"), (9, None)]
    return spark.createDataFrame(rows, "entry_id long, entry_json string")


def test_history_counts_its_own_records(spark):
    for options in ({}, {"apply_filter": False}):
        for normalize in (True, False):
            log = entries(spark)
            counted = E.evaluate_history(log, normalize, **options)
            again = E.evaluate_records(E.history_records(log, **options), normalize)
            assert sorted(map(str, counted.collect())) == sorted(map(str, again.collect()))


def test_history_prepares_texts_in_five_places(spark):
    plan = E.evaluate_history(entries(spark))._jdf.queryExecution().optimizedPlan().toString()
    # an item's key and description, a source, the question, a reference's key; each names the pattern twice
    assert 0 < plan.count("unnamed\\s*") <= 10
