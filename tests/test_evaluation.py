import json

import pytest
from pyspark.sql import functions as F

from ledgermill.operators import evaluation as E


def items(spark, pairs):
    rows = [(i, side, item) for i, (r, v) in enumerate(pairs) for side, group in (("retrieved", r), ("relevant", v)) for item in group]
    frame = spark.createDataFrame(rows, "entry_id long, side string, item string")
    return frame, spark.range(len(pairs)).withColumnRenamed("id", "entry_id")


def test_micro_average(spark):
    frame, entries = items(spark, [({"revenue", "net income"}, {"revenue", "net income", "capex"}), ({"cash flow", "ebitda"}, {"cash flow"}), (set(), {"debt"}), (set(), set())])
    rows = E.evaluate(frame, entries).collect()
    total = next(r for r in rows if r["is_total"])
    assert (total["tp"], total["fp"], total["fn"], total["n_entries"]) == (3, 1, 2, 4)
    assert (total["precision"], total["recall"], total["accuracy"]) == (0.75, 0.6, 0.5)
    assert total["f1_score"] == pytest.approx(2 * 0.75 * 0.6 / 1.35)
    empty = next(r for r in rows if r["entry_id"] == 3 and not r["is_total"])
    assert (empty["precision"], empty["recall"], empty["f1_score"], empty["accuracy"]) == (0.0, 0.0, 0.0, 0.0)


def test_normalized_and_exact(spark):
    frame, _ = items(spark, [({"cash flow: SAR 22 million"}, {"cash flow: 22,000,000 SAR"})])
    assert E.match_items(frame).first()["outcome"] == "TP"
    assert E.match_items(frame, normalize=False).count() == 2
    assert E.error_analysis(frame).first()["likely_cause"] == "matching/normalization"
    assert E.categorized_errors(frame).first()["category"] == "matching/normalization"


def entries(spark, *records):
    rows = [(i, json.dumps(r, ensure_ascii=False) if not isinstance(r, str) else r) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "entry_id long, entry_json string")


def sides(frame):
    return [(set(r["retrieved"]), set(r["relevant"])) for r in sorted(frame.collect(), key=lambda r: r["entry_id"])]


def test_explicit_references(spark):
    log = entries(
        spark,
        {"extracted_items": ["revenue", "net income"], "expected_items": ["revenue", "net income", "capex"]},
        {"extracted_items": ["cash flow", "ebitda"], "expected_items": ["cash flow"]},
        {"answer": "chat entry without relevant items"}, "broken {", "[1]",
    )
    total = E.evaluate_history(log).filter("is_total").first()
    assert (total["n_entries"], total["tp"], total["fp"], total["fn"]) == (2, 3, 1, 1)


def test_items_from_answers_and_sources(spark):
    log = entries(spark, {
        "question": "show revenue and cash flow", "answer": "**Facts**\n- Revenue was 100m SAR.\n- Cash flow was SAR 22 million.",
        "source_texts": ["[Source: report.xlsx]\nRevenue was 100m SAR | Cash flow was 22,000,000 SAR"],
    })
    both = {"Revenue was 100m SAR.", "Cash flow was SAR 22 million."}
    assert sides(E.history_records(log)) == [(both, both)]


def test_repeated_sources_are_no_reference(spark):
    texts = ["[Source: report.xlsx]\nRevenue was 100m SAR | Cash flow was 22,000,000 SAR"]
    log = entries(spark, {"answer": "- Revenue was 100m SAR.\n- Unsupported margin was 9%.", "relevant": texts, "source_texts": texts})
    assert sides(E.history_records(log)) == [({"Revenue was 100m SAR."}, {"Revenue was 100m SAR."})]
    assert sides(E.history_records(log, apply_filter=False)) == [({"Revenue was 100m SAR.", "Unsupported margin was 9%."}, {"Revenue was 100m SAR."})]


ARABIC = ("المؤشر,المعدل (1-4),% من المشاركين\nالعائد مقابل الوقت والجهد المستثمر (ROI),{}")


def test_scale_and_blended_rows(spark):
    texts = ["[Source: impact.xlsx]\n" + ARABIC.format("3.71 من 4, 100%") + "\nاكتشاف مواهب جديدة,57%\nتذكر السمات الخمس الأولى,86%"]
    answer = "- مؤشر ROI هو 3.71 من 4 مع 100% من المشاركين.\n- 57% اكتشفوا مواهب جديدة و86% يتذكرون السمات."
    log = entries(spark, {"question": "ما هو مؤشر ROI؟", "answer": answer, "relevant": texts, "source_texts": texts})
    good = {"مؤشر ROI هو 3.71 من 4 مع 100% من المشاركين."}
    assert sides(E.history_records(log)) == [(good, good)]
    report = {r["category"]: r["n_items"] for r in E.false_positive_report(log).collect()}
    assert report["cross_row_or_blended_figure"] == 1


def test_strict_acceptance_does_not_become_the_reference(spark):
    texts = ["[Source: impact.xlsx]\n" + ARABIC.format("3.71,100%")]
    log = entries(spark, {"question": "ما هو مؤشر ROI؟", "answer": "- مؤشر ROI هو 3.71 من 4 مع 100% من المشاركين.", "relevant": texts, "source_texts": texts})
    assert sides(E.history_records(log)) == [({"مؤشر ROI هو 3.71 من 4 مع 100% من المشاركين."}, set())]


def test_jsonl_pairs(spark):
    log = entries(spark, {"retrieved": ["revenue: SAR 100m", "margin: 9%"], "relevant": ["revenue: SAR 100m"]}, {"retrieved": ["not evaluable"]})
    assert sides(E.jsonl_pairs(log)) == [({"revenue: SAR 100m", "margin: 9%"}, {"revenue: SAR 100m"})]


def score(**changes):
    base = {"groundedness": 5, "numerical_accuracy": 5, "relevance": 4, "clarity": 4, "overall": 4.5, "unsupported_claims": [], "rationale": "ok"}
    return json.dumps({k: v for k, v in {**base, **changes}.items() if v != "drop"})


@pytest.mark.parametrize(
    "raw, status",
    [
        (score(), "ok"), (score(overall=4), "ok"), (score(groundedness=6), "judge_failed"), (score(clarity="4"), "judge_failed"), (score(clarity=4.0), "judge_failed"),
        (score(overall=0.5), "judge_failed"), (score(rationale="x" * 1001), "judge_failed"), (score(rationale="x" * 1000), "ok"), (score(unsupported_claims=["a"]), "ok"),
        (score(unsupported_claims=[1]), "judge_failed"), (score(unsupported_claims="none"), "judge_failed"), (score(extra=1), "judge_failed"),
        (score(clarity="drop"), "judge_failed"), ("[]", "judge_failed"), ("```json```", "judge_failed"), (None, "judge_failed"), (score(relevance=True), "judge_failed"),
    ],
)
def test_judge_replies(spark, raw, status):
    row = E.validate_judge(spark.createDataFrame([(raw,)], "raw_response string")).first()
    assert row["judge_status"] == status and row["raw_response"] == raw


def test_judge_means(spark):
    rows = [("x", score(groundedness=2, numerical_accuracy=4, relevance=3, clarity=5, overall=3.0)), ("x", score(groundedness=4, numerical_accuracy=2, relevance=5, clarity=3, overall=4.0)), ("x", "bad"), (None, score())]
    means = {r["model"]: r for r in E.judge_means(E.validate_judge(spark.createDataFrame(rows, "model string, raw_response string"))).collect()}
    assert [means["x"][f] for f in ("judge_rows", "groundedness", "numerical_accuracy", "relevance", "clarity", "overall")] == [2, 3.0, 3.0, 4.0, 4.0, 3.5]
    assert means["unknown"]["judge_rows"] == 1


def test_token_overlap(spark):
    row = spark.range(1).select(E.token_overlap(F.lit("Net income, net!"), F.lit("income was high")).alias("m")).first()["m"]
    assert tuple(row) == (0.5, 0.33, 0.4)
