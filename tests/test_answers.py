import pytest
from pyspark.sql import functions as F

from ledgermill.operators import charts as H
from ledgermill.operators import routing as P
from ledgermill.operators import verify as V


@pytest.mark.parametrize(
    "claimed, actual, conflict",
    [("bank statement", "test_1_bank_statement.csv", False), ("bank statement", "test_1_ledger.csv", True), ("", "x.csv", False), ("the budget file", "q_budget.xlsx", False), ("Ledger.CSV", "ledger.csv", False), ("my ledger book", "2024 ledger.csv", False), ("invoices", "budget.xlsx", True)],
)
def test_source_names(spark, claimed, actual, conflict):
    assert spark.range(1).select(V.sources_conflict(F.lit(claimed), F.lit(actual)).alias("v")).first()["v"] is conflict


def test_unverified_lines_are_dropped(spark):
    answers = spark.createDataFrame([(1, "Open pipeline is 165,000 SAR.\nDEAL-206 duplicate is 25,000 SAR."), (2, "kept 25,000"), (3, "only 7")], "answer_id long, answer string")
    checks = spark.createDataFrame([(1, 1, "25,000", "NOT_FOUND_IN_SOURCES"), (2, 1, "25,000", "row"), (3, 1, "7", " not_found_in_sources")], "answer_id long, pos int, number_in_answer string, row_label_in_source string")
    got = {r["answer_id"]: r["answer"] for r in V.remove_unverified_numbers(answers, checks).collect()}
    assert got == {
        1: "Open pipeline is 165,000 SAR.\n\nThe figure 25,000 was not found in the provided data.", 2: "kept 25,000",
        3: "The figure 7 was not found in the provided data.",
    }


def test_best_attempt(spark):
    rows = [(1, 1, 6, False), (1, 2, 6, True), (2, 1, 9, False), (2, 2, 4, False), (3, 1, 2, True)]
    got = {r["answer_id"]: (r["attempt"], r["converged"], r["confidence"]) for r in V.best_attempt(spark.createDataFrame(rows, "answer_id long, attempt int, rating int, passed boolean")).collect()}
    assert got == {1: (1, True, "Medium"), 2: (1, False, "High"), 3: (1, True, "Low")}


@pytest.mark.parametrize(
    "text, chart",
    [("ابي رسم بياني يوضح لي نسبة التحسن", True), ("ما هي نسبة التحسن؟", False), ("ارسم لي مقارنة بين قيم الصفقات حسب المرحلة", True), ("visualization please", True), ("barely aligned", False), ("compare deal values across pipeline stages", False)],
)
def test_chart_words(one, text, chart):
    assert one(P.wants_chart, text) is chart


@pytest.mark.parametrize(
    "question, labels, chosen, expected",
    [
        ("ارسم مخططاً دائرياً لتوزيع المصروفات", ["a", "b", "c"], None, "pie"), ("ارسم مخططاً خطياً للتطور الشهري", ["Q1", "Q2", "Q3"], None, "line"),
        ("ارسم مخططاً مساحياً للتدفق النقدي", ["Q1", "Q2", "Q3"], None, "area"), ("ابي رسم بياني يوضح لي نسبة التحسن", ["Q1", "Q2"], "line", "bar"),
        ("الاتجاه خلال الأشهر الماضية", ["يناير", "فبراير", "مارس"], "line", "line"), ("show trend by customer segment", ["Enterprise", "SMB", "Strategic"], "line", "bar"),
        ("breakdown of expenses by category", [f"Category {i}" for i in range(15)], "pie", "bar"), ("breakdown of expenses by category", ["Payroll", "Rent", "Software", "Travel"], "pie", "pie"),
        ("compare deal values across pipeline stages", ["Prospecting", "Proposal", "Negotiation", "Closed Won"], "pie", "bar"), ("قارن قيم الصفقات حسب المرحلة", ["تأهيل", "عرض", "تفاوض", "مغلقة"], "pie", "bar"),
        ("plain", ["Q1", "Q2"], "radar", "bar"),
    ],
)
def test_chart_choice(spark, question, labels, chosen, expected):
    series = spark.createDataFrame([(1, l, 10.0 + i) for i, l in enumerate(labels)], "query_id long, label string, value double")
    shapes = H.chart_shape(series).withColumns({"text": F.lit(question), "chosen": F.lit(chosen)})
    assert H.recommend_chart(shapes, chosen="chosen" if chosen else None).first()["chart_type"] == expected


def test_improvement_rows(spark):
    texts = ["البُعد المقاس: معرفتي بمفهوم مواطن القوّة | الفرق: 1.95 | نسبة التحسّن: +120%", "البُعد المقاس: بداية استشعاري لمواهبي | الفرق: 1.17 | نسبة التحسّن: +55%", "المؤشر: الرضا العام | المعدّل (1-4): 3.57"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    assert [(r["value"], r["currency"]) for r in H.extract_improvements(docs).orderBy("doc_id").collect()] == [(120.0, "%"), (55.0, "%")]


def test_series_from_replies(spark):
    reply = '```json\n[{" Label ": "a", "value": "$1,200"}, {"name": "b", "amount": 3, "currency": "USD"}, {"label": "a", "value": 9}, {"label": "c", "value": "n/a"}, 5]\n```'
    reply = reply.replace(", 5]", "]")
    got = H.clean_series(spark.createDataFrame([(1, reply), (2, "no json")], "query_id long, reply string")).orderBy("pos").collect()
    assert [(r["label"], r["value"], r["currency"]) for r in got] == [("a", 1200.0, "SAR"), ("b", 3.0, "USD")]


def test_routing(spark):
    queries = spark.createDataFrame([(1, "reconcile ledger"), (2, "summarize the filing"), (3, "hello")], "query_id long, text string")
    hits = spark.createDataFrame([(2,), (2,)], "query_id long")
    mixed = spark.createDataFrame([("a.csv", True, True), ("b.pdf", False, False)], "source string, is_structured boolean, is_small boolean")
    actions = lambda sources: {r["query_id"]: r["action"] for r in P.route_queries(queries, sources, hits).collect()}
    assert actions(mixed) == {1: "ANSWER_FROM_FULL_TABLE", 2: "ANSWER_FROM_CONTEXT", 3: "REPORT_NOT_FOUND"}
    assert set(actions(mixed.filter("is_small")).values()) == {"ANSWER_FROM_FULL_TABLE"}
    assert actions(mixed.filter("not is_small")) == {1: "REPORT_NOT_FOUND", 2: "ANSWER_FROM_CONTEXT", 3: "REPORT_NOT_FOUND"}


def test_variants(spark):
    rows = [(1, 0, "Net Income?"), (1, 1, " net income? "), (1, 2, ""), (1, 3, "profit")]
    got = P.dedupe_variants(spark.createDataFrame(rows, "query_id long, pos int, text string")).orderBy("variant").collect()
    assert [(r["variant"], r["text"]) for r in got] == [(0, "Net Income?"), (1, "profit")]


def test_token_budget_by_sweep(spark):
    import random

    from ledgermill.operators.usage import token_budget

    rng = random.Random(8)
    # most calls of one model fall into one minute, many at one moment
    calls = [(k, rng.choice(["m", "m", "m", "n", None]), rng.choice([1000.0, 1000.25, 1060.0, 1060.000001, rng.uniform(900, 1200)]), rng.randrange(1, 90)) for k in range(400)]
    calls += [(400, "m", None, 5), (401, "m", None, 6), (402, "q", 7.0, 9000)]
    frame = spark.createDataFrame(calls, "call_id long, model string, at double, tokens long").selectExpr(
        "call_id", "model", "timestamp_micros(cast(round(at * 1000000) as bigint)) as ts", "tokens"
    )
    micros = [None if a is None else round(a * 10**6) for _, _, a, _ in calls]
    got = {r["call_id"]: (r["used_tokens"], r["over_budget"]) for r in token_budget(frame, 2000, segments=5).collect()}
    assert len(got) == len(calls)
    for (k, model, _, _), at in zip(calls, micros):
        window = [t for (_, m, _, t), a in zip(calls, micros) if m == model and (a == at if at is None or a is None else 0 <= at - a <= 60_000_000)]
        assert got[k] == (sum(window), sum(window) > 1800 and len(window) > 1), k
    assert token_budget(frame.limit(0)).count() == 0
