import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgermill.functions import jsonvals as J
from ledgermill.functions import numbers as N
from ledgermill.functions import text as T


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("Revenue: 2.5 million", ["revenue", "2500000", "2500000"]),
        ("22,000,000 SAR", ["22", "000", "000", "sar", "22", "000", "000"]),
        ("1.2345k and 2 bn", ["1234", "5", "and", "2000000000", "1234", "5", "2000000000"]),
        ("1.001k", ["1001", "1001"]),  # 1000.9999999999999 in doubles
        ("1.2345678 million", ["1", "23457e", "06", "1", "06"]),  # short form 1.23457e+06
        ("x5m 5mé", ["x5m", "5mé"]),
        ("ابريل ٢٠٢٤ جداً", ["ابريل", "2024", "جدا", "2024"]),
        ("", []),
    ],
)
def test_tokenize(one, text, tokens):
    assert one(T.tokenize, text) == tokens


@pytest.mark.parametrize(
    "raw, token",
    [
        ("22 million", "num_22000000"), ("22,000,000", "num_22000000"), ("(1,250.50)", "num_neg1250p5"),
        ("-3%", "pct_neg3"), ("7 percent", "pct_7"), ("0.5k", "num_500"), ("1.2345 m", "num_1234500"),
        ("000.10", "num_0p1"), ("123456789012345678901234567890.5bn", "num_123456789012345678901234567890500000000"),
    ],
)
def test_canonical_number(one, raw, token):
    assert one(N.canonical_number, raw) == token


def test_equal_items_have_one_key(one):
    assert one(N.normalize_item, "cash flow: SAR 22 million") == one(N.normalize_item, "cash flow: 22,000,000 SAR")
    assert one(N.normalize_item, "no colon 5%") == "colon no pct_5"


def test_extract_items(one):
    text = "**Facts**\n- Revenue was 100m SAR.\n- Cash flow was 22,000,000 SAR.\nNo numeric detail here."
    assert one(N.extract_items, text) == ["Revenue was 100m SAR.", "Cash flow was 22,000,000 SAR."]
    long = "word " * 60 + "5"
    assert one(N.extract_items, "7 " + long) == [("7 " + long)[:240].rsplit(" ", 1)[0].strip()]


def test_scale_denominators_are_no_figures(one):
    assert one(N.material_numbers, "3.71 من 4 مع 100%") == ["num_3p71", "pct_100"]
    assert one(N.material_numbers, "4 out of 5, 3/4 and 2/7") == ["num_4", "num_3", "num_2", "num_7"]


def test_item_sets_of_json(spark):
    entry = '{"a": ["x", {"k": 1, "n": null}, ["5 y | 6 z"], null], "r": null, "t": "- 5 a\\n- b"}'
    frame = spark.createDataFrame([(entry,), ("[1]",), ("nope",)], "j string").select(J.parse_object(F.col("j")).alias("m"))
    rows = frame.select(
        J.item_set(J.field_by_alias(F.col("m"), None, ("q", "a"))).alias("a"),
        J.item_set(J.field_by_alias(F.col("m"), None, ("r", "a"))).alias("r"),
        J.item_set(J.field_by_alias(F.col("m"), "t", ())).alias("t"),
        J.has_field(F.col("m"), None, ("q", "r")).alias("has"),
    ).collect()
    assert rows[0]["a"] == ["x", "k: 1", "n: None", "5 y", "6 z"]
    assert rows[0]["r"] == [] and rows[0]["has"]  # a present null wins over later names
    assert rows[0]["t"] == ["5 a"]
    assert rows[1]["has"] is None and rows[2]["has"] is None


@pytest.mark.parametrize(
    "label, expected",
    [("Q3", True), ("FY 24", True), ("2024 plan", True), ("5/12", True), ("مارس", True), ("Qualified", False), ("12345", False)],
)
def test_time_labels(one, label, expected):
    assert one(T.is_time_label, label) is expected


def test_answer_texts(one):
    assert one(T.strip_answer, 'A “b”\n\n\n\n```json\n{"a": 1}\n```') == 'A "b"'
    assert one(T.strip_answer, "```x```") == "```x```"
    assert one(T.strip_legacy_notes, "ok\n---\n**Note:** use appropriate caution.") == "ok"
    assert one(T.redact_models, "GPT-oss 20b vs claude, claudette") == "[redacted-model] vs [redacted-model], claudette"
    assert one(T.answer_language, "ما هو ROI") == "Arabic"
    assert one(T.answer_language, "what is صافي") == "English"
    assert one(T.answer_has_no_data, "There is No Data here") is True


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abc 12.,kmb%-()\n|:", max_size=40), min_size=1, max_size=20))
def test_normalizing_is_stable_and_order_free(spark, texts):
    """Word order after the colon never changes a key."""
    rows = [(" ".join(["x:", *t.split()]), " ".join(["x:", *t.split()])) for t in texts]
    frame = spark.createDataFrame(rows, "a string, b string")
    assert frame.filter(N.normalize_item(F.col("a")) != N.normalize_item(F.col("b"))).isEmpty()


def test_lists_inside_lists_at_any_depth(spark):
    import json
    import random

    from ledgermill.functions import jsonvals as J

    rng = random.Random(3)

    def build(depth):
        if depth == 0:
            return rng.choice([None, "a", "b [1", 'q"]', 7, True, {"k": [1, [2]]}, "c\\"])
        return [build(depth - 1) if i == 0 else build(rng.randrange(min(depth, 3))) for i in range(rng.randrange(1, 4))]

    def flat(v):
        if isinstance(v, list):
            return [x for e in v for x in flat(e)]
        return [] if v is None else [v]

    values = [build(d) for d in (0, 1, 2, 5, 9, 17, 40, 120)] + [[], [[]], [[], [None]], "[[[", None]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, v string")
    found = {r["i"]: r["x"] for r in rows.selectExpr("i", "try_parse_json(v) as v").select("i", J.leaves(F.col("v")).alias("x")).select(
        "i", F.transform("x", lambda e: F.to_json(e)).alias("x")).collect()}
    for i, v in enumerate(values):
        assert [json.loads(x) for x in found[i]] == flat(v), v
