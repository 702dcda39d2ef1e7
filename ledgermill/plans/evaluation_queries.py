"""Queries that score answers against references and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import evaluation as E
from . import duck as Q
from .answer_queries import pick, pick_sql
from .registry import query

METRICS = ["precision", "recall", "f1_score", "accuracy"]


def item_pairs(t):
    """Line items of an order as retrieved and relevant items.

    Retrieved items carry the price in one spelling, relevant ones in another;
    some lines are on one side only.
    """
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    label = F.concat(F.lit("line "), (F.col("l_partkey") % 3).cast("string"), F.lit(" price: "))
    flag = F.col("l_returnflag")
    retrieved = F.when(flag != "N", F.concat(label, F.format_number(price, 2), F.lit(" SAR")))
    relevant = F.when(
        flag != "R", F.concat(F.when(F.col("l_tax") < 0.04, F.upper(label)).otherwise(label), F.when(F.col("l_tax") < 0.06, F.lit("SAR ")).otherwise(F.lit("")),
                              F.when(F.col("l_tax") < 0.06, price.cast("string")).otherwise(F.concat(F.format_number(price, 2), F.lit(" SAR"))))
    )
    sides = F.array(
        F.struct(F.lit("retrieved").alias("side"), retrieved.alias("item")),
        F.struct(F.lit("relevant").alias("side"), relevant.alias("item")),
    )
    return t.spread("lineitem").select(F.col("l_orderkey").alias("entry_id"), F.inline(sides)).filter(
        F.col("item").isNotNull()
    )


ITEM_PAIRS = """
    l AS (SELECT l_orderkey AS entry_id, 'line ' || (l_partkey % 3) || ' price: ' AS label, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
        l_returnflag AS flag, l_tax FROM lineitem),
    m AS (SELECT entry_id, 'retrieved' AS side, label || format('{:,.2f}', CAST(price AS DOUBLE)) || ' SAR' AS item,
          trim(replace(label, ':', '')) AS lk, price FROM l WHERE flag <> 'N'
      UNION ALL SELECT entry_id, 'relevant', CASE WHEN l_tax < 0.04 THEN upper(label) ELSE label END
        || CASE WHEN l_tax < 0.06 THEN 'SAR ' || price ELSE format('{:,.2f}', CAST(price AS DOUBLE)) || ' SAR' END,
          trim(replace(label, ':', '')), price FROM l WHERE flag <> 'R'),
    k AS (SELECT *, lk || ': num_' || replace(regexp_replace(regexp_replace(CAST(price AS VARCHAR), '0+$', ''), '\\.$', ''), '.', 'p') || ' sar' AS key FROM m),
    o AS (SELECT entry_id, key, min(item) FILTER (side = 'retrieved') AS retrieved_item, min(item) FILTER (side = 'relevant') AS relevant_item,
        CASE WHEN count(*) FILTER (side = 'retrieved') = 0 THEN 'FN' WHEN count(*) FILTER (side = 'relevant') = 0 THEN 'FP' ELSE 'TP' END AS outcome
      FROM k GROUP BY entry_id, key)
"""


@query("match_items", f"WITH {ITEM_PAIRS} SELECT entry_id, key, retrieved_item, relevant_item, outcome FROM o")
def match_items(t):
    return E.match_items(item_pairs(t))


def rounded(df, digits=9):
    return df.withColumns({m: F.round(m, digits) for m in METRICS if m in df.columns})


@query(
    "evaluate_batch",
    f"""WITH {ITEM_PAIRS},
    e AS (SELECT o_orderkey AS entry_id, count(outcome) FILTER (outcome = 'TP') AS tp, count(outcome) FILTER (outcome = 'FP') AS fp,
        count(outcome) FILTER (outcome = 'FN') AS fn FROM orders LEFT JOIN o ON o.entry_id = o_orderkey GROUP BY o_orderkey),
    c AS (SELECT entry_id, tp, fp, fn, false AS is_total, 1 AS n_entries FROM e
      UNION ALL SELECT NULL, sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, true, count(*) FROM e),
    p AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r FROM c)
    SELECT entry_id, tp, fp, fn, is_total, n_entries::BIGINT AS n_entries, round(p, 9) AS precision, round(r, 9) AS recall,
      round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1_score,
      round(coalesce(tp::DOUBLE / nullif(tp + fp + fn, 0), 0), 9) AS accuracy FROM p""",
)
def evaluate_batch(t):
    entries = t.orders.select(F.col("o_orderkey").alias("entry_id"))
    return rounded(E.evaluate(item_pairs(t), entries))


@query(
    "categorized_errors",
    f"""WITH {ITEM_PAIRS} SELECT entry_id, CASE outcome WHEN 'TP' THEN 'matching/normalization'
        WHEN 'FP' THEN 'retrieval/extraction false positive' ELSE 'retrieval/chunking false negative' END AS category, key,
      coalesce(retrieved_item, '') AS retrieved_item, coalesce(relevant_item, '') AS relevant_item
    FROM o WHERE outcome <> 'TP' OR retrieved_item <> relevant_item""",
)
def categorized_errors(t):
    return E.categorized_errors(item_pairs(t))


@query(
    "error_analysis",
    f"""WITH {ITEM_PAIRS},
    x AS (SELECT entry_id, item, bool_or(side = 'retrieved') AS r, bool_or(side = 'relevant') AS v FROM k GROUP BY ALL),
    xe AS (SELECT entry_id, count(*) FILTER (r AND NOT v) AS exact_fp, count(*) FILTER (v AND NOT r) AS exact_fn FROM x GROUP BY entry_id),
    ne AS (SELECT entry_id, count(*) FILTER (outcome = 'FP') AS normalized_fp, count(*) FILTER (outcome = 'FN') AS normalized_fn FROM o GROUP BY entry_id)
    SELECT *, CASE WHEN exact_fp = 0 AND exact_fn = 0 THEN 'no_error' WHEN normalized_fp = 0 AND normalized_fn = 0
      THEN 'matching/normalization' ELSE 'retrieval_or_extraction' END AS likely_cause FROM xe JOIN ne USING (entry_id)""",
)
def error_analysis(t):
    return E.error_analysis(item_pairs(t))


@query(
    "exact_errors",
    f"""WITH {ITEM_PAIRS},
    x AS (SELECT entry_id, item, bool_or(side = 'retrieved') AS r, bool_or(side = 'relevant') AS v FROM k GROUP BY ALL)
    SELECT entry_id, CASE WHEN r THEN 'FP' ELSE 'FN' END AS outcome, item FROM x WHERE NOT (r AND v)""",
)
def exact_errors(t):
    return E.exact_errors(item_pairs(t))


@query(
    "dedupe_items",
    f"""WITH {ITEM_PAIRS} SELECT entry_id, key, arg_min(item, (length(item), item)) AS item FROM k GROUP BY entry_id, key""",
)
def dedupe_items(t):
    return E.dedupe_items(item_pairs(t))


@query(
    "rank_items",
    f"""WITH {ITEM_PAIRS} SELECT entry_id, side, item, row_number() OVER (PARTITION BY entry_id, side ORDER BY item) AS rank
      FROM (SELECT DISTINCT entry_id, side, item FROM k)""",
)
def rank_items(t):
    return E.rank_items(item_pairs(t).distinct())


@query(
    "token_overlap",
    f"""
    WITH t AS (SELECT a.conv_id, a.turn, list_distinct({Q.words(f"regexp_replace(lower({Q.plain('a.text')}), '[^{Q.W}\\s]', ' ', 'g')")}) AS aw,
        list_distinct({Q.words(f"regexp_replace(lower({Q.plain('u.text')}), '[^{Q.W}\\s]', ' ', 'g')")}) AS uw
      FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant'),
    h AS (SELECT conv_id, turn, len(list_intersect(aw, uw))::DOUBLE AS hits, len(aw) AS na, len(uw) AS nu FROM t),
    m AS (SELECT conv_id, turn, coalesce(hits / nullif(na, 0), 0) AS p, coalesce(hits / nullif(nu, 0), 0) AS r FROM h)
    SELECT conv_id, turn, round_even((p)::DECIMAL(30,15), 2)::DOUBLE AS token_precision, round_even((r)::DECIMAL(30,15), 2)::DOUBLE AS token_recall,
      round_even((coalesce(2 * p * r / nullif(p + r, 0), 0))::DECIMAL(30,15), 2)::DOUBLE AS token_f1 FROM m
    """,
)
def token_overlap(t):
    c = t.conversations
    answers = c.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("generated_answer")
    )
    asked = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return answers.join(asked, ["conv_id", "turn"]).select(
        "conv_id", "turn",
        E.token_overlap(F.col("generated_answer"), F.col("reference")).alias("m"),
    ).select("conv_id", "turn", "m.*")


def evaluation_records(t):
    """Records whose target is a reference, a list of contexts or a list of chunks."""
    c, kind = t.conversations, F.pmod("turn", F.lit(3))
    words = F.split("text", " ")
    return c.select(
        "conv_id", "turn", F.concat(F.lit("Did GPT-oss say: "), "text").alias("question"),
        F.concat_ws(" ", F.slice(F.array_sort(words), 1, 6)).alias("generated_answer"),
        F.when(kind == 0, F.col("text")).alias("reference_answer"),
        F.when(kind == 1, words).alias("retrieved_context"),
        F.when(kind == 2, F.array("text", F.lit("claude"))).alias("source_chunks"),
    )


RECORDS = f"""
    r AS (SELECT conv_id, turn, 'Did GPT-oss say: ' || text AS question,
      array_to_string(list_sort(string_split(text, ' '))[1:6], ' ') AS answer,
      CASE WHEN turn % 3 = 2 THEN text || ' claude' ELSE text END AS target,
      CASE WHEN turn % 3 = 2 THEN '[Chunk 1]' || chr(10) || text || chr(10) || chr(10) || '[Chunk 2]' || chr(10) || 'claude' ELSE '' END AS chunks
    FROM conversations)
"""


def _clean_set(c: str) -> str:
    return f"""list_distinct({Q.words(f"regexp_replace(lower({Q.plain(c)}), '[^{Q.W}\\s]', ' ', 'g')")})"""


def _redacted(c: str) -> str:
    return f"""regexp_replace({c}, '(?i)(^|[^{Q.W}])(?:{C.MODEL_NAMES_PATTERN})($|[^{Q.W}])', '\\1{C.REDACTED_MODEL}\\2', 'g')"""


@query(
    "overlap_records",
    f"""WITH {RECORDS}, s AS (SELECT conv_id, turn, {_clean_set('answer')} AS aw, {_clean_set('target')} AS uw FROM r),
    m AS (SELECT conv_id, turn, coalesce(len(list_intersect(aw, uw))::DOUBLE / nullif(len(aw), 0), 0) AS p,
      coalesce(len(list_intersect(aw, uw))::DOUBLE / nullif(len(uw), 0), 0) AS r FROM s)
    SELECT conv_id, turn, round_even(p::DECIMAL(30,15), 2)::DOUBLE AS token_precision, round_even(r::DECIMAL(30,15), 2)::DOUBLE AS token_recall,
      round_even(coalesce(2 * p * r / nullif(p + r, 0), 0)::DECIMAL(30,15), 2)::DOUBLE AS token_f1 FROM m""",
)
def overlap_records(t):
    """Overlap of answers with whichever target their record has."""
    records = evaluation_records(t)
    overlap = E.token_overlap(F.col("generated_answer"), E.overlap_target(records))
    return records.select("conv_id", "turn", overlap.alias("m")).select("conv_id", "turn", "m.*")


@query(
    "judge_texts",
    f"""WITH {RECORDS} SELECT conv_id, turn, {_redacted('question')} AS question_text, {_redacted('chunks')} AS source_text,
      {_redacted('answer')} AS answer_text FROM r""",
)
def judge_texts(t):
    """What a judge reads of each record."""
    return E.judge_texts(evaluation_records(t)).select("conv_id", "turn", "question_text", "source_text", "answer_text")


# judge replies -------------------------------------------------------------------

def judge_replies(t):
    """One reply per order; every ninth is broken in one of four ways."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    score = lambda n: (F.pmod(cust + n, F.lit(5)) + 1).cast("string")
    overall = F.concat(score(4), F.when(key % 2 == 0, F.lit(".5")).otherwise(F.lit("")))
    bad = key % 9
    reply = F.concat(
        F.lit('{"groundedness": '), F.when(bad == 1, F.lit("2.5")).when(bad == 2, F.lit("7")).otherwise(score(0)),
        F.lit(', "numerical_accuracy": '), score(1), F.lit(', "relevance": '), score(2),
        F.when(bad == 3, F.lit("")).otherwise(F.concat(F.lit(', "clarity": '), score(3))),
        F.lit(', "overall": '), overall, F.lit(', "unsupported_claims": '),
        F.when(bad == 4, F.lit('"none"')).when(key % 2 == 0, F.lit("[]")).otherwise(F.lit('["claim"]')),
        F.lit(', "rationale": "'), "o_orderpriority", F.when(bad == 5, F.lit("")).otherwise(F.lit('"}')),
    )
    model = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("candidate "), "o_orderstatus"))
    return t.spread("orders").select(key.alias("record_id"), model.alias("model"), reply.alias("raw_response"))


JUDGED = """
    j AS (SELECT o_orderkey AS record_id, CASE WHEN o_orderstatus <> 'P' THEN 'candidate ' || o_orderstatus END AS model,
        o_custkey % 5 + 1 AS g, (o_custkey + 1) % 5 + 1 AS n, (o_custkey + 2) % 5 + 1 AS r, (o_custkey + 3) % 5 + 1 AS c,
        (o_custkey + 4) % 5 + 1 + CASE WHEN o_orderkey % 2 = 0 THEN 0.5::DOUBLE ELSE 0 END AS o,
        o_orderkey % 9 NOT IN (1, 2, 3, 4, 5) AND (o_custkey + 4) % 5 + 1 + CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0 END <= 5 AS ok,
        o_orderpriority AS why, o_orderkey % 2 AS odd FROM orders)
"""


@query(
    "validate_judge",
    f"""WITH {JUDGED} SELECT record_id, model, CASE WHEN ok THEN 'ok' ELSE 'judge_failed' END AS judge_status, CASE WHEN ok THEN g END AS groundedness,
      CASE WHEN ok THEN n END AS numerical_accuracy, CASE WHEN ok THEN r END AS relevance, CASE WHEN ok THEN c END AS clarity,
      CASE WHEN ok THEN o END AS overall, CASE WHEN ok THEN CASE odd WHEN 0 THEN '' ELSE 'claim' END END AS unsupported_claims,
      CASE WHEN ok THEN why END AS rationale FROM j""",
)
def validate_judge(t):
    return E.validate_judge(judge_replies(t)).drop("raw_response").withColumn(
        "unsupported_claims", F.array_join("unsupported_claims", ";")
    )


@query(
    "judge_means",
    f"""WITH {JUDGED} SELECT coalesce(model, 'unknown') AS model, count(*) AS judge_rows,
      {', '.join(f'round_even((avg({c}::DOUBLE))::DECIMAL(30,15), 3)::DOUBLE AS {n}' for c, n in zip('gnrco', C.JUDGE_MEAN_FIELDS))}
      FROM j WHERE ok GROUP BY 1""",
)
def judge_means(t):
    return E.judge_means(E.validate_judge(judge_replies(t)))


# grounding -----------------------------------------------------------------------

ANSWERS = (
    "- Order total price was {a} SAR.\n- Discount budget reached 12.5%.",
    "Total price {a} SAR with customer number {c} of 4/5",
    "* Priority is high and no figures are known",
    "1. Order total price {a} SAR 2. Penalty was {b} SAR",
    "no relevant documents for 2024",
    "- Customer {c} owes {a} SAR\n- Unrelated shipping weight {a}",
)
SOURCES = (
    "[Source: orders.csv | Row {k}]\nTotal price: {a} SAR | Customer: {c}",
    "[Source: notes.pdf p.2]\nDiscount budget 12.5% agreed | Penalty: {b} SAR",
    "plain note",
)
ASKS = ("What is the total price?", "Which discount applies?", "", "weather forecast tomorrow")


def _filled(pattern, values):
    text = F.lit(pattern) if isinstance(pattern, str) else pattern
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def chat_log(t):
    """One chat entry per order, as JSON. The key decides the wording, whether
    the reference side is given, repeats the sources, or is missing."""
    key = F.col("o_orderkey")
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    values = {
        "a": F.when(key % 2 == 0, F.format_number(amount, 2)).otherwise(amount.cast("string")),
        "b": (F.col("o_custkey") % 90 + 10).cast("string"), "c": F.col("o_custkey").cast("string"),
        "k": key.cast("string"),
    }
    answer = _filled(pick(ANSWERS, key), values)
    # a seventh of the sources state another total
    told = dict(values, a=F.when(key % 7 == 0, F.lit("999.99")).otherwise(values["a"]))
    sources = F.array(*[_filled(s, told) for s in SOURCES])
    entry = F.struct(
        pick(ASKS, key).alias("question"), answer.alias("answer"),
        F.when(key % 10 == 3, F.array(F.lit("total price: 5m SAR"), F.lit("owner: none"))).alias("expected_items"),
        F.when(key % 10 == 4, sources).alias("relevant"),
        F.when(key % 10 != 5, sources).alias("source_texts"),
    )
    body = F.to_json(entry)
    return t.spread("orders").select(
        key.alias("entry_id"), F.when(key % 50 == 49, F.lit("not json")).otherwise(body).alias("entry_json"),
    )


def _fill_sql(pattern, told=False):
    amount = "CASE WHEN o_orderkey % 2 = 0 THEN format('{:,.2f}', o_totalprice) ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END"
    if told:
        amount = f"CASE WHEN o_orderkey % 7 = 0 THEN '999.99' ELSE {amount} END"
    text = Q.quote(pattern)
    for name, value in {"a": amount, "b": "CAST(o_custkey % 90 + 10 AS VARCHAR)", "c": "CAST(o_custkey AS VARCHAR)", "k": "CAST(o_orderkey AS VARCHAR)"}.items():
        text = f"replace({text}, {Q.quote('{' + name + '}')}, {value})"
    return text


def _blob(c):
    return (
        f"CASE WHEN length({c}) > 80 OR contains({c}, chr(10)) OR contains({c}, '|') OR contains({c}, '  ') OR regexp_matches({c}, '^[-*•]')"
        f" THEN CASE WHEN len({Q.items(c)}) > 0 THEN {Q.items(c)} ELSE [{c}] END ELSE [{c}] END"
    )


GROUNDED = f"""
    en AS (SELECT o_orderkey AS entry_id, {pick_sql(ASKS, 'o_orderkey')} AS question,
        CASE o_orderkey % {len(ANSWERS)} {' '.join(f'WHEN {i} THEN {_fill_sql(a)}' for i, a in enumerate(ANSWERS))} END AS answer,
        [{', '.join(_fill_sql(s, True) for s in SOURCES)}] AS sources FROM orders WHERE o_orderkey % 50 <> 49 AND o_orderkey % 10 NOT IN (3, 5)),
    its AS MATERIALIZED (SELECT entry_id, question, unnest({_blob('answer')}) AS item FROM en),
    src AS (SELECT entry_id, unnest(sources) AS s FROM en),
    sit AS MATERIALIZED (SELECT DISTINCT entry_id, unnest({_blob('s')}) AS s FROM src),
    di AS MATERIALIZED (SELECT entry_id, question, item, {Q.material('item')} AS nums, {Q.meaningful('item')} AS wrds, {Q.meaningful('question')} AS qw,
        {Q.figures_of(Q.prepare('item'))} AS pnums, {Q.word_list('item')} AS pw, {Q.any_of('lower(item)', C.NO_DATA_ITEM_PHRASES)} AS nodata FROM its),
    ds AS MATERIALIZED (SELECT entry_id, s, {Q.material('s')} AS nums, {Q.meaningful('s')} AS wrds, {Q.figures_of(Q.prepare('s'))} AS pnums, {Q.word_list('s')} AS pw FROM sit),
    pr AS (SELECT di.entry_id, di.item, ds.s, len(list_intersect(di.nums, ds.nums))::DOUBLE / len(di.nums) AS nov,
        CASE WHEN len(di.wrds) > 0 THEN len(list_intersect(di.wrds, ds.wrds))::DOUBLE / len(di.wrds) ELSE 0 END AS wov, ds.wrds AS sw
      FROM di JOIN ds USING (entry_id) WHERE len(di.nums) > 0 AND len(ds.nums) > 0),
    be AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY entry_id, item ORDER BY nov DESC, wov DESC, length(s) DESC, s DESC) = 1),
    al AS (SELECT entry_id, flatten(list(nums)) AS every FROM ds GROUP BY entry_id),
    sc AS (SELECT di.*, coalesce(nov, 0) AS nov, coalesce(wov, 0) AS wov, coalesce(be.s, '') AS best, coalesce(sw, []) AS sw,
        list_has_all(every, nums) AS covered, list_distinct(list_concat(wrds, coalesce(sw, []))) AS cand
      FROM di LEFT JOIN be USING (entry_id, item) JOIN al USING (entry_id)),
    qs AS (SELECT *, CASE WHEN len(qw) = 0 THEN 1.0 ELSE round_even((least(len(list_intersect(qw, cand))::DOUBLE / least(len(qw), 4), 1.0))::DECIMAL(30,15), 3)::DOUBLE END AS asked,
        round_even(((0.75 * nov + 0.25 * least(wov * 2, 1.0)))::DECIMAL(30,15), 3)::DOUBLE AS support, nodata OR len(nums) = 0 AS nothing FROM sc),
    de AS (SELECT *, CASE WHEN nothing THEN 'non_financial_or_no_data_response' WHEN nov < 1 AND covered THEN 'cross_row_or_blended_figure'
        WHEN nov < 1 THEN 'ungrounded_or_hallucinated_figure'
        WHEN len(wrds) > 0 AND len(sw) > 0 AND len(list_intersect(wrds, sw)) = 0 THEN 'wrong_label_or_neighboring_row'
        WHEN trim(question) <> '' AND asked <= 0 THEN 'query_intent_mismatch' ELSE 'grounded_relevant_item' END AS category FROM qs),
    su AS (SELECT DISTINCT di.entry_id, di.item FROM di JOIN ds USING (entry_id) WHERE len(di.pnums) > 0 AND list_has_all(ds.pnums, di.pnums)
      AND (list_has_any(di.pw, ds.pw) OR len(di.pnums) >= 2))
"""


@query(
    "grounding_decisions",
    f"""WITH {GROUNDED} SELECT entry_id, item, category, category = 'grounded_relevant_item' AS accepted,
      CASE WHEN nothing THEN '' ELSE best END AS source_chunk, CASE WHEN nothing THEN 0.0::DOUBLE ELSE support END AS support_score,
      CASE WHEN category IN ('grounded_relevant_item', 'query_intent_mismatch') THEN asked ELSE 0.0::DOUBLE END AS query_score FROM de""",
)
def grounding_decisions(t):
    records = E.parsed_entries(chat_log(t)).filter(~F.col("is_explicit"))
    return records.select(
        "entry_id",
        F.inline(E.grounding_decisions(F.col("original_retrieved"), F.col("source_items"), F.col("question"))),
    )


EXPLICIT = f"""
    xe AS (SELECT o_orderkey AS entry_id, CASE o_orderkey % {len(ANSWERS)} {' '.join(f'WHEN {i} THEN {_fill_sql(a)}' for i, a in enumerate(ANSWERS))} END AS answer
      FROM orders WHERE o_orderkey % 50 <> 49 AND o_orderkey % 10 = 3),
    xi AS (SELECT entry_id, unnest({_blob('answer')}) AS item FROM xe)
"""


@query(
    "history_records",
    f"""WITH {GROUNDED}, {EXPLICIT},
    rows AS (SELECT entry_id, 'relevant' AS side, item FROM su UNION ALL SELECT entry_id, 'retrieved', item FROM de WHERE category = 'grounded_relevant_item'
      UNION ALL SELECT entry_id, 'retrieved', item FROM xi
      UNION ALL SELECT entry_id, 'relevant', unnest(['total price: 5m SAR', 'owner: none']) FROM xe)
    SELECT DISTINCT entry_id, side, item FROM rows""",
)
def history_records(t):
    return E.record_items(E.history_records(chat_log(t)))


@query(
    "evaluate_history",
    f"""WITH {GROUNDED}, {EXPLICIT},
    e AS (SELECT entry_id, count(*) FILTER (r AND v) AS tp, count(*) FILTER (r AND NOT v) AS fp, count(*) FILTER (v AND NOT r) AS fn FROM (
        SELECT di.entry_id, di.item, de.category = 'grounded_relevant_item' AS r, su.item IS NOT NULL AS v FROM di
          JOIN de ON de.entry_id = di.entry_id AND de.item = di.item LEFT JOIN su ON su.entry_id = di.entry_id AND su.item = di.item
        UNION ALL SELECT entry_id, item, true, false FROM xi UNION ALL SELECT entry_id, 'a', false, true FROM xe UNION ALL SELECT entry_id, 'b', false, true FROM xe) GROUP BY entry_id),
    c AS (SELECT entry_id, tp, fp, fn, false AS is_total, 1::BIGINT AS n_entries FROM e UNION ALL SELECT NULL, sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, true, count(*) FROM e),
    p AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r FROM c)
    SELECT entry_id, tp, fp, fn, is_total, n_entries, round(p, 9) AS precision, round(r, 9) AS recall,
      round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1_score, round(coalesce(tp::DOUBLE / nullif(tp + fp + fn, 0), 0), 9) AS accuracy FROM p""",
)
def evaluate_history(t):
    return rounded(E.evaluate_history(chat_log(t)))


FALSE_POSITIVES = f"""{GROUNDED}, {EXPLICIT},
    fp AS (SELECT entry_id, question, row_number() OVER (PARTITION BY entry_id ORDER BY item) AS rank, item,
        CASE WHEN category = 'grounded_relevant_item' THEN 'normalization_or_support_context_mismatch' ELSE category END AS category,
        CASE WHEN nothing THEN '' ELSE best END AS source_chunk, CASE WHEN nothing THEN 0.0::DOUBLE ELSE support END AS support_score,
        CASE WHEN category IN ('grounded_relevant_item', 'query_intent_mismatch') THEN asked ELSE 0.0::DOUBLE END AS query_score FROM de),
    xf AS (SELECT entry_id, list_extract({Q.sql_list(ASKS)}, entry_id % 4 + 1) AS question, row_number() OVER (PARTITION BY entry_id ORDER BY item) AS rank, item,
        'normalization_or_support_context_mismatch' AS category, '' AS source_chunk, 0.0::DOUBLE AS support_score, 0.0::DOUBLE AS query_score FROM xi),
    bad AS (SELECT entry_id, question, rank, category, item AS retrieved_item, source_chunk, support_score, query_score FROM fp
        ANTI JOIN su USING (entry_id, item) UNION ALL SELECT entry_id, question, rank, category, item, source_chunk, support_score, query_score FROM xf)
"""


@query("false_positives", f"WITH {FALSE_POSITIVES} SELECT * FROM bad")
def false_positives(t):
    return E.false_positives(chat_log(t))


@query(
    "false_positive_report",
    f"WITH {FALSE_POSITIVES} SELECT category, count(*) AS n_items FROM bad GROUP BY ROLLUP (category)",
)
def false_positive_report(t):
    return E.false_positive_report(chat_log(t))


@query(
    "jsonl_pairs",
    """
    SELECT o_orderkey AS entry_id, 'x: ' || o_orderkey || '; y' AS retrieved,
      CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS relevant FROM orders WHERE o_orderkey % 4 <> 0
    """,
)
def jsonl_pairs(t):
    """Records with both sides; a null reference counts as an empty side."""
    key = F.col("o_orderkey")
    text = F.concat(
        F.lit('{"extracted_items": [{"x": '), key.cast("string"), F.lit('}, "y"]'),
        F.when(key % 4 == 0, F.lit("")).when(key % 3 == 0, F.lit(', "relevant": null, "reference": "z"'))
        .otherwise(F.concat(F.lit(', "expected": "'), "o_orderpriority", F.lit('"'))), F.lit("}"),
    )
    pairs = E.jsonl_pairs(t.orders.select(key.alias("entry_id"), text.alias("entry_json")))
    return pairs.select(
        "entry_id", F.array_join("retrieved", "; ").alias("retrieved"), F.array_join("relevant", "; ").alias("relevant")
    )


