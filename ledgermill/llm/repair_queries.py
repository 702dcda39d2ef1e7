"""Damaged ``conversations`` and their repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ordering import null_safe_join
from ..session import cut_lineage
from .registry import query, table
from .sql import crc32
from .turn_repair import damaged, digests, edit_plans, repaired, turns


def _best(*candidates: str) -> str:
    return f"list_min(list_filter([{', '.join(candidates)}], lambda x: x IS NOT NULL))"


def _edit(state: str, cost: str, letter: str, line: str | None, when: str = "true") -> str:
    """A state's cost, letters and text after an edit."""
    text = f"{state}.t || CASE WHEN {state}.n > 0 THEN chr(10) ELSE '' END || {line}" if line else f"{state}.t"
    count = f"{state}.n + 1" if line else f"{state}.n"
    return (
        f"CASE WHEN {state} IS NOT NULL AND {when} THEN"
        f" {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'n': {count}, 't': {text}}} END"
    )


def _turn(prefix: str) -> str:
    """The four states behind a row."""
    ok = "fault <> 'f'"
    extra = "CASE WHEN fault = 't' THEN 3 ELSE 0 END"
    line = "role || ':' || text"
    keep = lambda s, i: _edit(f"{prefix}{s}", extra, "K", line, f"{ok} AND i = '{i}'")
    again = lambda s, role: _edit(f"{prefix}{s}", f"3 + {extra}", "R", f"'{role}:' || text", ok)
    drop = lambda s: _edit(f"{prefix}{s}", "4", "D", None)
    return ", ".join([
        f"{_best(drop(0))} AS q0", f"{_best(drop(1), keep(0, 's'))} AS q1",
        f"{_best(drop(2), *[f(s, x) for s in (0, 1, 3) for f, x in ((keep, 'u'), (again, 'user'))])} AS q2",
        f"{_best(drop(3), keep(2, 'a'), again(2, 'assistant'))} AS q3",
    ])


def _inserts(old: str, new: str) -> str:
    """The four states after one more inserted turn or none."""
    user = [_edit(f"{old}{s}", "3", "I", "'user:'") for s in (0, 1, 3)]
    return (
        f"{old}0 AS {new}0, {old}1 AS {new}1, {_best(f'{old}2', *user)} AS {new}2,"
        f" {_best(f'{old}3', _edit(f'{old}2', '3', 'I', chr(39) + 'assistant:' + chr(39)))} AS {new}3"
    )


OP12 = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
), k AS MATERIALIZED (SELECT *, {crc32("name")} % 20 AS kind FROM c
), d AS MATERIALIZED (
  SELECT coalesce(conv_id, -1) AS g, conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM k WHERE kind <> 0
), o AS MATERIALIZED (
  SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS i, sha256(text) AS h,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos
  FROM d
), f AS MATERIALIZED (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY g, role, h ORDER BY pos) > 1 AS again,
    lag(i) OVER (PARTITION BY g ORDER BY pos) || i NOT IN ('su', 'ua', 'au') AS wrong
  FROM o
), s AS MATERIALIZED (
  SELECT *, CASE WHEN blank OR again THEN 'f' WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'o' ELSE 't' END AS fault FROM f
), n AS (
  SELECT g, CASE WHEN count(turn) > 0 THEN max(turn) - min(turn) + 1 - count(DISTINCT turn) ELSE 0 END AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (wrong) AS illegal, max(pos) AS last
  FROM s GROUP BY g
), e AS (
  SELECT g, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': '', 'n': 0::BIGINT, 't': ''}} AS p0 FROM n
), b(g, pos, r0, r1, r2, r3) AS (
  SELECT g, pos, z0, z1, z2, z3 FROM (SELECT g, pos, {_inserts("y", "z")} FROM (SELECT g, pos, {_inserts("p", "y")} FROM (
    SELECT g, pos, p0, if(false, p0, NULL) AS p1, if(false, p0, NULL) AS p2, if(false, p0, NULL) AS p3 FROM e)))
  UNION ALL
  SELECT g, pos, z0, z1, z2, z3 FROM (SELECT g, pos, {_inserts("y", "z")} FROM (SELECT g, pos, {_inserts("q", "y")} FROM (
    SELECT b.g, s.pos, {_turn("b.r")} FROM b JOIN s ON b.g = s.g AND s.pos = b.pos + 1)))
), w AS (
  SELECT b.g, {_best("b.r0", "b.r3")} AS x FROM b JOIN n ON b.g = n.g AND b.pos = n.last
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(x.c, 0)::BIGINT AS cost, coalesce(x.a, '') AS audit,
  sha256(coalesce(x.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN n ON n.g = coalesce(a.conv_id, -1) LEFT JOIN w ON w.g = n.g
"""


@query("op12_turn_repair", OP12)
def op12_turn_repair(spark, folder):
    """Faults of damaged conversations, the edits that repair them at least cost, and the result's digest."""
    whole = turns(table(spark, folder, "conversations"))
    rows = damaged(whole)
    plans = cut_lineage(edit_plans(rows, whole), "plans")
    found = null_safe_join(plans, digests(repaired(rows, plans)), ["conv_id"], "left")
    return found.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
