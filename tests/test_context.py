import random

import pytest
from pyspark.sql import functions as F

from ledgermill.operators import context as X
from ledgermill.operators import incremental as I
from ledgermill.operators import retrieval as R
from ledgermill.sources import chatlog

PIECES = "query_id long, section int, step int, source string, seq long, line string, piece string"


def test_parts_join_to_the_context(spark):
    rng = random.Random(6)
    rows = []
    for q in (1, 2, None):
        rows += [(q, 1, 0, "", 0, "", "\n\nTITLE")]
        rows += [(q, 1, 1, f"s{rng.randrange(4)}", k, f"l{k}", f"\n- line {k} " + "x" * rng.randrange(30)) for k in range(200)]
        rows += [(q, 3, 1, "", k, "", "\n\n[Source: f]\n" + "y" * (5000 if k == 2 else 10)) for k in range(4)]
    rows.append((9, 3, 1, "", 0, "", "\n\nonly"))
    rows.append((9, 3, 1, "", 1, "", None))
    found = X.assemble_parts(spark.createDataFrame(rows, PIECES).repartition(5), part_chars=700).collect()
    for q in (1, 2, None, 9):
        mine = sorted((r["part"], r["n_pieces"], r["text"]) for r in found if r["query_id"] == q)
        whole = "".join(x[6] for x in sorted((x for x in rows if x[0] == q and x[6]), key=lambda x: x[1:6]))
        assert "".join(t for _, _, t in mine) == whole.lstrip("\n")
        assert sum(n for _, n, _ in mine) == sum(x[0] == q and x[6] is not None for x in rows)
        assert all(len(t) <= 700 + 5020 for _, _, t in mine) and len({p for p, _, _ in mine}) == len(mine)
    assert X.assemble_parts(spark.createDataFrame([], PIECES)).count() == 0


def test_manifest_batches_run_again(spark, tmp_path):
    path = str(tmp_path / "manifest")
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, content string, extra string")
    first = [(1, "a", "x"), (2, "b", "x"), (3, "a", "y"), (4, None, "z")]
    second = [(5, "b", "x"), (6, "c", "x"), (7, "c", "y"), (8, None, "z")]
    for _ in range(2):
        assert sorted(r["doc_id"] for r in I.process_new(docs(first), path, "r", 0).collect()) == [1, 2, 4]
    for _ in range(2):
        assert [tuple(r) for r in I.process_new(docs(second), path, "r", 1).collect()] == [(6, "c", "x")]
    stored = I.read_manifest(spark, path)
    assert stored.count() == stored.select("fingerprint").distinct().count() == 4
    assert I.process_new(docs(first + second), path, "r", 2).count() == 0
    assert I.process_new(docs([]), path, "r", 3).count() == 0
    some = stored.first()["prefix"]
    assert {r["prefix"] for r in I.read_manifest(spark, path, [some]).collect()} == {some}


@pytest.mark.parametrize("bound", [0, 100])
def test_new_documents_by_either_join(spark, bound):
    docs = spark.createDataFrame([(i, f"t{i % 7}") for i in range(30)], "doc_id long, content string")
    known = docs.filter("doc_id = 3").select(I.fingerprint(F.col("content")).alias("fingerprint"))
    fresh = I.incremental_new(docs, known, broadcast_ids=bound)
    assert sorted(r["doc_id"] for r in fresh.collect()) == [0, 1, 2, 4, 5, 6]
    if bound:  # where survivors go to every task, no exchange carries the texts
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan


def test_chat_store_appends_and_clears(spark, tmp_path):
    path = str(tmp_path / "log")
    entries = lambda rows: spark.createDataFrame(rows, chatlog.ENTRY_SCHEMA)
    some = [("s", 1, '{"question": "q"}', 0.0), ("s", 2, "broken", 0.0), ("t", 1, '{"answer": "a"}', 0.0)]
    for _ in range(3):
        chatlog.append_entries(entries(some), path, "0")
    chatlog.append_entries(entries([("s", 3, "{}", 1.0)]), path, "1")
    assert [(r["session_id"], r["id"]) for r in chatlog.load_all_history(spark, path).collect()] == [("s", 1), ("s", 3), ("t", 1)]
    assert [r["id"] for r in chatlog.load_history(spark, path, "s").collect()] == [1, 3]
    chatlog.clear_session(spark, path, "s")
    chatlog.clear_session(spark, path, "s")
    chatlog.append_entries(entries([("s", 4, "{}", 1.0)]), path)
    assert [r["id"] for r in chatlog.load_history(spark, path, "s").collect()] == [4]
    assert [r["id"] for r in chatlog.load_history(spark, path, "t").collect()] == [1]


def test_every_question_reads_to_its_own_depth(spark):
    docs = spark.createDataFrame([(i, f"word w{i % 5}") for i in range(40)], "doc_id long, content string")
    vectors = spark.createDataFrame([(i, [1.0, i / 40]) for i in range(40)], "doc_id long, embedding array<double>")
    asked = [(1, "word w1", [1.0, 0.5], 3), (1, "word w2", [1.0, 0.1], 3), (2, "word w3", [1.0, 0.0], 11), (3, "none", None, 5)]
    queries = spark.createDataFrame(asked, "query_id long, text string, embedding array<double>, k long")
    found = R.hybrid_candidates(queries, docs, vectors, 20).collect()
    assert {q: sorted(r["rank"] for r in found if r["query_id"] == q) for q in (1, 2, 3)} == {1: [0, 1, 2], 2: list(range(11)), 3: []}
    assert found[0].asDict().keys() == {"query_id", "doc_id", "score", "rank"}
