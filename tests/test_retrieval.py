import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermill.operators import documents as D
from ledgermill.operators import postings as P
from ledgermill.operators import retrieval as R

TEXTS = ["cash flow 5 cash", "net income net", "cash income rows", "other words here", "", "net cash net 5 million"]


def okapi(texts, question):
    """Brute-force Okapi BM25 with the usual floor for negative idf."""
    docs = [t.replace("5 million", "5000000").split() for t in texts]
    docs = [d + [w for w in d if w.isdigit()] for d in docs]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    idf = {}
    for w in {w for d in docs for w in d}:
        df = sum(w in d for d in docs)
        idf[w] = math.log(n - df + 0.5) - math.log(df + 0.5)
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    q = question.split()
    return [
        sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in q) for d in docs
    ]


@pytest.mark.parametrize("bound, pairs", [(0, 0), (1000, 0), (1000, 10**9)])
def test_bm25_matches_brute_force(spark, bound, pairs):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, content string")
    asked = {7: "cash cash net", 8: "income words", 9: "absent"}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    index = R.LexicalIndex.build(docs)
    got = R.bm25_topk(queries, index, 3, broadcast_rows=bound, all_pairs=pairs).collect()
    for key, question in asked.items():
        scores = [(round(s, 6), -i) for i, s in enumerate(okapi(TEXTS, question)) if s > 0]
        want = [(-i, s) for s, i in sorted(scores, reverse=True)[:3]]
        mine = [(r["doc_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == key]
        assert mine == want


@pytest.mark.parametrize("batch, chunk, kept", [(10_000, 500_000, 10**6), (7, 20, 10**6), (7, 20, 0)])
def test_documents_are_scored_in_their_rows(spark, monkeypatch, batch, chunk, kept):
    """Documents across batches, copies, scores that tie; as when every pair is added up."""
    monkeypatch.setattr(P, "CHUNK", chunk)
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["total", "x", "y", *(f"w{i}" for i in range(30))], k=rng.randrange(12))) for _ in range(150)]
    rows = list(enumerate(texts + texts[:60] + ["total x"] * 40 + [None, "7 7 x"]))
    docs = spark.createDataFrame(rows, "doc_id long, content string").repartition(3)
    asked = [(i, " ".join(rng.choices(["total", "x", "absent", "w3", "w9", "7"], k=4))) for i in range(12)]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    index = R.LexicalIndex.build(docs)
    assert index.one_row_each
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        got = R.bm25_topk(queries, index, 6, all_pairs=0, kept_rows=kept)
        want = R.bm25_topk(queries, index, 6, all_pairs=10**9)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        if kept:
            scores = P.bm25_scores(queries, index, 6, all_pairs=0, kept_rows=kept)
            plan = scores._jdf.queryExecution().executedPlan().toString()
            assert "mapInArrow" in plan or "MapInArrow" in plan
            assert "hashpartitioning" not in plan  # no pair is shuffled
    finally:
        spark.conf.set(key, before)


def test_rows_of_one_document_add_up(spark):
    """A number that several rows share is scored over all of them, at any size."""
    docs = spark.createDataFrame([(1, "cash net"), (1, "cash"), (2, "cash rows"), (3, "other")], "doc_id long, content string")
    queries = spark.createDataFrame([(1, "cash net")], "query_id long, text string")
    index = R.LexicalIndex.build(docs)
    assert not index.one_row_each
    got, want = (R.bm25_topk(queries, index, 2, all_pairs=n).collect() for n in (0, 10**9))
    assert sorted(got) == sorted(want)


def test_a_term_of_every_document_is_not_scored(spark):
    """The pairs that are scored grow with k, not with the corpus."""
    rng = random.Random(3)
    scored = {}
    for n in (400, 1600):
        rows = [(i, "total " + "x " * (i % 9) + f"w{rng.randrange(n // 8)} " + f"v{i % 40}" * (i < 400)) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, content string")
        asked = {1: "total w3 v7", 2: "total x", 3: "total", 4: "total w1 w2 absent"}
        queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
        index = R.LexicalIndex.build(docs)
        weighted = P.question_terms(queries, index)
        pairs = P.candidates(weighted, index, 5)
        scored[n] = {r[0]: r[1] for r in pairs.groupBy("query_id").count().collect()}
        got = R.bm25_topk(queries, index, 5, all_pairs=0).collect()
        for key, question in asked.items():
            scores = [(round(s, 6), -i) for i, s in enumerate(okapi([t for _, t in rows], question)) if s > 0]
            want = [(-i, s) for s, i in sorted(scores, reverse=True)[:5]]
            assert [(r["doc_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == key] == want
    assert scored[1600][1] <= 60 and scored[1600][4] <= 60
    assert scored[1600][3] <= 200 and scored[1600][2] < 1600


def test_negative_weights_and_few_documents(spark):
    # every term in most documents: the mean idf, and with it every weight, is below zero
    rows = [(i, "a b c" if i else "a b") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, content string")
    queries = spark.createDataFrame([(1, "a b c"), (2, "c")], "query_id long, text string")
    want = {q: [s for s in okapi([t for _, t in rows], x) if s > 0] for q, x in ((1, "a b c"), (2, "c"))}
    assert R.bm25_topk(queries, docs, 3, all_pairs=0).count() == sum(min(3, len(s)) for s in want.values())
    assert R.bm25_topk(queries, docs.limit(0), 3, all_pairs=-1).count() == 0
    assert R.bm25_topk(queries.limit(0), docs, 3, all_pairs=-1).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_both_vector_searches_are_exact(spark, metric):
    rng = np.random.default_rng(5)
    # a third of the vectors are copies of one, and clusters differ in size
    data = np.concatenate([np.repeat(rng.normal(size=(1, 8)), 100, 0), rng.normal(size=(80, 8)) * 3, rng.normal(size=(120, 8)) + 5])
    asks = np.concatenate([rng.normal(size=(15, 8)) * 2, data[:3], data[290:295]])
    frame = lambda rows, key: spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], f"{key} long, embedding array<float>")
    docs, queries = frame(data, "doc_id").repartition(3), frame(asks, "query_id")
    d32, q32 = data.astype(np.float32).astype(float), asks.astype(np.float32).astype(float)
    if metric == "cosine":
        scores = (q32 @ d32.T) / np.linalg.norm(q32, axis=1)[:, None] / np.linalg.norm(d32, axis=1)[None]
    else:
        scores = -((q32[:, None] - d32[None]) ** 2).sum(2)
    want = {}
    for q, row in enumerate(np.round(scores, 6)):
        best = sorted((-s, i) for i, s in enumerate(row))[:7]
        want[q] = [i for _, i in best]
    small = R.vector_topk(queries, docs, 7, metric=metric)
    large = R.vector_topk_blocks(queries, docs, 7, metric=metric, pivots=9, block_rows=16)
    forced = R.vector_topk(queries, docs, 7, metric=metric, block_bytes=10)
    for result in (small, large, forced):
        got = {}
        for r in sorted(result.collect(), key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append(r["doc_id"])
        assert got == want


def test_fusion_ignores_leg_order(spark):
    random.seed(3)
    legs = [spark.createDataFrame([(1, d, r) for r, d in enumerate(random.sample(range(30), 12))], "query_id long, doc_id long, rank long") for _ in range(4)]
    a = R.rrf_fuse(legs, 10).collect()
    b = R.rrf_fuse(legs[::-1], 10).collect()
    assert sorted(a) == sorted(b) and len(a) == 10


def test_dedupe_keeps_the_best_copy(spark):
    docs = spark.createDataFrame([(1, "amount_sar: 1000"), (2, " amount_sar: 1000 "), (3, "amount_sar: 2000")], "doc_id long, content string")
    hits = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.8), (0, 3, 0.7)], "query_id long, doc_id long, score double")
    assert [r["score"] for r in R.dedupe_hits(hits, docs).orderBy("rank").collect()] == [0.9, 0.7]


@pytest.mark.parametrize(
    "scores, cut",
    [([1.0], 1), ([1.0, 0.1], 2), ([1.0, 0.1, 0.05], 3), ([9, 8, 7, 6, 5, 1, 0.5, 0.4], 6), ([9, 1, 0.9, 0.8, 0.7, 0.6, 0.5], 5), ([5, 4, 3, 2, 1, 0], 5), ([9, 8.9, 8.8, 8.7, 8.6, 8.5, 1], 7)],
)
def test_elbow(spark, scores, cut):
    hits = spark.createDataFrame([(0, i, float(s), i) for i, s in enumerate(scores)], "query_id long, doc_id long, score double, rank long")
    assert R.elbow_cut(hits).count() == cut


def test_adaptive_k(spark):
    sizes = [None, 0, 2, 10, 60, 150, 151, 400]
    rows = spark.createDataFrame([(s,) for s in sizes], "n long").select(R.adaptive_k(F.col("n")).alias("k")).collect()
    assert [r["k"] for r in rows] == [10, 10, 2, 8, 18, 20, 10, 20]


def test_grades_and_fallback(spark):
    hits = spark.createDataFrame([(q, d, 1.0 - d / 10, d) for q in (1, 2) for d in range(4)], "query_id long, doc_id long, score double, rank long")
    grades = spark.createDataFrame(
        [(1, 0, "Irrelevant", 0.9), (1, 2, "Moderately_Relevant", 0.45), (1, 3, "Highly_Relevant", 0.4), (2, 1, "Irrelevant", 1.0)],
        "query_id long, doc_id long, relevance string, confidence double",
    )
    kept = R.relevant_or_top(R.apply_grades(hits, grades))
    assert sorted((r["query_id"], r["doc_id"]) for r in kept.collect()) == [(1, 2), (2, 0), (2, 1)]


def test_context_is_in_rank_order(spark):
    docs = D.union_documents(spark.createDataFrame([(1, "one", "a.pdf", 3), (2, "two", "b.csv", None)], "doc_id long, content string, source string, page int"))
    hits = spark.createDataFrame([(5, 2, 0), (5, 1, 1)], "query_id long, doc_id long, rank long")
    assert R.assemble_context(hits, docs).first()["context"] == "[Source: b.csv]\ntwo\n\n[Source: a.pdf | Page 3]\none"


def test_every_question_is_answered_in_its_dimension(spark):
    rng = np.random.default_rng(2)
    docs = [(i, [float(x) for x in rng.normal(size=2 + i % 3)]) for i in range(90)] + [(900, None), (901, []), (902, [1.0, None])]
    asks = [(i, [float(x) for x in rng.normal(size=2 + i % 4)]) for i in range(16)] + [(50, []), (51, None)]
    d = spark.createDataFrame(docs, "doc_id long, embedding array<double>")
    q = spark.createDataFrame(asks, "query_id long, embedding array<double>")
    cosine = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6)
    want = {
        (i, j) for i, v in asks[:16]
        for _, j in sorted((-cosine(v, w), j) for j, w in docs[:90] if len(w) == len(v))[:4]
    }
    assert {i for i, _ in want} == {i for i, v in asks[:16] if len(v) < 5}
    for found in (R.vector_topk(q, d, 4), R.vector_topk(q, d, 4, block_bytes=100), R.vector_topk_blocks(q, d, 4, block_rows=5)):
        assert {(r["query_id"], r["doc_id"]) for r in found.collect()} == want
    assert R.vector_topk_blocks(q, d.limit(0), 4).count() == R.vector_topk(q.limit(0), d, 4).count() == 0
