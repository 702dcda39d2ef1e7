"""Queries that rank documents for the benchmark questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import settle
from ..operators import context as X
from ..operators import retrieval as R
from ..operators import verify as V
from ..session import cut_lineage
from . import duck as Q
from .document_queries import corpus
from .finance_queries import LINES, asked, fact_rows
from .registry import query

K = 20


def questions(t):
    """Benchmark items with the vector of the same number, null where there is none."""
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text").join(
        t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left"
    )


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")


# CTEs shared by the checks ---------------------------------------------------

TERMS = f"""
    dt AS (SELECT doc_id, {Q.base_tokens('text')} AS b FROM documents),
    dk AS (SELECT doc_id, list_concat(b, list_filter(b, lambda x: regexp_full_match(x, '[0-9]+'))) AS tok FROM dt),
    p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (
        SELECT doc_id, len(tok) AS dl, unnest(tok) AS term FROM dk) GROUP BY ALL),
    c AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM p) AS tokens),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    g AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM f, c),
    a AS (SELECT avg(raw) AS mean_idf, count(*) AS n_terms FROM g),
    w AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean_idf ELSE raw END AS idf FROM g, a)
"""

BM25 = f"""{TERMS},
    qt AS (SELECT item_id AS query_id, {Q.base_tokens('text')} AS b FROM benchmark),
    qq AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(list_concat(b,
        list_filter(b, lambda x: regexp_full_match(x, '[0-9]+')))) AS term FROM qt) GROUP BY ALL),
    bs AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (tokens / n)))), 6) AS score
      FROM qq JOIN w USING (term) JOIN p USING (term), c GROUP BY query_id, doc_id),
    bm AS (SELECT * FROM (SELECT query_id, doc_id, score,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM bs WHERE score > 0)
      WHERE rank < {K})
"""

VECTOR = f"""
    vs AS (SELECT b.item_id AS query_id, v.vec_id AS doc_id,
        round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
      FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings v),
    ve AS (SELECT * FROM (SELECT query_id, doc_id, score,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM vs) WHERE rank < {K})
"""

FUSED = f"""{BM25}, {VECTOR},
    fs AS (SELECT query_id, doc_id, round(sum(1.0 / (61 + rank)), 9) AS score FROM (
        SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM ve) GROUP BY ALL),
    fu AS (SELECT * FROM (SELECT query_id, doc_id, score,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM fs) WHERE rank < {K})
"""

DEDUPED = f"""{FUSED},
    du AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank
      FROM (SELECT fu.*, row_number() OVER (PARTITION BY query_id,
          regexp_replace(text, '^\\s+|\\s+$', '', 'g') ORDER BY score DESC, fu.doc_id) AS copy
        FROM fu JOIN documents USING (doc_id)) WHERE copy = 1)
"""

CUT = """
    gp AS (SELECT *, abs(score - lead(score) OVER (PARTITION BY query_id ORDER BY rank)) AS gap,
        count(*) OVER (PARTITION BY query_id) AS n FROM du),
    pk AS (SELECT query_id, max(n) AS n, arg_max(rank, (gap, -rank)) FILTER (gap IS NOT NULL) AS top FROM gp GROUP BY query_id),
    ct AS (SELECT query_id, CASE WHEN n <= 2 THEN n ELSE least(greatest(top + 2, greatest(2, least(5, n))), n) END AS cutoff FROM pk),
    eb AS (SELECT du.*, cutoff FROM du JOIN ct USING (query_id) WHERE rank < cutoff)
"""

GRADED = f"""{DEDUPED}, {CUT},
    gr AS (SELECT eb.*, coalesce(CASE WHEN quality = 1 THEN 0.9 WHEN toxic = 1 THEN 0.4 ELSE 0.5 END >= 0.45
        AND NOT (quality = 0 AND toxic = 1), false) AS relevant FROM eb LEFT JOIN labels USING (doc_id)),
    gc AS (SELECT * FROM (SELECT *, bool_or(relevant) OVER (PARTITION BY query_id) AS found FROM gr)
      WHERE relevant OR (NOT found AND rank < 2))
"""


# queries -----------------------------------------------------------------------

@query(
    "corpus_stats",
    f"""WITH {TERMS}
    SELECT CAST(n AS BIGINT) AS n_docs, CAST(tokens AS BIGINT) AS n_tokens, round(tokens / n, 6) AS avg_dl,
      CAST(n_terms AS BIGINT) AS n_terms, round(mean_idf, 6) AS avg_idf FROM c, a""",
)
def corpus_stats(t):
    docs = corpus(t)
    postings = cut_lineage(R.build_postings(docs), "postings")
    return R.corpus_stats(docs, postings).select(
        "n_docs", "n_tokens", F.round("avg_dl", 6).alias("avg_dl"), "n_terms",
        F.round("avg_idf", 6).alias("avg_idf"),
    )


@query(
    "term_weights",
    f"WITH {TERMS} SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM w",
)
def term_weights(t):
    return R.LexicalIndex.build(corpus(t)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_topk", f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM bm")
def bm25_topk(t):
    return R.bm25_topk(questions(t), corpus(t), K)


@query("vector_topk", f"WITH {VECTOR} SELECT query_id, doc_id, score, rank FROM ve")
def vector_topk(t):
    return R.vector_topk(questions(t), vectors(t), K)


@query("vector_topk_blocks", f"WITH {VECTOR} SELECT query_id, doc_id, score, rank FROM ve")
def vector_topk_blocks(t):
    return R.vector_topk_blocks(questions(t), vectors(t), K)


@query("hybrid_fusion", f"WITH {FUSED} SELECT query_id, doc_id, score, rank FROM fu")
def hybrid_fusion(t):
    return R.hybrid_candidates(questions(t), corpus(t), vectors(t), K)


def _own_k(depth: str) -> str:
    """Fusion in which every question has its own k."""
    wide = lambda cte: cte.replace(f"rank < {K}", f"rank < {C.EXHAUSTIVE_DOCS}")
    return f"""WITH {wide(BM25)}, {wide(VECTOR)},
    kn AS (SELECT item_id AS query_id, n, CAST(CASE WHEN item_id % 2 = 0
        THEN least(greatest(n // 15, 3, CASE WHEN n <= 150 THEN least(20, greatest(8, floor(n * 0.3::DOUBLE))) ELSE 0 END), 20, n)
        ELSE least(greatest(n // 10, 4, CASE WHEN n <= 150 THEN least(25, greatest(8, floor(n * 0.3::DOUBLE))) ELSE 0 END), 25, n)
        END AS BIGINT) AS usual FROM benchmark, (SELECT count(*) AS n FROM documents)),
    kq AS (SELECT query_id, {depth} AS k FROM kn),
    fs AS (SELECT query_id, doc_id, round(sum(1.0 / (61 + rank)), 9) AS score FROM (
        SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM ve) JOIN kq USING (query_id)
      WHERE rank < k GROUP BY query_id, doc_id)
    SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, score,
      row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM fs) JOIN kq USING (query_id) WHERE rank < k"""


def questions_with_depth(t):
    """Questions with the corpus size and how much each usually reads; odd ones ask for a chart."""
    size = t.documents.agg(F.count(F.lit(1))).scalar()
    asked = settle(questions(t), n=size)
    chart = F.col("query_id") % 2 != 0
    return settle(asked, k=F.when(chart, R.adaptive_k(F.col("n"), 4, 25, 10)).otherwise(R.adaptive_k(F.col("n"))))


@query("hybrid_adaptive", _own_k("usual"))
def hybrid_adaptive(t):
    """Fusion as deep as the corpus and the kind of question ask for."""
    return R.hybrid_candidates(questions_with_depth(t), corpus(t), vectors(t), C.EXHAUSTIVE_DOCS)


@query("hybrid_exhaustive", _own_k(f"CASE WHEN query_id % 3 = 0 THEN least(n, {C.EXHAUSTIVE_DOCS}) ELSE usual END"))
def hybrid_exhaustive(t):
    """Every third question asks for improvement rates and reads far more."""
    improvement = F.col("query_id") % 3 == 0
    asked = questions_with_depth(t).withColumn("k", R.exhaustive_k(improvement, F.col("n"), F.col("k")))
    return R.hybrid_candidates(asked, corpus(t), vectors(t), C.EXHAUSTIVE_DOCS)


VARIANTS = BM25.replace(
    f"""SELECT item_id AS query_id, {Q.base_tokens('text')} AS b FROM benchmark""",
    f"""SELECT item_id * 2 + v AS query_id, {Q.base_tokens("text || CASE WHEN v = 1 THEN ' the report of and' ELSE '' END")} AS b
      FROM benchmark, (SELECT unnest([0, 1]) AS v)""",
)


@query(
    "hybrid_variants",
    f"""WITH {VARIANTS}, {VECTOR},
    fs AS (SELECT query_id, doc_id, round(sum(1.0 / (61 + rank)), 9) AS score FROM (
        SELECT query_id // 2 AS query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM ve
        UNION ALL SELECT query_id, doc_id, rank FROM ve) GROUP BY ALL)
    SELECT * FROM (SELECT query_id, doc_id, score,
      row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM fs) WHERE rank < {K}""",
)
def hybrid_variants(t):
    """Two phrasings of every question, fused together."""
    phrasing = F.explode(F.array(F.lit(0), F.lit(1)))
    asked = questions(t).select("query_id", phrasing.alias("variant"), "text", "embedding").withColumn(
        "text", F.when(F.col("variant") == 1, F.concat("text", F.lit(" the report of and"))).otherwise(F.col("text"))
    )
    return R.hybrid_candidates(asked, corpus(t), vectors(t), K)


@query("dedupe_hits", f"WITH {DEDUPED} SELECT query_id, doc_id, score, rank FROM du")
def dedupe_hits(t):
    return R.dedupe_hits(hybrid_fusion(t), corpus(t, spread=False))


@query(
    "elbow_cut",
    f"""WITH {VECTOR}, du AS (SELECT * FROM ve), {CUT}
    SELECT query_id, doc_id, score, rank, CAST(cutoff AS BIGINT) AS cutoff FROM eb""",
)
def elbow_cut(t):
    return R.elbow_cut(vector_topk(t))


def graded(t):
    """Fused, deduped, cut and graded hits; labels stand in for grades."""
    candidates = cut_lineage(R.elbow_cut(dedupe_hits(t)), "candidates")
    quality, toxic = F.col("quality"), F.col("toxic")
    grades = candidates.join(t.labels, "doc_id").select(
        "query_id", "doc_id",
        F.when(quality == 1, F.lit("Highly_Relevant"))
        .when(toxic == 1, F.lit("Irrelevant")).otherwise(F.lit("Moderately_Relevant")).alias("relevance"),
        F.when(quality == 1, F.lit(0.9)).when(toxic == 1, F.lit(0.4)).otherwise(F.lit(0.5)).alias("confidence"),
    )
    return R.relevant_or_top(R.apply_grades(candidates, grades))


@query(
    "graded_context",
    f"""WITH {GRADED} SELECT query_id, doc_id, score, rank, relevant FROM gc""",
)
def graded_context(t):
    return graded(t).select("query_id", "doc_id", "score", "rank", "relevant")


@query(
    "assembled_context",
    f"""WITH {GRADED} SELECT query_id, md5(string_agg('[Source: ' || source || ']' || chr(10) || text,
        chr(10) || chr(10) ORDER BY rank)) AS context_md5, count(*) AS n_docs
      FROM gc JOIN documents USING (doc_id) GROUP BY query_id""",
)
def assembled_context(t):
    return R.assemble_context(graded(t), corpus(t, spread=False)).select(
        "query_id", F.md5("context").alias("context_md5"), "n_docs"
    )


@query(
    "verification_sources",
    f"""WITH {VECTOR} SELECT query_id, doc_id, rank, md5(substr(text, 1, 6000)) AS shown_md5,
      md5(substr(text, 1, 600)) AS snippet_md5 FROM ve JOIN documents USING (doc_id) WHERE rank < 8""",
)
def verification_sources(t):
    texts = vector_topk(t).join(corpus(t).select("doc_id", "content"), "doc_id")
    snippet = texts.withColumn("snippet_md5", F.md5(V.grading_snippet(F.col("content"))))
    return V.verification_sources(snippet).select(
        "query_id", "doc_id", "rank", F.md5("content").alias("shown_md5"), "snippet_md5"
    )


@query(
    "source_list",
    f"""WITH {VECTOR} SELECT query_id, array_to_string(list_sort(list(DISTINCT source)), ', ') AS sources,
      count(*) AS relevant_docs_count FROM ve JOIN documents USING (doc_id) GROUP BY query_id""",
)
def source_list(t):
    hits = vector_topk(t).join(t.documents.select("doc_id", F.col("source").alias("label")), "doc_id")
    return V.source_list(hits).select(
        "query_id", F.array_join("sources", ", ").alias("sources"), "relevant_docs_count"
    )


@query(
    "adaptive_k",
    """
    WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey),
    m AS (SELECT o_custkey, n * 7 AS n FROM n UNION ALL SELECT -1, 0)
    SELECT o_custkey, n,
      CASE WHEN n <= 0 THEN 10 ELSE CAST(least(greatest(n // 15, 3, CASE WHEN n <= 150
        THEN least(20, greatest(8, floor(n * 0.3::DOUBLE))) ELSE 0 END), 20, n) AS BIGINT) END AS k,
      CASE WHEN n <= 0 THEN 10 ELSE CAST(least(greatest(n // 10, 4, CASE WHEN n <= 150
        THEN least(25, greatest(8, floor(n * 0.3::DOUBLE))) ELSE 0 END), 25, n) AS BIGINT) END AS chart_k,
      CASE WHEN o_custkey % 2 = 0 AND n > 0 THEN least(n, 100) ELSE k END AS exhaustive_k
    FROM m
    """,
)
def adaptive_k(t):
    sizes = t.orders.groupBy("o_custkey").agg((F.count(F.lit(1)) * 7).alias("n"))
    none = t.region.agg(F.lit(-1).cast("long").alias("o_custkey"), (F.count(F.lit(1)) * 0).alias("n"))
    n = F.col("n")
    return (
        sizes.unionByName(none)
        .withColumn("k", R.adaptive_k(n))
        .withColumn("chart_k", R.adaptive_k(n, 4, 25, 10))
        .withColumn("exhaustive_k", R.exhaustive_k(F.col("o_custkey") % 2 == 0, n, F.col("k")))
    )


PART = 4000


@query(
    "answer_context",
    f"""WITH {LINES}, {VECTOR},
    pc AS (SELECT query_id, section, 1 AS step, source, seq, line, chr(10) || '- ' || line AS piece FROM ln WHERE line IS NOT NULL
      UNION ALL SELECT DISTINCT query_id, section, 0, '', 0, '', chr(10) || chr(10) || CASE section
        WHEN 1 THEN {Q.quote(C.CALCULATIONS_TITLE)} ELSE {Q.quote(C.ANOMALIES_TITLE)} END FROM ln WHERE line IS NOT NULL
      UNION ALL SELECT ve.query_id, 3, 1, '', rank, '', chr(10) || chr(10) || '[Source: ' || source || ']' || chr(10) || documents.text
        FROM ve JOIN q ON q.query_id = ve.query_id JOIN documents USING (doc_id)),
    sm AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY query_id ORDER BY section, step, source, seq, line
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM pc)
    SELECT CAST(query_id AS BIGINT) AS query_id, CAST(start // {PART} AS BIGINT) AS part, count(*) AS n_pieces,
      md5(string_agg(CASE WHEN start = 0 THEN ltrim(piece, chr(10)) ELSE piece END, '' ORDER BY section, step, source, seq, line)) AS text_md5
    FROM sm GROUP BY query_id, start // {PART}""",
)
def answer_context(t):
    """Verified facts in front of the nearest documents of every question asked."""
    asks = asked(t)
    hits = vector_topk(t).join(asks.select("query_id"), "query_id", "left_semi")
    parts = X.answer_context(asks, fact_rows(t), hits, corpus(t), part_chars=PART)
    return parts.select("query_id", "part", "n_pieces", F.md5("text").alias("text_md5"))
