"""Ranking documents for whole batches of questions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import let, strip
from ..session import cut_lineage
from .documents import context_label
from .postings import (  # noqa: F401
    SCORE_DIGITS, LexicalIndex, bm25_scores, build_postings, corpus_stats, document_frequencies, term_weights,
)


def ranked(
    scores: DataFrame,
    k: int | Column | None,
    group: list[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Add the 0-based ``rank`` by falling score, then id; keep the first ``k``.

    With a literal ``k`` (or ``limit``) Spark keeps k rows per group and task
    before the shuffle, so a question with very many hits stays small.
    """
    group = group or ["query_id"]
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "doc_id")
    out = scores.withColumn("rank", F.row_number().over(order))
    if isinstance(k, int):
        out = out.filter(F.col("rank") <= k)
    elif k is not None:
        if limit is not None:
            out = out.filter(F.col("rank") <= limit)
        out = out.filter(F.col("rank") <= k)
    return out.withColumn("rank", (F.col("rank") - 1).cast("long"))


# --------------------------------------------------------------------------
# lexical leg
# --------------------------------------------------------------------------

def bm25_topk(
    queries: DataFrame,
    docs: DataFrame | LexicalIndex,
    k: int,
    **options,
) -> DataFrame:
    """Best ``k`` documents per question with a positive BM25 score.

    ``queries(query_id, text)``; the corpus is ``docs(doc_id, content)`` or an
    index built from it.
    """
    index = docs if isinstance(docs, LexicalIndex) else LexicalIndex.build(docs)
    return ranked(bm25_scores(queries, index, k, **options).filter("score > 0"), k)


# --------------------------------------------------------------------------
# vector leg
# --------------------------------------------------------------------------

QUERY_BLOCK_BYTES = 64 << 20
# Numbers of documents with a hit that may go to every task.
BROADCAST_HITS = 1_000_000
# Questions scored at once: with a batch of 10,000 documents, 80 MB of scores.
QUERY_TILE = 1024


def _similarity(docs: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Scores, one row per query."""
    dots = queries @ docs.T
    if metric == "dot":
        return dots
    if metric == "l2":
        # differences from a common center, so that far-off vectors do not cancel
        center = docs.mean(axis=0)
        a, b = queries - center, docs - center
        return -((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None, :])
    lengths = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(docs, axis=1)[None, :]
    return np.divide(dots, lengths, out=np.zeros_like(dots), where=lengths > 0)


def _best(slot, ids, score, k):
    """First k entries of each slot by falling score, then id."""
    order = np.lexsort((ids, -score, slot))
    slot, ids, score = slot[order], ids[order], score[order]
    first = np.searchsorted(slot, slot, side="left")
    keep = np.arange(len(slot)) - first < k
    return slot[keep], ids[keep], score[keep]


def _block_topk(doc_ids, doc_vectors, query_vectors, k, metric):
    scores = np.round(_similarity(doc_vectors, query_vectors, metric), SCORE_DIGITS)
    if scores.shape[1] > k:
        floor = np.partition(scores, -k, axis=1)[:, -k][:, None]
        slot, at = np.nonzero(scores >= floor)
    else:
        slot, at = np.nonzero(np.ones_like(scores, dtype=bool))
    return _best(slot, doc_ids[at], scores[slot, at], k)


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(rows, -1)


def whole_vectors(table: DataFrame, key: str) -> DataFrame:
    """``key, embedding, dim`` of the rows whose vector has values and no null among them."""
    usable = (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull())
    return table.filter(usable & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias(key), "embedding", F.size("embedding").alias("dim")
    )


def vector_topk(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    *,
    metric: str = "cosine",
    block_bytes: int = QUERY_BLOCK_BYTES,
) -> DataFrame:
    """Exact nearest documents per question vector.

    ``queries(query_id, embedding)``, ``docs(doc_id, embedding)``. Every
    question is answered among the documents of its own dimension. No pair is
    ever emitted: a task keeps the best k per question while it reads. The
    questions travel with the tasks in blocks of about ``block_bytes``, one
    after the other, and the corpus is read once for each block, without a
    shuffle; what a block finds is written before the next one starts, so the
    driver holds one block. Every metric takes this way at every size.
    :func:`vector_topk_blocks` prunes instead, for metrics that are distances.
    Vectors that are null, empty or hold a null match nothing.
    """
    asked, rows = whole_vectors(queries, "query_id"), whole_vectors(docs, "doc_id")
    # one row per dimension
    sizes = sorted((r["dim"], r["count"]) for r in asked.groupBy("dim").count().collect())
    blocks = [
        (dim, n, b) for dim, count in sizes
        for n in [max(1, -(-count * dim * 8 // block_bytes))] for b in range(n)
    ]
    schema, parts = "query_id long, doc_id long, score double", []
    for dim, n, b in blocks:
        block = asked.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("query_id"), F.lit(n)) == b))
        table = block.select("query_id", "embedding").toArrow()
        if table.num_rows:
            near = rows.filter(F.col("dim") == dim).select("doc_id", "embedding")
            found = near.mapInArrow(_nearest(table, k, metric), schema)
            parts.append(cut_lineage(ranked(found, k).drop("rank"), "nearest") if len(blocks) > 1 else found)
    if not parts:
        return ranked(docs.sparkSession.createDataFrame([], schema), k)
    return ranked(reduce(DataFrame.unionByName, parts), k)


def _nearest(table: pa.Table, k: int, metric: str, tile: int = QUERY_TILE):
    """The best k documents of a task for each question, scored a tile of questions at a time."""
    query_ids = np.asarray(table["query_id"].to_numpy())
    vectors = _matrix(table["embedding"], table.num_rows)

    def run(batches):
        best = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            values = _matrix(batch.column(1), batch.num_rows)
            for start in range(0, len(vectors), tile):
                slot, found, score = _block_topk(ids, values, vectors[start : start + tile], k, metric)
                found = (slot + start, found, score)
                best = found if best is None else tuple(np.concatenate(p) for p in zip(best, found))
            best = _best(*best, k)
        if best is not None:
            slot, ids, score = best
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[slot]), pa.array(ids), pa.array(score)],
                names=["query_id", "doc_id", "score"],
            )

    return run


def vector_topk_blocks(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    *,
    metric: str = "cosine",
    pivots: int | None = None,
    block_rows: int = 2048,
) -> DataFrame:
    """Exact nearest documents when the question table is large too.

    Every dimension is searched on its own. Both sides are assigned to pivot
    vectors, as many as the root of the number of documents, found through a
    coarser set of pivots above them. Each question first ranks the documents of its own cell, which gives a k-th
    distance it has to beat; a cell can hold something better only if the
    distance to its pivot minus the cell's radius is within that distance. The
    surviving (question, cell) pairs join on the cell number with blocks of at
    most ``block_rows`` documents, and each pair of blocks emits its best k.
    """
    from .vectors import pruned_topk

    return pruned_topk(queries, docs, k, metric, pivots, block_rows)


# --------------------------------------------------------------------------
# fusion, cut-off, grades
# --------------------------------------------------------------------------

def rrf_fuse(legs: list[DataFrame], k_max: int | Column, k: int = C.RRF_K, limit: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of ranked hits ``(query_id, doc_id, rank)``.

    Sums 1/(k + rank + 1) over legs and question variants, per document.
    """
    hits = reduce(
        lambda a, b: a.unionByName(b),
        [leg.select("query_id", "doc_id", "rank") for leg in legs],
    )
    fused = hits.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(k + 1) + F.col("rank"))), 9).alias("score")
    )
    return ranked(fused, k_max, limit=limit)


def adaptive_k(
    corpus: Column, k_min: int = 3, upper: int = 20, divisor: int = 15
) -> Column:
    """How many documents to fetch for a corpus of the given size."""

    def body(n: Column) -> Column:
        base = F.greatest(F.floor(n / divisor), F.lit(k_min))
        small = F.least(F.lit(upper), F.greatest(F.lit(8), F.floor(n * F.lit(0.3))))
        grown = F.when(n <= 150, F.greatest(base, small)).otherwise(base)
        return F.when(
            n.isNull() | (n <= 0), F.lit(max(k_min, min(10, upper)))
        ).otherwise(F.least(grown, F.lit(upper), n)).cast("long")

    return let(corpus, body)


def exhaustive_k(is_improvement: Column, corpus: Column, usual: Column) -> Column:
    """Improvement-rate questions read up to 100 documents."""
    return F.when(
        is_improvement & (corpus > 0), F.least(corpus, F.lit(C.EXHAUSTIVE_DOCS))
    ).otherwise(usual)


def _with_hits(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """The documents with a hit, told where they are read; all of them if the written ``hits`` are very many."""
    if hits.count() > BROADCAST_HITS:
        return docs
    return docs.join(F.broadcast(hits.select("doc_id").distinct()), "doc_id", "left_semi")


def dedupe_hits(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Keep the best-scored hit per question and trimmed content; rank again.

    Texts become digests where they are read, so that no shuffle carries them;
    of the documents without a hit, unless the hits are very many, none does.
    Grouping (not a window) lets many copies of one text collapse.
    """
    hits = cut_lineage(hits, "hits")
    docs = _with_hits(docs, hits)
    texts = hits.join(docs.select("doc_id", F.sha2(strip(F.col("content")), 256).alias("_key")), "doc_id")
    kept = (
        texts.groupBy("query_id", "_key")
        .agg(F.min(F.struct((-F.col("score")).alias("neg"), "doc_id")).alias("_best"))
        .select(
            "query_id",
            F.col("_best.doc_id").alias("doc_id"),
            (-F.col("_best.neg")).alias("score"),
        )
    )
    return ranked(kept, None)


def elbow_cut(hits: DataFrame, group: list[str] | None = None, min_docs: int = 2) -> DataFrame:
    """Cut each ranked list after its largest drop in score.

    ``hits`` are top-k lists, so a group has at most k rows.
    """
    group = group or ["query_id"]
    order = Window.partitionBy(*group).orderBy("rank")
    whole = Window.partitionBy(*group)
    gap = F.abs(F.col("score") - F.lead("score").over(order))
    out = (
        hits.withColumn("_gap", gap)
        .withColumn("_n", F.count(F.lit(1)).over(whole))
        .withColumn(
            "_at",
            -F.max(
                F.when(
                    F.col("_gap").isNotNull(),
                    F.struct("_gap", (-F.col("rank")).alias("neg")),
                )
            ).over(whole)["neg"],
        )
    )
    floor = F.greatest(F.lit(min_docs), F.least(F.lit(5), F.col("_n")))
    cut = F.when(F.col("_n") <= min_docs, F.col("_n")).otherwise(
        F.least(F.greatest(F.col("_at") + 2, floor), F.col("_n"))
    )
    return (
        out.withColumn("cutoff", cut.cast("long"))
        .filter(F.col("rank") < F.col("cutoff"))
        .drop("_gap", "_n", "_at")
    )


def is_relevant_grade() -> Column:
    return F.coalesce(
        F.col("relevance").isin(*C.RELEVANT_GRADES)
        & (F.col("confidence") >= C.MIN_GRADE_CONFIDENCE),
        F.lit(False),
    )


def apply_grades(hits: DataFrame, grades: DataFrame) -> DataFrame:
    """Mark hits relevant by their grade; a missing grade counts as irrelevant."""
    return hits.join(
        grades.select("query_id", "doc_id", "relevance", "confidence"),
        ["query_id", "doc_id"],
        "left",
    ).withColumn("relevant", is_relevant_grade())


def relevant_or_top(hits: DataFrame, keep: int = C.FALLBACK_DOCS) -> DataFrame:
    """Relevant hits; where a question has none, its first two."""
    whole = Window.partitionBy("query_id")
    return (
        hits.withColumn("_any", F.max("relevant").over(whole))
        .filter(F.col("relevant") | (~F.col("_any") & (F.col("rank") < keep)))
        .drop("_any")
    )


def graded_context(hits: DataFrame, docs: DataFrame, grades: DataFrame) -> DataFrame:
    """Candidates -> distinct contents -> score cut -> graded -> fallback."""
    return relevant_or_top(
        apply_grades(elbow_cut(dedupe_hits(hits, docs)), grades)
    )


def hybrid_candidates(
    queries: DataFrame,
    docs: DataFrame | LexicalIndex,
    vectors: DataFrame,
    k: int,
    *,
    metric: str = "cosine",
) -> DataFrame:
    """BM25 and vector hits of every question variant, fused per question.

    ``queries(query_id, text, embedding[, k])``, a row per variant. ``k`` is
    the most that any question gets; with a column ``k`` (see
    :func:`adaptive_k`, :func:`exhaustive_k`) a question takes as many from
    each leg and keeps as many. What leaves a task before a shuffle is bounded
    by the one number, what a question reads by its own.
    """
    own = ["k"] if "k" in queries.columns else []
    # each variant is a question of its own; its number is written once
    keyed = cut_lineage(
        queries.select(F.col("query_id").alias("_q"), "text", "embedding", *own).withColumn("_id", F.monotonically_increasing_id()),
        "variants",
    )
    names = keyed.select("_id", "_q", *own)
    within = (F.col("rank") < F.col("k")) if own else F.lit(True)
    legs = [
        bm25_topk(keyed.select(F.col("_id").alias("query_id"), "text"), docs, k),
        vector_topk(
            keyed.filter(F.col("embedding").isNotNull()).select(F.col("_id").alias("query_id"), "embedding"),
            vectors, k, metric=metric,
        ),
    ]
    back = [
        leg.withColumnRenamed("query_id", "_id").join(names, "_id").filter(within)
        .select(F.col("_q").alias("query_id"), "doc_id", "rank")
        for leg in legs
    ]
    fused = rrf_fuse(back, k)
    if not own:
        return fused
    most = names.groupBy(F.col("_q").alias("query_id")).agg(F.max("k").alias("k"))
    return fused.join(most, "query_id").filter(within).drop("k")


def assemble_context(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """One context text per question: label and content in rank order.

    The texts are joined only to the hits that survived ranking, and only those
    of documents with such a hit are shuffled, unless the hits are very many.
    """
    hits = cut_lineage(hits.select("query_id", "rank", "doc_id"), "hits")
    return (
        hits.join(_with_hits(docs, hits).withColumn("_label", context_label()), "doc_id")
        .groupBy("query_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("rank", F.concat(F.col("_label"), F.lit("\n"), F.col("content")).alias("text"))
                )
            ).alias("_parts"),
            F.count(F.lit(1)).alias("n_docs"),
        )
        .select("query_id", F.array_join(F.col("_parts.text"), "\n\n").alias("context"), "n_docs")
    )
