"""A lexical index with impact levels, and top-k search that scores few documents.

BM25 adds up, over the terms a question and a document share, the question's
weight for the term times the document's *part*: a number below ``k1 + 1``
that grows with the term frequency. Parts fall into ``LEVELS`` levels. The
index keeps, per term and level, how many documents there are and the largest
part: the blocks of a posting list in the order of their impact.

A search has four steps, none of which adds up all pairs that share a term:

1. From the blocks alone: the most a term can add, and a score that ``k``
   documents surely reach.
2. The few documents in the top levels of each term are added up, and the best
   of them scored in full. The k-th best score so far is a floor under the
   final one.
3. Terms are taken in rising order of the most they can add. As long as their
   sum stays below the floor, a document with only such terms cannot enter the
   result. As long as it stays below ``UNREAD`` of the floor, their lists are
   not even read; that is where very common terms end. The other lists are
   added up, and a document drops out that has none of the stronger terms or
   could not reach the floor with all the unread ones.
4. What is left is scored in full.

The result is that of scoring every pair. A question with fewer than ``k``
documents has no floor and all its documents are candidates.

Where the questions' terms and their best documents fit a task, there is a
shorter way: the index has one row per document, so every question is scored
where a document is read, and a task hands on its best ``k`` alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import matches, settle, tokenize
from ..session import cut_lineage

# Scores are compared after rounding, so ranks do not depend on the order in
# which executors add up doubles.
SCORE_DIGITS = 6
#: A document this far below the floor rounds to a lower score than the k-th.
MARGIN = 2 * 10.0**-SCORE_DIGITS
LEVELS = 256
#: A term's top levels with at most so many times k documents are added up for
#: the floor, and so many times k documents of them scored.
SEEDS, FIRST = 50, 8
#: The part of the floor that unread lists may add up to.
UNREAD = 0.1
#: Up to so many postings of all questions' terms together, adding up every pair
#: takes less time than finding out which ones are needed.
ALL_PAIRS = 50_000_000
#: Rows of question terms (about 50 bytes each) that may go to every task.
BROADCAST_TERM_ROWS = 1_000_000
#: The most that a task keeps of all questions' best documents (24 bytes each),
#: and about how many pairs it adds up at once.
KEPT_ROWS, CHUNK = 1_000_000, 500_000
#: Documents of a term that one task joins, where terms are not broadcast.
TERM_ROWS = 100_000


#: A token and its repetitions, in sorted tokens joined by blanks (which no token holds).
RUN = r"([^ ]+)(?: \1(?![^ ]))*+"


def document_terms(docs: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    """``(doc_id, dl, terms)``: a row per document, with ``term, tf`` of its distinct terms.

    Terms are counted inside their row: equal tokens are neighbours in sorted
    order, and a term occurs as often as its run is long. Neither texts nor
    tokens are shuffled.
    """
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    tokens = settle(texts, _t=F.sort_array(tokenize(F.col("_text")))).drop("_text")
    runs = matches(F.array_join("_t", " "), RUN)
    term = lambda run: F.substring_index(run, " ", 1)
    times = lambda run: (F.octet_length(run) + 1) / (F.octet_length(term(run)) + 1)
    counted = F.transform(
        runs, lambda run: F.struct(term(run).alias("term"), times(run).cast("long").alias("tf"))
    )
    return tokens.select("doc_id", F.size("_t").alias("dl"), counted.alias("terms"))


def build_postings(docs: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    """``(doc_id, dl, term, tf)`` of :func:`document_terms`."""
    return document_terms(docs, key, text).select("doc_id", "dl", F.inline("terms"))


def raw_idf(df: Column, n_docs: Column) -> Column:
    return F.log(n_docs - df + 0.5) - F.log(df + 0.5)


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame, postings: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """One row: number of documents, tokens, mean length, vocabulary, mean idf."""
    terms = document_frequencies(postings) if terms is None else terms
    n_docs = docs.agg(F.count(F.lit(1)).cast("double")).scalar()
    tokens = postings.agg(F.sum("tf")).scalar()
    return terms.agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.avg(raw_idf(F.col("df"), n_docs)).alias("avg_idf"),
    ).select(
        n_docs.cast("long").alias("n_docs"),
        tokens.alias("n_tokens"),
        F.try_divide(tokens.cast("double"), n_docs).alias("avg_dl"),
        "n_terms",
        "avg_idf",
    )


def term_weights(terms: DataFrame, n_docs: int, avg_idf: float) -> DataFrame:
    """``(term, df, idf)``; a negative idf is replaced by a quarter of the mean."""
    raw = raw_idf(F.col("df"), F.lit(float(n_docs)))
    return terms.withColumn(
        "idf", F.when(raw < 0, F.lit(C.BM25_EPSILON * avg_idf)).otherwise(raw)
    )


@dataclass
class LexicalIndex:
    """Postings, term weights and the mean length; blocks by impact when a search needs them.

    The tables are written to the shared folder: they are read several times
    by every batch of questions, and the tokens of a corpus are made once.
    """

    documents: DataFrame
    terms: DataFrame
    avg_dl: float
    k1: float = C.BM25_K1
    b: float = C.BM25_B

    @classmethod
    def build(
        cls, docs: DataFrame, key: str = "doc_id", text: str = "content", k1: float = C.BM25_K1, b: float = C.BM25_B
    ) -> LexicalIndex:
        documents = cut_lineage(document_terms(docs, key, text), "postings")
        postings = documents.select("doc_id", "dl", F.inline("terms"))
        counts = cut_lineage(document_frequencies(postings), "terms")
        stats = corpus_stats(docs, postings, counts).first()
        terms = term_weights(counts, stats["n_docs"], stats["avg_idf"] or 0.0)
        return cls(documents, terms, stats["avg_dl"] or 1.0, k1, b)

    @property
    def postings(self) -> DataFrame:
        """``doc_id, dl, term, tf``; those of a row of ``documents`` follow each other."""
        return self.documents.select("doc_id", "dl", F.inline("terms"))

    @cached_property
    def one_row_each(self) -> bool:
        """Whether every document has a number of its own."""
        return self.documents.agg(F.count(F.lit(1)) == F.count_distinct("doc_id")).first()[0]

    @cached_property
    def blocks(self) -> DataFrame:
        """``term, level, n, top``: documents of a term in a level, and their largest part."""
        found = self.postings.groupBy("term", self.level().alias("level")).agg(
            F.count(F.lit(1)).alias("n"), F.max(self.part()).alias("top")
        )
        return cut_lineage(found, "blocks")

    def part(self) -> Column:
        """What a posting adds per unit of its term's weight."""
        norm = F.lit(self.k1) * (F.lit(1 - self.b) + F.lit(self.b) * F.col("dl") / F.lit(self.avg_dl))
        return F.col("tf") * F.lit(self.k1 + 1) / (F.col("tf") + norm)

    def level(self) -> Column:
        return F.floor(self.part() * F.lit(LEVELS / (self.k1 + 1))).cast("int")

    def floor_of(self, level: Column) -> Column:
        """The least part of a level, lowered by a rounding error's worth."""
        return level * F.lit((self.k1 + 1) / LEVELS) * F.lit(1 - 1e-12)


def question_terms(queries: DataFrame, index: LexicalIndex) -> DataFrame:
    """``query_id, term, w, df``: the weighted terms of every question; written."""
    counted = (
        queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )
    weighted = counted.join(index.terms, "term").select(
        "query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"), "df"
    )
    return cut_lineage(weighted, "query-terms")


def with_terms(index: LexicalIndex, postings: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """Postings beside the rows of ``terms(term, df, ...)`` for the same term.

    A ``small`` table of terms goes to every task and the postings are read
    without a shuffle. Otherwise both sides are shuffled by term and a number
    that spreads a term's postings; how far follows from the term's ``df``.
    """
    if small:
        return postings.join(F.broadcast(terms.drop("df")), "term")
    salts = F.ceil(F.col("df") / TERM_ROWS)
    spread = postings.join(index.terms.filter(F.col("df") > TERM_ROWS).select("term", salts.alias("_salts")), "term", "left")
    spread = spread.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("_salts", F.lit(1))))
    repeated = terms.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("df")
    return spread.drop("_salts").join(repeated, ["term", "_salt"]).drop("_salt")


def term_bounds(weighted: DataFrame, index: LexicalIndex, k: int) -> DataFrame:
    """Per question and term, from the blocks: ``most`` it adds to a document,
    ``sure``, which k documents get from it, ``least`` (negative weights), and
    ``seed``, the lowest of the top levels with few documents."""
    falling = Window.partitionBy("query_id", "term").orderBy(F.desc("level"))
    at = weighted.join(index.blocks, "term").withColumn("above", F.sum("n").over(falling))
    gains, level = F.col("w") > 0, F.col("level")
    return at.groupBy("query_id", "term", "w", "df").agg(
        F.coalesce(F.max(F.when(gains, F.col("w") * F.col("top"))), F.lit(0.0)).alias("most"),
        F.max(F.when(gains & (F.col("above") >= k), F.col("w") * index.floor_of(level))).alias("sure"),
        F.min(F.when(~gains, F.col("w") * F.lit(index.k1 + 1)).otherwise(F.lit(0.0))).alias("least"),
        F.min(F.when(gains & (F.col("above") <= SEEDS * k), level)).alias("seed"),
    )


def _full_scores(index: LexicalIndex, weighted: DataFrame, pairs: DataFrame, small: bool) -> DataFrame:
    """``query_id, doc_id, score`` of the written ``pairs(query_id, doc_id)``."""
    held = index.postings.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    shared = with_terms(index, held, weighted, small).join(pairs, ["query_id", "doc_id"], "left_semi")
    return shared.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * index.part()).alias("score"))


def _best(scores: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= n)


def score_floors(weighted: DataFrame, bounds: DataFrame, index: LexicalIndex, k: int, small: bool) -> DataFrame:
    """``query_id, floor``: a score that k documents of the question reach."""
    sure = bounds.groupBy("query_id").agg((F.max("sure") + F.sum("least")).alias("sure"))
    seeds = bounds.filter("seed is not null").select("query_id", "term", "df", "w", "seed")
    seen = with_terms(index, index.postings, seeds, small).filter(index.level() >= F.col("seed"))
    sums = seen.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * index.part()).alias("score"))
    first = cut_lineage(_best(sums, FIRST * k).select("query_id", "doc_id"), "first")
    kth = _best(_full_scores(index, weighted, first, small), k).filter(F.col("_at") == k)
    return sure.join(kth.select("query_id", "score"), "query_id", "left").select(
        "query_id", (F.greatest("sure", "score") - F.lit(MARGIN)).alias("floor")
    )


def lists_to_read(bounds: DataFrame, floors: DataFrame) -> DataFrame:
    """``query_id, term, df, w, strong, rest``: the terms whose lists are read,
    whether weaker ones alone stay below the floor, and what a document must
    get from the lists read to reach the floor with all the others."""
    rising = Window.partitionBy("query_id").orderBy("most", "term")
    asked = bounds.join(floors, "query_id").withColumn("floor", F.greatest("floor", F.lit(0.0)))
    asked = asked.withColumn("upto", F.sum("most").over(rising)).withColumn(
        "_out", (F.col("upto") < F.lit(UNREAD) * F.col("floor")) | (F.col("most") <= 0)
    )
    unread = F.max(F.when(F.col("_out"), F.col("upto"))).over(Window.partitionBy("query_id"))
    asked = asked.withColumn("rest", F.col("floor") - F.coalesce(unread, F.lit(0.0)))
    return asked.filter(~F.col("_out")).select(
        "query_id", "term", "df", "w", (F.col("upto") >= F.col("floor")).alias("strong"), "rest"
    )


def candidates(weighted: DataFrame, index: LexicalIndex, k: int, small: bool = True) -> DataFrame:
    """``query_id, doc_id``: pairs that may be among a question's best k; written.

    All others stay below the k-th score, also after rounding.
    """
    bounds = cut_lineage(term_bounds(weighted, index, k), "bounds")
    floors = score_floors(weighted, bounds, index, k, small)
    read = cut_lineage(lists_to_read(bounds, floors), "lists")
    sums = with_terms(index, index.postings, read, small).groupBy("query_id", "doc_id").agg(
        F.sum(F.col("w") * index.part()).alias("sum"), F.max("strong").alias("strong"), F.max("rest").alias("rest")
    )
    reach = sums.filter(F.col("strong") & (F.col("sum") >= F.col("rest")))
    return cut_lineage(reach.select("query_id", "doc_id"), "candidates")


def _row_scores(table: pa.Table, terms: pa.Array, k: int):
    """Adds up whole documents as their postings pass by and keeps a task's best k per question."""
    number = pc.index_in(table["term"], value_set=terms).to_numpy()
    order = np.argsort(number, kind="stable")
    query_ids, asks = np.unique(table["query_id"].to_numpy(), return_inverse=True)
    asks, weights = asks[order], table["w"].to_numpy()[order]
    # the questions of term t are those from starts[t] to starts[t + 1]
    starts = np.searchsorted(number[order], np.arange(len(terms) + 1))
    n = len(query_ids)

    def scored(ids, term, part):
        """Question, document and rounded score of whole documents."""
        many = starts[term + 1] - starts[term]
        row = np.repeat(np.arange(len(term)), many)
        at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + starts[term][row]
        docs, place = np.unique(ids, return_inverse=True)
        cell, add = place[row] * n + asks[at], part[row] * weights[at]
        if len(docs) * n <= 8 * len(cell):
            sums = np.bincount(cell, add, len(docs) * n)
            cell = np.flatnonzero(sums > 0)
            sums = sums[cell]
        else:
            cell, same = np.unique(cell, return_inverse=True)
            sums = np.bincount(same, add, len(cell))
        return cell % n, docs[cell // n], np.round(sums, SCORE_DIGITS)

    def best(slot, ids, score):
        order = np.lexsort((ids, -score, slot))
        slot, ids, score = slot[order], ids[order], score[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot, side="left")
        floor[slot[place == k - 1]] = score[place == k - 1]
        keep = place < k
        return slot[keep], ids[keep], score[keep]

    floor = np.zeros(n)

    def run(batches):
        floor[:] = 0.0
        kept = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        left = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0)
        for batch in chain(batches, [None]):
            if batch is not None:
                new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                left = tuple(np.concatenate(both) for both in zip(left, new))
            ids, term, part = left
            firsts = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1))
            # the last document may go on in the next batch
            ends = firsts[1:] if batch is not None else np.append(firsts[1:], len(ids))
            pairs = np.append(0, np.cumsum(starts[term + 1] - starts[term]))[ends]
            done = 0
            while done < (ends[-1] if len(ends) else 0):
                # documents with about CHUNK pairs together, one at least
                seen = pairs[np.searchsorted(ends, done, side="right") - 1] if done else 0
                end = ends[max(np.searchsorted(pairs, seen + CHUNK, side="right") - 1, np.searchsorted(ends, done, side="right"))]
                slot, doc, score = scored(ids[done:end], term[done:end], part[done:end])
                good = (score > 0) & (score >= floor[slot])
                kept = tuple(np.concatenate(both) for both in zip(kept, (slot[good], doc[good], score[good])))
                if len(kept[0]) > 2 * k * n + CHUNK:
                    kept = best(*kept)
                done = end
            left = ids[done:], term[done:], part[done:]
        slot, doc, score = best(*kept)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query_ids[slot]), pa.array(doc), pa.array(score)], names=["query_id", "doc_id", "score"]
        )

    return run


def scores_in_rows(weighted: DataFrame, index: LexicalIndex, k: int) -> DataFrame:
    """``query_id, doc_id, score``: the positive scores among the best ``k`` of a question in a task.

    The questions' terms travel with the tasks. A document's postings lie in
    one row, so it is scored for all questions where it is read; no pair of
    question and document leaves a task but its best.
    """
    table = weighted.select(F.col("query_id").cast("long").alias("query_id"), "term", "w").toArrow()
    terms = pc.unique(table["term"])
    names = pa.table({"term": terms, "_term": pa.array(np.arange(len(terms), dtype=np.int32))})
    named = F.broadcast(weighted.sparkSession.createDataFrame(names))
    found = index.postings.join(named, "term").select("doc_id", "_term", index.part().alias("part"))
    return found.mapInArrow(_row_scores(table, terms, k), "query_id long, doc_id long, score double")


def bm25_scores(
    queries: DataFrame, index: LexicalIndex, k: int, *,
    broadcast_rows: int = BROADCAST_TERM_ROWS, all_pairs: int = ALL_PAIRS, kept_rows: int = KEPT_ROWS,
) -> DataFrame:
    """Positive BM25 of every (question, document) pair that may be among the question's best ``k``.

    Where the questions' terms have at most ``all_pairs`` postings, of every
    pair that shares a term. Above that, documents are scored in their rows if
    the questions' terms may go to every task and their best documents
    together are at most ``kept_rows``.
    """
    weighted = question_terms(queries, index)
    rows, postings, asked, nulls = weighted.agg(
        F.count(F.lit(1)), F.sum("df"), F.count_distinct("query_id"), F.count_if(F.col("query_id").isNull())
    ).first()
    small = rows <= broadcast_rows
    numbered = dict(weighted.dtypes)["query_id"] == dict(index.documents.dtypes)["doc_id"] == "bigint" and not nulls
    if (postings or 0) <= all_pairs:
        scores = with_terms(index, index.postings, weighted, small).groupBy("query_id", "doc_id").agg(
            F.sum(F.col("w") * index.part()).alias("score")
        )
    elif rows and small and numbered and asked * k <= kept_rows and index.one_row_each:
        scores = scores_in_rows(weighted, index, k)
    else:
        scores = _full_scores(index, weighted, candidates(weighted, index, k, small), small)
    return scores.withColumn("score", F.round("score", SCORE_DIGITS))
