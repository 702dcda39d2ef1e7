"""The text that an answer is written from, in numbered parts of bounded size.

A context is made of pieces in a fixed order: the titles and lines of the
verified calculations and anomalies first, then the retrieved documents. A
question may have any number of them, so no row holds them all: pieces get the
number of characters before them as a running sum over segments of their
order, and a part takes the pieces that start in its stretch of characters.
The parts of a question, one after the other, are its context.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from .documents import context_label
from .finance import verified_lines
from .ordering import PLACE, SEGMENT, before, null_safe_join, place_rows

#: Characters of a part; its last piece may reach beyond.
PART_CHARS = 1 << 20
ORDER = ["section", "step", "source", "seq", "line"]
DOCUMENTS = 3


def _piece(section: Column, step: int, source: Column, seq: Column, line: Column, text: Column) -> list[Column]:
    return [
        F.col("query_id"), section.cast("int").alias("section"), F.lit(step).alias("step"), source.alias("source"),
        seq.cast("long").alias("seq"), line.alias("line"), text.alias("piece"),
    ]


def verified_pieces(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Titles and lines of the verified facts (see :func:`finance.verified_lines`)."""
    lines = verified_lines(queries, rows)
    title = F.when(F.col("section") == 1, F.lit(C.CALCULATIONS_TITLE)).otherwise(F.lit(C.ANOMALIES_TITLE))
    none = F.lit("")
    titles = lines.select("query_id", "section").distinct().select(
        *_piece(F.col("section"), 0, none, F.lit(0), none, F.concat(F.lit("\n\n"), title))
    )
    return titles.unionByName(lines.select(
        *_piece(F.col("section"), 1, F.col("source"), F.col("seq"), F.col("line"), F.concat(F.lit("\n- "), F.col("line")))
    ))


def document_pieces(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Label and content of the hits ``(query_id, rank, doc_id)``, joined after ranking."""
    found = hits.select("query_id", "rank", "doc_id").join(docs.withColumn("_label", context_label()), "doc_id")
    text = F.concat(F.lit("\n\n"), F.col("_label"), F.lit("\n"), F.col("content"))
    none = F.lit("")
    return found.select(*_piece(F.lit(DOCUMENTS), 1, none, F.col("rank"), none, text))


def assemble_parts(*pieces: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """``query_id, part, n_pieces, text``: contexts from pieces, in parts.

    A part's number is that of the stretch of ``part_chars`` characters in
    which its pieces start; stretches inside one long piece have no part.
    """
    whole = reduce(DataFrame.unionByName, pieces).filter(F.col("piece").isNotNull())
    placed = place_rows(whole, ["query_id"], ORDER).withColumn("_size", F.length("piece").cast("long"))
    carried = placed.groupBy("query_id", SEGMENT).agg(F.sum("_size").alias("_s")).select(
        "query_id", SEGMENT, F.coalesce(F.sum("_s").over(before(["query_id"])), F.lit(0)).alias("_before")
    )
    earlier = Window.partitionBy("query_id", SEGMENT).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("_size").over(earlier), F.lit(0))
    cut = null_safe_join(placed, carried, ["query_id", SEGMENT]).withColumn("_start", start)
    # nothing stands before a context's first piece
    text = F.when(F.col("_start") == 0, F.regexp_replace("piece", r"\A\n+", "")).otherwise(F.col("piece"))
    return cut.select(
        "query_id", F.floor(F.col("_start") / part_chars).cast("long").alias("part"), F.struct(PLACE, text.alias("text")).alias("p")
    ).groupBy("query_id", "part").agg(
        F.count(F.lit(1)).alias("n_pieces"), F.array_join(F.array_sort(F.collect_list("p"))["text"], "").alias("text")
    )


def answer_context(
    queries: DataFrame, rows: DataFrame, hits: DataFrame, docs: DataFrame, part_chars: int = PART_CHARS
) -> DataFrame:
    """The verified facts of every question in front of its documents, in parts."""
    return assemble_parts(verified_pieces(queries, rows), document_pieces(hits, docs), part_chars=part_chars)
