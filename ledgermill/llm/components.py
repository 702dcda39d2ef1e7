"""Connected components of an edge table, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _is_done(edges: DataFrame) -> bool:
    """Whether the edges ``a > b`` are stars: no node in two of them, no center hanging on another."""
    ends = edges.select(
        F.inline(F.array(
            F.struct(F.col("a").alias("node"), F.col("b").alias("on")), F.struct(F.col("b").alias("node"), F.col("b").alias("on"))
        ))
    )
    return ends.groupBy("node").agg(F.min("on").alias("x"), F.max("on").alias("y")).filter("x <> y").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges(a, b)``; the label is the smallest node.

    Every pass hangs the larger neighbours of a node on its smallest neighbour,
    then the smaller ones; the edges end as stars around the labels. A pass is
    two groupings with partial minima and two joins, so a node with very many
    neighbours is never gathered. Each pass is written to the shared folder.
    Nulls and loops in the edges are ignored.
    """
    now = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    now = cut_lineage(now, "edges")
    while not _is_done(now):
        both = now.select(
            F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        )
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.join(low, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.inline(F.array(
                F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
            ))
        ).filter("a <> b").distinct()
        now = cut_lineage(small, "edges")
    return now.select(
        F.inline(F.array(
            F.struct(F.col("a").alias("node"), F.col("b").alias("label")),
            F.struct(F.col("b").alias("node"), F.col("b").alias("label")),
        ))
    ).distinct()
