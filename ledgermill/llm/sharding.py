"""Contiguous shards of near-equal bytes.

Rows are put in one global order by range partitioning. The total of every
partition, one row each, is added up to the bytes and rows before it; running
sums inside a partition then give every row its place in the whole, and the
sequence is cut at equal byte targets. A shard differs from the mean by less
than the size of one row. The order is by id, then checksum and size of the
text, then place in the input, so a hot id or many equal rows are spread like
others.

Edge cases: a null or empty text has only the fixed overhead; null ids come
first; repeated rows keep one place each; an empty table gives an empty
result; input columns named as the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

OVERHEAD = 16
SHARDS = 40


def row_size(text: Column) -> Column:
    """Bytes of a row in a shard: its UTF-8 text and a fixed overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def text_checksum(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def contiguous_shards(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", keep: bool = True
) -> DataFrame:
    """Rows with ``size, text_crc32, shard, slot``; ``slot`` counts from 0 in a shard.

    With ``keep`` all columns come along; without, only the id does and no
    text is shuffled.
    """
    added = ("size", "text_crc32", "shard", "slot")
    kept = [c for c in docs.columns if c not in added] if keep else [id_col]
    rows = docs.select(
        F.struct(*kept).alias("row"),
        row_size(F.col(text_col)).alias("size"),
        text_checksum(F.col(text_col)).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = [f"row.{id_col}", "text_crc32", "size", "place"]
    ordered = cut_lineage(
        rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ordered"
    )
    totals = ordered.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # one row per partition
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = cut_lineage(
        totals.select(
            "part",
            F.coalesce(F.sum("bytes").over(up_to), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(up_to), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(every).alias("total"),
        ),
        "totals",
    )
    inside = Window.partitionBy("part").orderBy(*order)
    placed = (
        ordered.join(totals, "part")
        .withColumn("bytes_before", F.col("bytes_before") + F.sum("size").over(inside) - F.col("size"))
        .withColumn("number", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.expr(f"int(bytes_before * {int(shards)} div total)"))
        .select("row", "size", "text_crc32", "shard", "number")
    )
    if not keep:
        placed = cut_lineage(placed, "placed")
    firsts = cut_lineage(placed.groupBy("shard").agg(F.min("number").alias("first")), "firsts")
    return placed.join(firsts, "shard").select(
        "row.*", "size", "text_crc32", "shard", (F.col("number") - F.col("first")).alias("slot")
    )
