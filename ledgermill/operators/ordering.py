"""Row numbers and carried values over groups of any size.

A window partitioned by source alone puts a whole source into one task. Here
the rows are dealt by range over their group, their order and a number of
their own: a segment is a stretch of that order, and neither a group nor a
value with very many rows has to fit into one. What earlier segments
contribute (row counts, the last value) is a small table of one row per group
and segment.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SEGMENT, PLACE = "_segment", "_place"
#: Rows of one key that a task joins at most.
TASK_ROWS = 100_000


def segment_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def place_rows(df: DataFrame, group: list[str], order: list, segments: int | None = None) -> DataFrame:
    """The rows with their ``_segment`` and their ``_place``, which rises along the order.

    The cuts come from a sample of the whole key, the number of the row
    included, so rows that are equal in everything else still spread. The
    placed rows are written: their places must be the same for all that is
    computed from them, also when a task runs again.
    """
    keys = [*group, *order, "_own"]
    placed = (
        df.withColumn("_own", F.monotonically_increasing_id())
        .repartitionByRange(segments or segment_count(df), *keys)
        .sortWithinPartitions(*keys)
        .drop("_own")
        .withColumn(SEGMENT, F.spark_partition_id())
        .withColumn(PLACE, F.monotonically_increasing_id())
    )
    return cut_lineage(placed, "placed")


def with_segments(df: DataFrame, key: str, segments: int | None = None) -> DataFrame:
    """The rows with a segment number that never decreases along ``key``; rows without a key come first."""
    return place_rows(df, [], [key], segments).drop(PLACE)


def null_safe_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which null keys match; keeps the left side's keys."""
    renamed = right
    for name in on:
        renamed = renamed.withColumnRenamed(name, f"_r_{name}")
    condition = reduce(
        lambda a, b: a & b, [left[n].eqNullSafe(renamed[f"_r_{n}"]) for n in on]
    )
    return left.join(renamed, condition, how).drop(*[f"_r_{n}" for n in on])


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread_by: list[str],
    *,
    size: str,
    how: str = "inner",
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Join in which a key that holds very many left rows spans several tasks.

    ``right`` has one row per key, with the number ``size`` of left rows that
    have it. Keys of more than ``task_rows`` rows are heavy: their left rows
    get a salt from the ``spread_by`` columns, out of as many as the number
    asks for, and the right row is repeated once per salt.
    """
    salts = F.ceil(F.col(size) / task_rows)
    heavy = right.filter(F.col(size) > task_rows).select(*on, salts.alias("_salts"))
    salted = null_safe_join(left, heavy, on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread_by), F.coalesce("_salts", F.lit(1)))
    )
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    return null_safe_join(salted.drop("_salts"), repeated, [*on, "_salt"], how).drop("_salt")


def before(group: list[str]):
    """Window over the earlier segments of a group (at most one row each)."""
    return (
        Window.partitionBy(*group)
        .orderBy(SEGMENT)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def number_rows(
    df: DataFrame,
    group: list[str],
    order: list,
    *,
    row: str = "row",
    total: str | None = None,
    segments: int | None = None,
) -> DataFrame:
    """1-based row number per group in the given order, and the group's size."""
    placed = place_rows(df, group, order, segments)
    counts = placed.groupBy(*group, SEGMENT).agg(
        F.count(F.lit(1)).alias("_n"), F.min(PLACE).alias("_first")
    )
    offsets = counts.select(
        *group,
        SEGMENT,
        "_first",
        F.coalesce(F.sum("_n").over(before(group)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("_total"),
    )
    numbered = null_safe_join(placed, offsets, [*group, SEGMENT]).withColumn(
        row, F.col(PLACE) - F.col("_first") + F.col("_before") + 1
    )
    if total:
        numbered = numbered.withColumn(total, F.col("_total"))
    return numbered.drop(SEGMENT, PLACE, "_first", "_before", "_total")
