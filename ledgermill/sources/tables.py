"""Opening Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A split may have so many times a core's share of the rows.
EVEN = 0.5
#: Dealt rows: at most so many tasks per core, each with at least so many rows.
ROUNDS, TASK_ROWS = 4, 20_000


def open_table(spark: SparkSession, path: str, spread: bool = False) -> DataFrame:
    """A Parquet table.

    With ``spread``, a table whose rows lie in few of its splits is dealt over
    the cores, for work that is costly per row. Rows are counted, not splits:
    only the split that holds the middle of a row group reads it, so a large
    file may have many splits and yet its rows in few of them. The count reads
    the files' footers alone. Where no split has much more than a core's share
    of the rows, the table is left as it is.
    """
    table = spark.read.parquet(path)
    if not spread:
        return table
    cores = spark.sparkContext.defaultParallelism
    counts = [r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()]
    if counts and max(counts) * cores > EVEN * sum(counts):
        tasks = max(cores, min(ROUNDS * cores, sum(counts) // TASK_ROWS))
        return table.repartition(tasks)
    return table
