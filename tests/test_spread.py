"""Tables for costly work are dealt by their rows, not by their splits."""

from pyspark.sql import functions as F

from ledgermill.sources.tables import open_table


def test_one_row_group_in_many_splits(spark, tmp_path):
    path = str(tmp_path / "one.parquet")
    spark.range(40_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).coalesce(1).write.parquet(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 10))
    try:
        assert spark.read.parquet(path).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        table = open_table(spark, path, spread=True)
        sizes = [r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 40_000 * 2 / spark.sparkContext.defaultParallelism
        assert table.select("id").distinct().count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
