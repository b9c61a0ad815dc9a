"""A global row number without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tollbook.session import fresh_folder


def numbered(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """1-based number of every row in ``order``.

    Rows are range-partitioned and sorted in place; the result is written out, since a second
    run could draw other range bounds. A row's number is its place in its partition plus the
    rows of the partitions before it (one row per partition is added up)."""
    spark = df.sparkSession
    path = fresh_folder(spark, "numbered")
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    kept = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # one row per partition of the shuffle
    return kept.join(F.broadcast(starts), "_part").withColumn(name, F.col("_base") + F.col("_at") - F.col("_from") + 1).drop("_part", "_at", "_from", "_base")
