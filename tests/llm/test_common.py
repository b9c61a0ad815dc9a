"""Helpers of the operators."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tollbook.llm.common import staged


def test_wide_rows_are_written_in_small_row_groups(spark):
    rows = spark.range(0, 40, 1, 1).select("id", F.expr("cast(array_join(transform(sequence(1, 20000), i -> hex(xxhash64(i, id))), '') as binary)").alias("b"))
    path = lambda df: glob.glob(df.inputFiles()[0].removeprefix("file://"))[0]
    wide, plain = staged(rows, "wide", wide=True), staged(rows, "plain")
    assert pq.ParquetFile(path(wide)).num_row_groups > 1 == pq.ParquetFile(path(plain)).num_row_groups
    assert wide.select("id", F.sha2("b", 256).alias("b")).exceptAll(plain.select("id", F.sha2("b", 256).alias("b"))).count() == 0 and wide.count() == 40
