"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from tollbook.schemas import LABELS, conform


def write_result(df: DataFrame, folder: str, name: str) -> str:
    """One headed CSV folder per named result; nested columns become JSON text."""
    flat = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f.name)
        for f in df.schema.fields
    ]
    target = f"{folder}/{name}"
    df.select(*flat).write.mode("overwrite").csv(target, header=True)
    return target


def write_table(df: DataFrame, folder: str, name: str) -> str:
    """Parquet sink for labels and verdicts, which may be as long as the prompts table."""
    target = f"{folder}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(target)
    return target


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of prompts, to be joined to turns."""
    return conform(spark.read.schema(LABELS).parquet(path), LABELS)
