"""Ledger tables on disk: five Parquet folders below one directory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tollbook.schemas import LEDGER, conform


@dataclass
class Ledger:
    """The five flat tables every analysis starts from."""

    calls: DataFrame
    tool_calls: DataFrame
    user_turns: DataFrame
    events: DataFrame
    sessions: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in LEDGER}


def scan_ledger(spark: SparkSession, folder: str) -> Ledger:
    """Open a ledger. The four fact tables have declared schemas; ``sessions`` may carry
    more catalog columns than the declared ones, which are kept."""
    frames = {}
    for name, schema in LEDGER.items():
        reader = spark.read
        if name != "sessions":
            reader = reader.schema(schema)
        df = reader.parquet(f"{folder}/{name}")
        frames[name] = conform(df, schema, keep_extra=name == "sessions")
    return Ledger(**frames)


def write_ledger(ledger: Ledger, folder: str, partition_by: tuple[str, ...] = (), rows_per_file: int | None = None) -> None:
    """Write the five tables as zstd Parquet; ``partition_by=("agent",)`` lays the fact
    tables out for partition pruning. Files are as large as the tasks that write them, unless a number of rows is given."""
    for name, df in ledger.tables().items():
        writer = df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file or 0)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{folder}/{name}")
