"""Seeded samples of any size, drawn where the rows lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DIGITS = 4  # hexadecimal digits of a prefix: 65 536 prefixes at most are counted


def first_by_hash(df: DataFrame, hashed: Column, n: int, ties: list[str]) -> DataFrame:
    """The ``n`` rows with the lowest hashes (hexadecimal text, evenly spread), equal hashes in order of ``ties``.

    Rows are counted by the first digits of their hash. All rows of the prefixes that lie wholly below the cut are
    taken where they are, of the one in which the cut falls the first ones; only these are
    ranked, so a task holds one prefix at most (a 65 536th of the rows), whatever ``n`` is."""
    marked = df.withColumn("_hash", hashed).withColumn("_prefix", F.substring("_hash", 1, DIGITS))
    upto = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)  # over one row per prefix
    counts = marked.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    # at most 65 536 narrow rows
    held = marked.join(F.broadcast(counts.where(F.col("_before") < n)), "_prefix")
    whole = held.where(F.col("_before") + F.col("_n") <= n)
    border = held.where(F.col("_before") + F.col("_n") > n)
    rank = Window.partitionBy("_prefix").orderBy("_hash", *ties)
    cut = border.withColumn("_rank", F.row_number().over(rank)).where(F.col("_before") + F.col("_rank") <= n).drop("_rank")
    return whole.unionByName(cut).select(*df.columns)
