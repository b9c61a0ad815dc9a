"""Bounded look-around over an integer position, by counting and shifting.

A RANGE frame of a few positions is a sum over a fixed set of offsets. Rows are reduced to
one count per position first; every count is then shifted to the positions that can see
it and added up. No key is ever ordered or gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def rows_in_reach(df: DataFrame, keys: list[str], position: str, first: int, last: int, name: str,
                  where: Column | None = None) -> DataFrame:
    """For every (keys, position) that can see a row: how many rows lie at
    position+first .. position+last."""
    src = df if where is None else df.where(where)
    held = src.groupBy(*keys, position).agg(F.count(F.lit(1)).alias("_held"))
    offsets = F.explode(F.sequence(F.lit(first), F.lit(last)))
    shifted = held.withColumn("_off", offsets).withColumn(position, F.col(position) - F.col("_off"))
    return shifted.groupBy(*keys, position).agg(F.sum("_held").alias(name))


STRETCH = 4096


def sums_behind(df: DataFrame, keys: list[str], position: str, reach: int, value: Column, name: str, stretch: int = STRETCH) -> DataFrame:
    """The sum of a value over the rows at position-reach .. position, for each row that ``df`` holds itself.

    A key is cut into stretches of positions, and rows that the next stretch can see are sent there too, so no key
    is gathered in one task; rows should be reduced to few per position before."""
    home, at = F.floor(F.col(position) / F.lit(stretch)), F.floor((F.col(position) + F.lit(reach)) / F.lit(stretch))
    sent = df.withColumns({"_value": value, "_stretch": F.explode(F.sequence(home, at))})
    behind = Window.partitionBy(*keys, "_stretch").orderBy(position).rangeBetween(-reach, 0)
    found = sent.withColumn(name, F.sum("_value").over(behind))
    return found.where(F.col("_stretch") == home).drop("_value", "_stretch")


def pairs_within(left: DataFrame, right: DataFrame, keys: list[str], position: str, first: int, last: int) -> DataFrame:
    """Bounded range join: right rows whose position is left.position+first .. +last.
    Each left row is listed at the few positions it covers and met by equality."""
    reach = F.explode(F.sequence(F.col(position) + F.lit(first), F.col(position) + F.lit(last)))
    return left.withColumn("_at", reach).drop(position).withColumnRenamed("_at", position).join(right, [*keys, position])
