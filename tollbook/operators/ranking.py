"""Most frequent value, first row, top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def most_frequent(df: DataFrame, key: str, values: dict[str, str]) -> DataFrame:
    """Per key and for each ``{output: column}``: the commonest non-NULL value, the
    alphabetically first one on ties. One pass counts all columns; no window is needed."""
    cells = F.array(*[F.struct(F.lit(o).alias("what"), F.col(c).alias("value")) for o, c in values.items()])
    counted = (
        df.select(key, F.explode(cells).alias("_s")).select(key, "_s.what", "_s.value")
        .where("value IS NOT NULL")
        .groupBy(key, "what", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.struct(-F.col("n"), F.col("value"))
    return counted.groupBy(key).agg(
        *[F.min_by("value", F.when(F.col("what") == o, best)).alias(o) for o in values]
    )


def first_row(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """The first row of every key as an aggregate, so it is reduced before the exchange."""
    picked = F.min_by(F.struct(*keep), F.struct(*order)).alias("_first")
    return df.groupBy(key).agg(picked).select(key, "_first.*")


def top_per(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """At most ``n`` rows of every stratum; the limit is applied before the exchange too
    (window group limit), so a stratum of any size is cut down where it lies."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def hash_order(*cols: str, seed: str = "") -> Column:
    """Repeatable pseudo-random order of rows by their identity."""
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in cols])
    return F.md5(F.concat(text, F.lit(f":{seed}")) if seed else text)
