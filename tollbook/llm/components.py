"""Connected components of links between numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollbook.llm.common import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row per linked node: node and component, its smallest reachable node.

    Each round every node takes the smallest label among its neighbours' and then the label
    of its label, so long chains shorten by half. Rounds are written to the shared folder."""
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = staged(pairs.union(pairs.select("v", "u")).distinct(), "links")
    labels = staged(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        low = labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("u").alias("label"), F.col("label").alias("next"))
        stepped = staged(low.join(jump, "label").select("u", "old", F.least("label", "next").alias("label")), "labels")
        changed = stepped.filter("old <> label").limit(1).count()
        labels = stepped.drop("old")
        if not changed:
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
