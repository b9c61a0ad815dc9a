"""Sharding: a two-pass external shuffle into shard folders. DataFrame functions only.

Pass one scatters the records: the shard of a record follows from its key and the number of
shards (rendezvous hashing, so that one more shard takes records only into itself), the
bucket within the shard from a seeded hash of the record and its place. Buckets are sized to
fit a task's memory. Pass two Fisher-Yates shuffles each bucket (``shuffle`` of an array
does that) and writes it; a shard is its buckets one after the other. No bucket follows a
key, so copies of one text, or a third of all rows with one key, spread over buckets.

Results by case: a null text weighs one byte (its line end) and has the checksum of no
bytes; a null key is a key of its own; repeated rows are all written; a text larger than a
bucket makes its bucket larger by itself; an empty table gives no rows; columns named like
the result columns are replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollbook.llm.common import parts, staged, table

BUCKET_BYTES = 24 * 1024 * 1024  # of text; its array, shuffled copy and rows fit beside each other in a task
NAMES = ("shard", "bucket", "pos", "slot")


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard with the highest hash for this key."""
    return F.array_max(F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("w"), F.lit(i).alias("i")) for i in range(shards)]))["i"]


def write_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write all records into ``shards`` folders and return them as a table of the input's columns
    with shard, bucket and pos (place in the bucket). ``docs`` should be a table that was read, not
    a running query, as its rows' places enter the scatter."""
    kept = [c for c in docs.columns if c.lower() not in NAMES]
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 1
    per_shard = parts(docs.select(F.sum(size)).first()[0], bucket_bytes * shards)
    rows = docs.select(F.struct(*[docs[c] for c in kept]).alias("rec"), shard_of(F.col(key), shards, seed).alias("shard"), F.monotonically_increasing_id().alias("place"))
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed), "place", F.col("rec")[key]))
    rows = rows.withColumn("bucket", (F.col("shard") * per_shard + F.pmod("order", F.lit(per_shard))).cast("int")).drop("shard")
    scattered = rows.repartitionById(shards * per_shard, F.col("bucket"))
    gathered = scattered.groupBy("bucket").agg(F.collect_list(F.struct("order", "place", "rec")).alias("recs"))
    # sorted first: a bucket that is made again after a loss comes out the same
    mixed = gathered.select("bucket", F.posexplode(F.shuffle(F.array_sort("recs"), F.lit(seed))).alias("pos", "r"))
    out = mixed.select(*[F.col("r.rec")[c].alias(c) for c in kept], "bucket", "pos", F.expr(f"bucket div {per_shard}").cast("int").alias("shard"))
    return staged(out, "shards", by="shard")


def with_slots(written: DataFrame) -> DataFrame:
    """Written records with slot, their place in the shard: rows of earlier buckets and the place in their own."""
    from pyspark.sql import Window as W

    counts = written.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))  # one row per bucket
    before = counts.select("bucket", (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("_before"))
    return written.join(before, "bucket").withColumn("slot", F.col("_before") + F.col("pos")).drop("_before")


def op10_sharding(spark, sf_dir):
    """All documents in shards 0 to 7, by the law of the key."""
    written = write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    body = F.coalesce("text", F.lit(""))
    digest = written.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), "shard", "bucket", "pos")
    return with_slots(digest).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), shard_of(F.col("doc_id"), 9, 17).alias("grown_shard"))
