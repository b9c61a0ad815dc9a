"""Chat formatting of reply trees.

A message names its parent. Self-joins enumerate all paths from a leaf to its root: each round
joins the paths and the jumps with the jumps, so reach doubles and a chain of n messages takes
log2(n) rounds, written to the shared folder. Branches of a tree are ranked by their score (the
mean of their messages' scores), and each chosen path is formatted as one conversation.

Template: ``<|turn|>role<|text|>text<|end|>`` for each turn. In roles and texts a backslash is
doubled and one is put after each ``<`` and ``[``, so no control string of this or the common
templates stands in a text, and all can be read back. The loss mask is the list of spans
(start, length) of the assistants' texts in the output.

Results by case: null roles and texts count as empty; a message whose parent is not in its
tree is a root; messages that reach no root (a ring) are in no path; of repeated ids in a tree
one row is taken; rows of one turn are ordered by role and text; a null tree is a tree of its
own; an empty table gives no rows; further columns are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tollbook.llm.common import staged, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
SPOKEN = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\|\\(\\)", "$1$2")


def reply_paths(messages: DataFrame) -> DataFrame:
    """Rows (tree, leaf, id, steps) of every root-to-leaf path; steps count from the leaf. ``messages`` holds tree, id and parent."""
    known = messages.groupBy("tree", "id").agg(F.min("parent").alias("parent"))
    known = staged(known.join(known.select("tree", F.col("id").alias("parent"), F.lit(True).alias("has")), ["tree", "parent"], "left")
                   .select("tree", "id", F.when(F.col("has"), F.col("parent")).alias("parent")), "messages")
    jumps = known.filter("parent is not null").select("tree", "id", F.col("parent").alias("up"))
    leaves = known.join(jumps.select("tree", F.col("up").alias("id")).distinct(), ["tree", "id"], "left_anti")
    paths = staged(leaves.select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("steps")), "paths")
    reach, most = 1, known.count()
    while reach <= most and not jumps.isEmpty():
        further = paths.join(jumps, ["tree", "id"]).select("tree", "leaf", F.col("up").alias("id"), (F.col("steps") + reach).alias("steps"))
        paths = staged(paths.union(further), "paths")
        jumps = staged(jumps.join(jumps.select("tree", F.col("id").alias("up"), F.col("up").alias("top")), ["tree", "up"]).select("tree", "id", F.col("top").alias("up")), "jumps")
        reach *= 2
    roots = known.filter("parent is null").select("tree", "id")
    rooted = paths.join(roots, ["tree", "id"], "left_semi").select("tree", "leaf")
    return paths.join(rooted, ["tree", "leaf"], "left_semi")


def formatted(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """One row per chosen path: tree, leaf, rank, score, n_turns, formatted and loss_spans.
    ``messages`` holds tree (string), id, parent, role, text and score; ``branches`` keeps the best so many of each tree (default: all)."""
    messages = messages.withColumn("tree", F.coalesce(F.col("tree").cast("string"), F.lit("")))
    paths = reply_paths(messages.select("tree", "id", "parent"))
    told = messages.groupBy("tree", "id").agg(F.min(F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))).alias("m"))
    rows = paths.join(told, ["tree", "id"]).select("tree", "leaf", "steps", "m.role", "m.text", "m.score")
    start = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    rows = rows.withColumn("head", start).withColumn("body", escaped(F.col("text"))).withColumn("tail", F.lit(END))
    before = W.partitionBy("tree", "leaf").orderBy(F.desc("steps")).rowsBetween(W.unboundedPreceding, -1)
    long = F.length("head") + F.length("body") + F.length("tail")
    rows = rows.withColumn("at", F.coalesce(F.sum(long).over(before), F.lit(0)) + F.length("head"))
    one = rows.groupBy("tree", "leaf").agg(
        F.avg("score").alias("score"), F.count(F.lit(1)).alias("n_turns"),
        F.sort_array(F.collect_list(F.struct(F.col("at"), F.concat("head", "body", "tail").alias("turn")))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("role") == SPOKEN, F.struct(F.col("at").cast("long").alias("start"), F.length("body").cast("long").alias("length"))))).alias("loss_spans"))
    ranked = one.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if branches is not None:
        ranked = ranked.filter(F.col("rank") <= branches)
    return ranked.select("tree", "leaf", "rank", "score", "n_turns", F.concat_ws("", F.col("turns.turn")).alias("formatted"), "loss_spans")


def read_back(chats: DataFrame) -> DataFrame:
    """Formatted conversations with their turns (role, text) and the text under the loss mask, both unescaped."""
    inside = F.transform(F.filter(F.split("formatted", r"<\|turn\|>"), lambda t: t != ""), lambda t: F.struct(
        unescaped(F.substring_index(t, TEXT, 1)).alias("role"), unescaped(F.regexp_extract(t, r"(?s)<\|text\|>(.*)<\|end\|>$", 1)).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescaped(F.expr("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.withColumn("turns", inside).withColumn("loss_text", F.concat_ws("", loss))


def chains(conversations: DataFrame) -> DataFrame:
    """Messages of conversations that are a list of turns: each turn answers the one before."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = conversations.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn").withColumn("id", place.cast("long"))
    return rows.select(F.col("conv_id").alias("tree"), "id", F.nullif(F.col("id") - 1, F.lit(0)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op5_chat_formatting(spark, sf_dir):
    """Every conversation, formatted and read back."""
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    every = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = read_back(formatted(chains(every)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(F.nullif(F.col("tree"), F.lit("")).cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                      F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP5_SQL = r"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
told AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(23 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g'))) AS formatted_chars
  FROM every GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM told
"""
