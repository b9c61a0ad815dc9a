"""cursor: roles and blocks only; no times, tokens or, mostly, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tollbook.functions.prompts import prompt_columns
from tollbook.functions.tools import result_text, with_tool_input
from tollbook.functions.variants import flag, filled, is_object, items, node, shown, size_of, text
from tollbook.ingest.common import (
    Parts, ROW, attach_results, event_row, first_filled, how_many, of_type, texts_of, total_length,
)


def parse(records: DataFrame) -> Parts:
    v = F.col("v")
    plain = text(v, "message.content")
    one = F.array(F.parse_json(F.to_json(F.struct(F.lit("text").alias("type"), plain.alias("text")))))
    listed = F.filter(items(v, "message.content"), is_object)
    r = records.where(is_object(v)).withColumns({
        "role": shown(v, "role"), "ts": F.lit(None).cast("timestamp_ntz"), "blocks": F.when(plain.isNotNull(), one).otherwise(listed)})
    said, asked = r.where("role = 'assistant'"), r.where("role = 'user'")
    each = r.where("role IN ('assistant', 'user')").select(*ROW, "ts", "role", F.posexplode("blocks").alias("pos", "b"))
    return Parts(_calls(said), attach_results(_tools(each), _results(each)), _turns(asked), _events(r, each))


def _calls(said: DataFrame) -> DataFrame:
    b = F.col("blocks")
    texts = texts_of(of_type(b, "text"))
    thoughts = F.transform(of_type(b, "thinking"), lambda x: F.coalesce(filled(x, "thinking"), text(x, "text"), F.lit("")))
    return said.select(
        *ROW, "ts", total_length(texts).alias("n_text_chars"), first_filled(texts).alias("text_head"),
        total_length(thoughts).alias("n_thinking_chars"), how_many(thoughts).alias("n_thinking_blocks"),
        how_many(of_type(b, "tool_use")).alias("n_tool_uses"),
    ).withColumn("stop_reason", F.when(F.col("n_tool_uses") > 0, "tool_use").otherwise("end_turn"))


def _tools(each: DataFrame) -> DataFrame:
    b = F.col("b")
    t = each.where((F.col("role") == "assistant") & (text(b, "type") == "tool_use")).withColumn(
        "inp", F.when(is_object(node(b, "input")), node(b, "input")))
    t = t.select(
        *ROW, "ts", "pos", "inp", text(b, "id").alias("tool_use_id"), text(b, "name").alias("tool_name"),
        F.when(F.col("inp").isNull(), 2).otherwise(size_of(F.col("inp"))).alias("input_chars"), text(F.col("inp"), "working_directory").alias("_folder"))
    return with_tool_input(t, F.col("tool_name"), F.col("inp"), [F.col("_folder")]).drop("inp", "_folder")


def _results(each: DataFrame) -> DataFrame:
    b = F.col("b")
    return each.where(text(b, "type") == "tool_result").select(
        "session_id", F.coalesce(filled(b, "tool_use_id"), filled(b, "id")).alias("tool_use_id"), "seq", "pos",
        result_text(node(b, "content")).alias("result"), F.when(node(b, "is_error").isNotNull(), flag(b, "is_error")).alias("explicit"),
        F.lit(None).cast("timestamp_ntz").alias("result_ts"))


def _turns(asked: DataFrame) -> DataFrame:
    listed = of_type(F.col("blocks"), "text")
    t = asked.where(F.size(listed) > 0).select(*ROW, "ts", F.array_join(texts_of(listed), "\n").alias("_body"))
    return t.withColumns(prompt_columns(F.col("_body"))).drop("_body")


def _events(r: DataFrame, each: DataFrame) -> DataFrame:
    v, b = F.col("v"), F.col("b")
    bare = r.where("role IS NULL").select(
        *ROW, "ts", *event_row(F.coalesce(filled(v, "type"), F.lit("unknown")), None, F.coalesce(F.nullif(shown(v, "error"), F.lit("")), shown(v, "status")), size_of(v)))
    other = r.where("role NOT IN ('assistant', 'user')").select(*ROW, "ts", *event_row(F.concat(F.lit("role:"), F.col("role")), None, None, size_of(v)))
    kinds = F.coalesce(text(b, "type").isin("text", "tool_result"), F.lit(False))
    odd = each.where((F.col("role") == "user") & ~kinds).select(*ROW, "ts", *event_row("user_block", shown(b, "type"), None, size_of(b)))
    return bare.unionByName(other).unionByName(odd)
