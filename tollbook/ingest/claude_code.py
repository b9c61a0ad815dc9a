"""claude_code: one response is spread over several records that share a message id."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tollbook.functions.clock import iso_time
from tollbook.functions.prompts import prompt_columns
from tollbook.functions.tools import result_text, with_tool_input
from tollbook.functions.variants import filled, flag, is_object, items, node, shown, size_of, text, whole
from tollbook.ingest.common import (
    Parts, ROW, attach_results, event_row, first_filled, how_many, of_type, texts_of, total_length,
)

# Record types that only carry a line of text, and the keys it may be under.
TEXT_TYPES = ["last-prompt", "progress", "ai-title", "agent-name", "custom-title", "pr-link"]
TEXT_KEYS = ["lastPrompt", "content", "title", "message", "name", "url"]


def parse(records: DataFrame) -> Parts:
    v = F.col("v")
    r = records.where(is_object(v)).withColumns({
        "typ": text(v, "type"), "ts": iso_time(text(v, "timestamp")), "cwd": filled(v, "cwd"),
        "blocks": items(v, "message.content")})
    said, asked = r.where("typ = 'assistant'"), r.where("typ = 'user'")
    tools = attach_results(_tool_uses(said), _tool_results(asked))
    return Parts(_calls(said), tools, _turns(asked), _events(r))


def _calls(said: DataFrame) -> DataFrame:
    """One row per message id: counters are maxima, block sums add up, names take the last."""
    v, blocks = F.col("v"), F.col("blocks")
    texts, thoughts = texts_of(of_type(blocks, "text")), of_type(blocks, "thinking")
    usage = "message.usage"
    speed = F.coalesce(shown(v, "message.speed"), shown(v, f"{usage}.speed"))
    rows = said.select(
        "session_id", "agent", "repo", "seq", "ts", "cwd", filled(v, "message.id").alias("msg_id"),
        text(v, "requestId").alias("request_id"), text(v, "parentUuid").alias("parent_id"), flag(v, "isSidechain").alias("is_sidechain"),
        text(v, "gitBranch").alias("git_branch"), text(v, "version").alias("harness_version"), filled(v, "message.model").alias("model"),
        filled(v, "message.stop_reason").alias("stop_reason"), filled(v, f"{usage}.service_tier").alias("service_tier"), speed.alias("speed"),
        whole(v, f"{usage}.input_tokens").alias("input_tokens"), whole(v, f"{usage}.output_tokens").alias("output_tokens"),
        whole(v, f"{usage}.cache_read_input_tokens").alias("cache_read_tokens"),
        whole(v, f"{usage}.cache_creation_input_tokens").alias("cache_create_tokens"),
        whole(v, f"{usage}.cache_creation.ephemeral_5m_input_tokens").alias("cache_create_5m"),
        whole(v, f"{usage}.cache_creation.ephemeral_1h_input_tokens").alias("cache_create_1h"),
        total_length(texts).alias("n_text_chars"), total_length(texts_of(thoughts, "thinking")).alias("n_thinking_chars"),
        how_many(of_type(blocks, "thinking", "redacted_thinking")).alias("n_thinking_blocks"),
        how_many(of_type(blocks, "tool_use", "server_tool_use")).alias("n_tool_uses"), first_filled(texts).alias("text_head"))
    rows = rows.withColumn("_key", F.coalesce(F.concat(F.lit("id:"), "msg_id"), F.concat(F.lit("at:"), F.col("seq").cast("string"))))

    first = ["ts", "msg_id", "parent_id", "is_sidechain", "cwd", "git_branch", "harness_version", "agent", "repo"]
    most = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_create_tokens", "cache_create_5m", "cache_create_1h"]
    latest = ["model", "stop_reason", "service_tier", "speed"]
    added = ["n_text_chars", "n_thinking_chars", "n_thinking_blocks", "n_tool_uses"]
    def seen(c):
        return F.when(F.col(c).isNotNull(), F.col("seq"))
    merged = rows.groupBy("session_id", "_key").agg(
        F.min("seq").alias("seq"), F.min_by(F.struct(*first), "seq").alias("_first"),
        *[F.max(c).alias(c) for c in most], *[F.max_by(c, seen(c)).alias(c) for c in latest], *[F.sum(c).alias(c) for c in added],
        *[F.min_by(c, seen(c)).alias(c) for c in ("request_id", "text_head")])
    return merged.select("session_id", "_first.*", *[c for c in merged.columns if c not in ("session_id", "_first", "_key")])


def _tool_uses(said: DataFrame) -> DataFrame:
    b = F.col("b")
    t = said.select(*ROW, "ts", "cwd", filled(F.col("v"), "message.id").alias("msg_id"), F.posexplode("blocks").alias("pos", "b"))
    t = t.where(text(b, "type").isin("tool_use", "server_tool_use")).withColumn(
        "inp", F.when(is_object(node(b, "input")), node(b, "input")))
    t = t.withColumns({
        "tool_use_id": text(b, "id"), "tool_name": text(b, "name"),
        "input_chars": F.when(F.col("inp").isNull(), 2).otherwise(size_of(F.col("inp")))})
    return with_tool_input(t, F.col("tool_name"), F.col("inp"), [F.col("cwd")]).drop("b", "inp", "cwd")


def _tool_results(asked: DataFrame) -> DataFrame:
    b = F.col("b")
    t = asked.select("session_id", "seq", "ts", F.posexplode("blocks").alias("pos", "b")).where(text(b, "type") == "tool_result")
    given = node(b, "is_error")
    return t.select(
        "session_id", text(b, "tool_use_id").alias("tool_use_id"), "seq", "pos", result_text(node(b, "content")).alias("result"),
        F.when(given.isNotNull(), flag(b, "is_error")).alias("explicit"), F.col("ts").alias("result_ts"))


def _turns(asked: DataFrame) -> DataFrame:
    v = F.col("v")
    listed = of_type(F.col("blocks"), "text")
    body = F.coalesce(text(v, "message.content"), F.when(F.size(listed) > 0, F.array_join(texts_of(listed), "\n")))
    t = asked.select(*ROW, "ts", text(v, "uuid").alias("prompt_id"), flag(v, "isMeta").alias("_meta"), body.alias("_body")).where("_body IS NOT NULL")
    return t.withColumns(prompt_columns(F.col("_body"), F.col("_meta"))).drop("_body", "_meta")


def _events(r: DataFrame) -> DataFrame:
    v, typ = F.col("v"), F.col("typ")
    images = r.where("typ = 'user'").select(*ROW, "ts", F.explode("blocks").alias("b")).where(text(F.col("b"), "type") == "image").select(
        *ROW, "ts", *event_row("user_image", None, None, size_of(F.col("b"))))
    snapshot = node(v, "snapshot")
    backups = F.try_variant_get(node(v, "snapshot.trackedFileBackups"), "$", "map<string,variant>")
    meta = node(v, "compactMetadata")
    line = size_of(F.coalesce(*[node(v, k) for k in TEXT_KEYS]))
    def none():
        return F.lit(None).cast("string")
    subtype = F.when(typ == "system", shown(v, "subtype")).when(typ == "attachment", shown(v, "attachment.type"))
    value = (F.when((typ == "system") & is_object(meta) & (size_of(meta) > 2), shown(v, "compactMetadata.trigger"))
             .when(typ == "system", shown(v, "level"))
             .when(typ == "file-history-snapshot", F.coalesce(F.size(F.map_keys(backups)), F.lit(0)).cast("string"))
             .when(typ == "permission-mode", shown(v, "permissionMode")).when(typ == "mode", shown(v, "mode"))
             .when(typ == "queue-operation", shown(v, "operation")))
    def size_or_empty(x):
        return F.when(x.isNull(), 2).otherwise(size_of(x))
    payload = (F.when(typ.isin("system", "queue-operation"), size_of(node(v, "content")))
               .when(typ == "attachment", size_or_empty(node(v, "attachment")))
               .when(typ == "file-history-snapshot", size_or_empty(snapshot))
               .when(typ.isin("permission-mode", "mode"), 0)
               .when(typ.isin(*TEXT_TYPES) & (line > 0), line).otherwise(size_of(v)))
    rest = r.where(F.coalesce(~typ.isin("assistant", "user"), F.lit(True)))
    return images.unionByName(rest.select(*ROW, "ts", *event_row(F.coalesce(F.nullif(typ, F.lit("")), F.lit("unknown")), subtype, value, payload)))
