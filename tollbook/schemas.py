"""Declared schemas of the ledger. Column names, order and types."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType,
)

_TYPES: dict[str, DataType] = {
    "STRING": StringType(), "INT": IntegerType(), "BIGINT": LongType(), "DOUBLE": DoubleType(),
    "BOOLEAN": BooleanType(), "TIMESTAMP_NTZ": TimestampNTZType(),
}


def columns(text: str) -> StructType:
    """'name TYPE, ...' as a schema; unlike DDL parsing this needs no running session."""
    pairs = (field.split() for field in text.split(","))
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


_ROW = "session_id STRING, agent STRING, repo STRING, seq INT"

CALLS = columns(
    f"{_ROW}, ts TIMESTAMP_NTZ, msg_id STRING, request_id STRING, parent_id STRING, "
    "is_sidechain BOOLEAN, model STRING, harness_version STRING, stop_reason STRING, "
    "speed STRING, service_tier STRING, input_tokens BIGINT, cache_read_tokens BIGINT, "
    "cache_create_tokens BIGINT, cache_create_5m BIGINT, cache_create_1h BIGINT, "
    "output_tokens BIGINT, reasoning_tokens BIGINT, context_window BIGINT, "
    "n_text_chars BIGINT, n_thinking_chars BIGINT, n_thinking_blocks INT, "
    "n_tool_uses INT, text_head STRING, cwd STRING, git_branch STRING, timezone STRING"
)

TOOL_CALLS = columns(
    "session_id STRING, agent STRING, repo STRING, seq INT, msg_id STRING, "
    "ts TIMESTAMP_NTZ, tool_use_id STRING, tool_name STRING, tool_kind STRING, "
    "file_path_raw STRING, file_path STRING, patched_files STRING, command_head STRING, "
    "input_chars BIGINT, old_string_chars BIGINT, new_string_chars BIGINT, "
    "content_chars BIGINT, read_offset BIGINT, read_limit BIGINT, result_chars BIGINT, "
    "result_hash STRING, is_error BOOLEAN, error_head STRING, result_ts TIMESTAMP_NTZ, "
    "result_latency_ms BIGINT, is_interrupted BOOLEAN"
)

USER_TURNS = columns(
    f"{_ROW}, ts TIMESTAMP_NTZ, prompt_id STRING, text STRING, chars BIGINT, "
    "human_chars BIGINT, is_meta BOOLEAN, is_interrupt BOOLEAN, "
    "is_slash_command BOOLEAN, has_system_reminder BOOLEAN"
)

EVENTS = columns(
    f"{_ROW}, ts TIMESTAMP_NTZ, event_type STRING, subtype STRING, value STRING, "
    "payload_chars BIGINT"
)

SESSIONS = columns(
    "session_id STRING, session_id_meta STRING, agent STRING, agent_raw STRING, "
    "detected_format STRING, repo STRING, created_at STRING, branch STRING, "
    "strategy STRING, bytes BIGINT, trajectory STRING, models STRING, "
    "agent_versions STRING, files_touched STRING, n_files_touched BIGINT, "
    "stat_assistant_messages BIGINT, stat_output_tokens BIGINT, stat_tool_calls BIGINT, "
    "stat_user_messages BIGINT, ckpt_api_call_count BIGINT, ckpt_output_tokens BIGINT, "
    "attr_agent_percentage DOUBLE, attr_total_committed BIGINT"
)

PRICES = columns(
    "model_pattern STRING, provider STRING, p_input DOUBLE, p_cache_read DOUBLE, "
    "p_cache_write_5m DOUBLE, p_cache_write_1h DOUBLE, p_output DOUBLE"
)

ERRORS = columns("session_id STRING, line_no INT, exception STRING")

CASES = columns(
    "session_id STRING, seq INT, k_before INT, k_after INT, stratum STRING, population_n BIGINT"
)

LABELS = columns(
    "session_id STRING, agent STRING, repo STRING, seq INT, label STRING, pushback BOOLEAN, "
    "sentiment STRING, language STRING, mentions_file BOOLEAN, model STRING, cost_usd DOUBLE"
)

LEDGER = {
    "calls": CALLS,
    "tool_calls": TOOL_CALLS,
    "user_turns": USER_TURNS,
    "events": EVENTS,
    "sessions": SESSIONS,
}


def conform(df: DataFrame, schema: StructType, keep_extra: bool = False) -> DataFrame:
    """Give ``df`` exactly the declared columns; absent ones become NULL."""
    present = set(df.columns)
    cols = [
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    if keep_extra:
        known = {f.name for f in schema.fields}
        cols += [F.col(c) for c in df.columns if c not in known]
    return df.select(*cols)
