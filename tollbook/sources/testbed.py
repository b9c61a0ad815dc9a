"""A ledger derived from the plain driver tables, for tests, checks and the bench.

The projections are written once as SQL that Spark and any ANSI engine run unchanged, so
an independent engine can rebuild the very same ledger.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from tollbook.operators.numbering import numbered
from tollbook.schemas import LEDGER, conform
from tollbook.sources.ledger import Ledger

ROWS = """
SELECT event_id, ts, user_id, event_type, value,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
       concat('u', CAST(user_id AS STRING)) AS session_id,
       CASE user_id % 4 WHEN 0 THEN 'claude_code' WHEN 1 THEN 'codex' WHEN 2 THEN 'opencode' ELSE 'cursor' END AS agent,
       concat('repo', CAST(user_id % 10 AS STRING)) AS repo
FROM {source}
"""

CALLS = """
SELECT session_id, agent, repo, CAST(event_id AS INT) AS seq,
       CASE WHEN agent <> 'cursor' THEN ts END AS ts, concat('m', CAST(event_id AS STRING)) AS msg_id,
       k % 23 = 0 AS is_sidechain,
       CASE WHEN agent = 'cursor' OR k % 7 = 6 THEN NULL
            WHEN k % 7 = 0 THEN 'claude-opus-4-6' WHEN k % 7 = 1 THEN 'anthropic/claude-sonnet-4.6'
            WHEN k % 7 = 2 THEN 'gpt-5.4-mini' WHEN k % 7 = 3 THEN 'openai/gpt-5.4'
            WHEN k % 7 = 4 THEN 'claude-haiku-4-5-20251001' ELSE 'glm-5' END AS model,
       concat('2.', CAST(k % 3 AS STRING), '.', CAST(k % 12 AS STRING)) AS harness_version,
       CASE WHEN k % 10 = 0 THEN 'max_tokens' WHEN k % 10 < 5 THEN 'end_turn' ELSE 'tool_use' END AS stop_reason,
       CASE WHEN k % 11 = 0 THEN 'fast' WHEN k % 11 > 1 THEN 'standard' END AS speed,
       CASE WHEN agent <> 'cursor' THEN CAST(floor(value * 100) AS BIGINT) END AS input_tokens,
       CASE WHEN agent <> 'cursor' THEN CAST(floor(value * 80) AS BIGINT) END AS cache_read_tokens,
       CASE WHEN agent = 'claude_code' THEN CAST(k * 50 AS BIGINT) END AS cache_create_tokens,
       CASE WHEN agent = 'claude_code' AND k % 2 = 0 THEN CAST(k * 20 AS BIGINT) END AS cache_create_5m,
       CASE WHEN agent = 'claude_code' AND k % 2 = 0 THEN CAST(k * 30 AS BIGINT) END AS cache_create_1h,
       CASE WHEN agent <> 'cursor' THEN CAST(k * 13 AS BIGINT) END AS output_tokens,
       CAST(k * 17 AS BIGINT) AS n_text_chars, concat('head ', CAST(k AS STRING)) AS text_head,
       concat('/home/dev', CAST(user_id % 6 AS STRING), '/', repo) AS cwd,
       CASE WHEN agent = 'codex' THEN CASE user_id % 3 WHEN 0 THEN 'Europe/Berlin' WHEN 1 THEN 'America/New_York' ELSE 'Asia/Tokyo' END END AS timezone
FROM {rows} WHERE event_type = 'purchase'
"""

TOOL_CALLS = """
SELECT session_id, agent, repo, CAST(event_id AS INT) AS seq, ts, concat('t', CAST(event_id AS STRING)) AS tool_use_id, tool_kind,
       CASE WHEN tool_kind IN ('read','edit','write') THEN concat('src/f', CAST(k % 12 AS STRING), '.py') END AS file_path,
       CASE WHEN tool_kind = 'bash' THEN CASE k % 5 WHEN 0 THEN 'sleep 30' WHEN 1 THEN 'git status' WHEN 2 THEN 'gh run watch' WHEN 3 THEN 'make; sleep 5' ELSE 'ls' END END AS command_head,
       CAST(k * 31 + 40 AS BIGINT) AS input_chars,
       CASE WHEN tool_kind = 'edit' THEN CAST(k * 25 AS BIGINT) END AS old_string_chars,
       CASE WHEN tool_kind = 'edit' THEN CAST(k * 11 AS BIGINT) END AS new_string_chars,
       CASE WHEN tool_kind = 'write' THEN CAST(k * 29 AS BIGINT) END AS content_chars,
       CASE WHEN agent <> 'cursor' THEN CAST(floor(value * 200) AS BIGINT) END AS result_chars,
       CASE WHEN agent <> 'cursor' THEN sha1(concat(tool_kind, CAST(k % 4 AS STRING))) END AS result_hash,
       CASE WHEN agent <> 'cursor' THEN k % 5 = 0 END AS is_error,
       CASE WHEN agent <> 'cursor' AND k % 5 = 0 THEN CASE WHEN k % 2 = 0 THEN 'File does not exist' ELSE 'exit 1' END END AS error_head
FROM (SELECT *, CASE WHEN event_type = 'view' THEN 'read' WHEN event_type = 'error' THEN 'bash'
                     WHEN k % 4 = 0 THEN 'write' WHEN k % 4 = 1 THEN 'edit' WHEN k % 4 = 2 THEN 'task' ELSE 'todo' END AS tool_kind
      FROM {rows} WHERE event_type IN ('view','click','error')) x
"""

USER_TURNS = """
SELECT session_id, agent, repo, CAST(event_id AS INT) AS seq, CASE WHEN agent <> 'cursor' THEN ts END AS ts,
       CAST(k * 4 AS BIGINT) AS chars, CASE WHEN k % 9 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(k * 3 AS BIGINT) END AS human_chars,
       k % 9 = 0 AS is_meta, k % 9 = 0 AND k % 2 = 0 AS is_interrupt
FROM {rows} WHERE event_type = 'signup'
"""

EVENTS = """
SELECT session_id, agent, repo, CAST(event_id AS INT) AS seq, ts,
       CASE k % 6 WHEN 0 THEN CASE WHEN agent = 'codex' THEN 'compacted' ELSE 'system' END WHEN 1 THEN 'attachment' WHEN 2 THEN 'permission-mode' ELSE 'queue-operation' END AS event_type,
       CASE WHEN k % 6 = 0 AND agent <> 'codex' THEN 'compact_boundary' WHEN k % 6 = 1 THEN 'hook_success' END AS subtype,
       CASE WHEN k % 6 = 2 THEN CASE k % 4 WHEN 0 THEN 'default' ELSE 'bypassPermissions' END END AS value,
       CAST(k * 7 AS BIGINT) AS payload_chars
FROM {rows} WHERE event_type = 'signup' AND k % 6 < 4
"""

SESSIONS = """
SELECT session_id, agent, repo,
       CASE WHEN user_id % 13 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 99.0E0 WHEN user_id % 3 = 1 THEN 2.0E0 ELSE 50.0E0 END AS attr_agent_percentage,
       CASE WHEN user_id % 13 = 0 THEN NULL WHEN user_id % 7 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(user_id * 3 AS BIGINT) END AS attr_total_committed,
       CAST(user_id % 17 AS BIGINT) AS stat_assistant_messages, CAST(user_id % 23 * 500 AS BIGINT) AS stat_output_tokens,
       CAST(user_id % 61 AS BIGINT) AS stat_tool_calls, CAST(user_id % 19 AS BIGINT) AS stat_user_messages,
       CAST(user_id % 16 AS BIGINT) AS ckpt_api_call_count, CAST(user_id % 29 * 400 AS BIGINT) AS ckpt_output_tokens
FROM (SELECT DISTINCT session_id, agent, repo, user_id FROM {rows}) s
"""

TABLE_SQL = {
    "calls": CALLS,
    "tool_calls": TOOL_CALLS,
    "user_turns": USER_TURNS,
    "events": EVENTS,
    "sessions": SESSIONS,
}


def ledger_from_events(events: DataFrame) -> Ledger:
    """Adapter: the driver's ``events`` table read as a ledger."""
    spark: SparkSession = events.sparkSession
    rows = spark.sql(ROWS.format(source="{source}"), source=events)
    frames = {
        name: conform(spark.sql(text, rows=rows), LEDGER[name]) for name, text in TABLE_SQL.items()
    }
    return Ledger(**frames)


# ---------------------------------------------------------------- conversations as transcripts


def conversation_lines(conversations: DataFrame, fmt: str) -> DataFrame:
    """Conversations written as raw lines of one harness: session columns, seq, line."""
    c = conversations.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), F.lit(fmt).alias("agent"), F.lit("talk").alias("repo"),
        F.lit(fmt).alias("fmt"), F.col("turn").cast("int").alias("turn"), "role", "text")
    user, said = F.col("role") == "user", F.col("role") == "assistant"
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    if fmt == "cursor":
        lines = F.array(F.to_json(F.struct("role", F.struct(block.alias("content")).alias("message"))))
    elif fmt == "claude_code":
        asked = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(F.col("text").alias("content")).alias("message")))
        usage = F.struct(F.length("text").alias("output_tokens"))
        reply = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(
            F.concat(F.lit("m"), F.col("turn").cast("string")).alias("id"), F.lit("claude-opus-4-6").alias("model"), block.alias("content"),
            usage.alias("usage")).alias("message")))
        rest = F.to_json(F.struct(F.lit("system").alias("type"), F.lit("note").alias("subtype"), F.col("text").alias("content")))
        lines = F.array(F.when(user, asked).when(said, reply).otherwise(rest))
    else:
        asked = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("user_message").alias("type"), F.col("text").alias("message")).alias("payload")))
        message = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), "role", block.alias("content")).alias("payload")))
        count = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), F.struct(
            F.struct(F.length("text").alias("output_tokens")).alias("last_token_usage")).alias("info")).alias("payload")))
        lines = F.when(user, F.array(asked, message)).when(said, F.array(message, count)).otherwise(F.array(message, F.lit("{}")))
    width = 2 if fmt == "codex" else 1
    return c.select("session_id", "agent", "repo", "fmt", "turn", F.posexplode(lines).alias("_i", "line")).select(
        "session_id", "agent", "repo", "fmt", (F.col("turn") * width + F.col("_i")).cast("int").alias("seq"), "line")


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as messages of the document harness."""
    info = F.struct(F.concat(F.lit("m"), F.col("turn").cast("string")).alias("id"), "role", F.struct((F.col("turn") + 1777000000).alias("created")).alias("time"))
    part = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    return conversations.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), F.lit("opencode").alias("agent"), F.lit("talk").alias("repo"),
        F.lit("opencode").alias("fmt"), F.lit("1.0").alias("version"), F.lit(None).cast("string").alias("directory"),
        F.col("turn").cast("int").alias("seq"), F.parse_json(F.to_json(F.struct(info.alias("info"), part.alias("parts")))).alias("v"))


def conversation_tools(conversations: DataFrame) -> DataFrame:
    """Replies of conversations as tool calls of claude_code, each with its result in the record
    after it: reads, edits, commands and foreign tools in turn, every third result an error."""
    c = conversations.where("role = 'assistant'").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), F.lit("claude_code").alias("agent"), F.lit("talk").alias("repo"),
        F.lit("claude_code").alias("fmt"), F.col("turn").cast("int").alias("turn"), "text")
    n, word = F.col("turn") % 4, F.col("turn").cast("string")
    clock = F.concat(F.lit("2026-01-01T00:00:"), F.lpad(word, 2, "0"))
    path = F.concat(F.lit("/w/src/a"), word, F.lit(".py"))
    inputs = (F.when(n == 0, F.to_json(F.struct(path.alias("file_path"), F.col("turn").alias("offset"), F.lit(20).alias("limit"))))
              .when(n == 1, F.to_json(F.struct(path.alias("file_path"), F.col("text").alias("old_string"), F.lit("x").alias("new_string"))))
              .when(n == 2, F.to_json(F.struct(F.col("text").alias("command")))).otherwise(F.lit("{}")))
    name = F.element_at(F.array(*[F.lit(x) for x in ("Read", "Edit", "Bash", "mcp__a__b")]), (n + 1).cast("int"))
    used = F.concat(F.lit('{"type":"assistant","timestamp":"'), clock, F.lit('.000Z","cwd":"/w","message":{"id":"m'), word, F.lit('","content":[{"type":"tool_use","id":"t'), word,
                    F.lit('","name":"'), name, F.lit('","input":'), inputs, F.lit("}]}}"))
    got = F.to_json(F.struct(F.lit("user").alias("type"), F.concat(clock, F.lit(".250Z")).alias("timestamp"), F.struct(F.array(F.struct(
        F.lit("tool_result").alias("type"), F.concat(F.lit("t"), word).alias("tool_use_id"), F.col("text").alias("content"), (F.col("turn") % 3 == 0).alias("is_error"))).alias("content")).alias("message")))
    return c.select("session_id", "agent", "repo", "fmt", "turn", F.posexplode(F.array(used, got)).alias("_i", "line")).select(
        "session_id", "agent", "repo", "fmt", (F.col("turn") * 2 + F.col("_i")).cast("int").alias("seq"), "line")


def broken_lines(conversations: DataFrame) -> DataFrame:
    """Lines of which some only look like records: text after a value, two values, repeated keys."""
    text = F.concat(F.lit('{"a":'), F.col("turn").cast("string"), F.lit("}"))
    kind = F.col("turn") % 5
    line = (F.when(kind == 0, F.concat(text, text)).when(kind == 1, F.concat(text, F.lit(" more"))).when(kind == 2, F.concat(F.lit('{"a":0,"a":'), F.col("turn").cast("string"), F.lit("}")))
            .when(kind == 3, F.lit("{oops")).otherwise(text))
    return conversations.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), F.col("turn").cast("int").alias("seq"), line.alias("line"))


# ---------------------------------------------------------------- conversations as files

FILE_SESSIONS = 25  # conversations are dealt to so many sessions: 0-19 are good ones, each harness in turn
ABSENT, EMPTY, FOREIGN, STRAY = (20, 21), 22, 23, 24  # without a file, with an empty one, of an unknown agent, a file without a session
HARNESSES = ["claude_code", "codex", "cursor", "opencode"]


def filed_conversations(conversations: DataFrame) -> DataFrame:
    """Conversations with the session that files them as ``conv_id`` and their place in it as ``turn``."""
    ordered = numbered(conversations.where("conv_id IS NOT NULL").withColumn("_of", F.pmod("conv_id", F.lit(FILE_SESSIONS))).select("_of", "conv_id", "turn", "role", "text"), ["_of", "conv_id", "turn", "role", "text"])
    first = ordered.groupBy("_of").agg(F.min("row_no").alias("_first"))  # one row per session
    return ordered.join(F.broadcast(first), "_of").select(F.col("_of").alias("conv_id"), (F.col("row_no") - F.col("_first")).cast("int").alias("turn"), "role", "text")


def write_transcripts(spark: SparkSession, conversations: DataFrame, folder: str) -> tuple[str, str]:
    """Write conversations as one transcript file per session below ``folder``; (catalog file, folder of transcripts)."""
    filed = filed_conversations(conversations)
    of = lambda fmt: filed.where((F.col("conv_id") % 4 == HARNESSES.index(fmt)) & ~F.col("conv_id").isin(*ABSENT, EMPTY))
    lines = [conversation_lines(of(fmt), fmt).select("session_id", "seq", "line") for fmt in HARNESSES[:3]]
    documents = conversation_messages(of("opencode")).select("session_id", "seq", F.to_json("v").alias("line"))
    last = documents.groupBy("session_id").agg(F.max("seq").alias("_last"))
    body = documents.join(F.broadcast(last), "session_id").select("session_id", "seq", F.concat("line", F.when(F.col("seq") < F.col("_last"), ",").otherwise("")).alias("line"))
    frame = lambda at, text: last.select("session_id", F.lit(at).alias("seq"), F.lit(text).alias("line"))
    lines += [body, frame(-1, '{"info": {"version": "1.0", "directory": "/w"}, "messages": ['), frame(2**31 - 1, "]}")]
    every = lines[0]
    for more in lines[1:]:
        every = every.unionByName(more)
    parts = f"{folder}/parts"
    every.repartition("session_id").sortWithinPartitions("session_id", "seq").select("session_id", "line").write.partitionBy("session_id").text(parts)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{folder}/t"))
    for status in fs.globStatus(path(f"{parts}/session_id=*/part-*")):  # one file per session
        name = status.getPath().getParent().getName().split("=")[1]
        fs.rename(status.getPath(), path(f"{folder}/t/{name}.jsonl"))
    fs.create(path(f"{folder}/t/c{EMPTY}.jsonl")).close()
    listed = [{"agent": "aider" if n == FOREIGN else HARNESSES[n % 4], "trajectory": f"t/c{n}.jsonl", "source": {"repository": "talk"}} for n in range(FILE_SESSIONS) if n != STRAY]
    spark.createDataFrame([(json.dumps({"sessions": listed}),)], "line string").coalesce(1).write.text(f"{folder}/catalog")
    return f"{folder}/catalog", f"{folder}/t"
