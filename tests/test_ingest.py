"""Hand-written transcripts, one quirk each, against ledger rows worked out by hand."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tollbook.ingest import codex, opencode
from tollbook.ingest.build import build_ledger, ingest_totals
from tollbook.sources.catalog import missing_ids, plan_inputs, scan_catalog, skipped_agents
from tollbook.sources.ledger import scan_ledger, write_ledger


def lines(*records):
    return "\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in records) + "\n"


def said(seq_time, mid, content, usage=None, stop=None, **more):
    return {"type": "assistant", "timestamp": seq_time, "cwd": "/home/ann/app", "gitBranch": "main", "version": "2.1.0", "requestId": "r1",
            "message": {"id": mid, "model": "claude-opus-4-6", "role": "assistant", "content": content, "stop_reason": stop, "usage": usage or {}}, **more}


CLAUDE = lines(
    {"type": "user", "uuid": "u0", "timestamp": "2026-04-24T10:00:00.000Z", "message": {"role": "user", "content": "fix <system-reminder>be nice</system-reminder> it"}},
    said("2026-04-24T10:00:05.250Z", "m1", [{"type": "thinking", "thinking": "hmm"}], {"input_tokens": 10, "output_tokens": 1}),
    "",
    said("2026-04-24T10:00:06.000Z", "m1", [{"type": "text", "text": "Reading é"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "/home/ann/app/src/a.py", "offset": 3}}],
         {"input_tokens": 10, "output_tokens": 25, "cache_creation_input_tokens": 7, "cache_creation": {"ephemeral_5m_input_tokens": 4, "ephemeral_1h_input_tokens": 3}, "service_tier": "standard", "speed": "fast"}, "tool_use"),
    {"type": "user", "timestamp": "2026-04-24T10:00:07.500Z", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": [{"type": "text", "text": "File does not exist"}]}]}},
    "{broken",
    {"type": "user", "isMeta": True, "timestamp": "2026-04-24T10:00:08Z", "message": {"role": "user", "content": [{"type": "text", "text": "[Request interrupted by user]"}, {"type": "image", "source": "x"}]}},
    {"type": "system", "subtype": "compact_boundary", "compactMetadata": {"trigger": "auto"}, "content": "Compacted"},
    {"type": "permission-mode", "permissionMode": "default"},
    {"type": "user", "timestamp": "2026-04-24T10:00:09Z", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "nobody", "content": "x"}]}},
    said("2026-04-24T10:00:10Z", None, "plain string"),
    {"type": "user", "uuid": "u9", "timestamp": "2026-04-24T10:01:00Z", "message": {"role": "user", "content": "[1] /not a list"}},
    {"type": "file-history-snapshot", "snapshot": {"trackedFileBackups": {"a": 1, "b": 2}}},
)

PATCH = "*** Begin Patch\n*** Add File: src/new.py\n+x\n*** End Patch"
CODEX = lines(
    {"type": "session_meta", "timestamp": "2026-05-01T08:00:00Z", "payload": {"cwd": "/home/bob/x", "cli_version": "0.9.1", "model_provider": "openai", "base_instructions": {"text": "12345"}}},
    {"type": "turn_context", "timestamp": "2026-05-01T08:00:01Z", "payload": {"model": "gpt-5.4", "timezone": "Europe/Berlin", "approval_policy": "never", "sandbox_policy": {"type": "ro"}, "effort": "high"}},
    {"type": "event_msg", "timestamp": "2026-05-01T08:00:02Z", "payload": {"type": "user_message", "message": "do it"}},
    {"type": "response_item", "timestamp": "2026-05-01T08:00:03Z", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "do it"}]}},
    {"type": "response_item", "timestamp": "2026-05-01T08:00:03Z", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "do it"}]}},
    {"type": "response_item", "timestamp": "2026-05-01T08:00:04Z", "payload": {"type": "reasoning", "summary": [{"text": "abc"}]}},
    {"type": "response_item", "timestamp": "2026-05-01T08:00:05Z", "payload": {"type": "custom_tool_call", "call_id": "c1", "name": "apply_patch", "input": PATCH}},
    {"type": "response_item", "timestamp": "2026-05-01T08:00:06Z", "payload": {"type": "function_call", "call_id": "c2", "name": "shell", "arguments": json.dumps({"command": ["ls", "-l"]})}},
    {"type": "event_msg", "timestamp": "2026-05-01T08:00:07Z", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 100, "cached_input_tokens": 40, "output_tokens": 9}, "model_context_window": 1000}}},
    {"type": "response_item", "timestamp": "2026-05-01T08:00:08Z", "payload": {"type": "function_call_output", "call_id": "c2", "output": {"output": "boom", "success": False}}},
    {"type": "event_msg", "timestamp": "2026-05-01T08:00:08Z", "payload": {"type": "token_count", "info": None}},
    {"type": "response_item", "timestamp": "2026-05-01T08:00:09Z", "payload": {"type": "message", "role": "assistant", "content": [{"text": "Done"}]}},
    {"type": "event_msg", "timestamp": "2026-05-01T08:00:10Z", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 120, "output_tokens": 4}}}},
    {"type": "compacted"},
)
CODEX_OLD = lines(
    {"type": "response_item", "timestamp": "2026-05-01T08:00:09Z", "payload": {"type": "message", "role": "assistant", "content": "Hello"}},
    {"type": "turn_context", "payload": {"model": "gpt-5.3-codex"}},
)
OPENCODE = json.dumps({
    "info": {"version": "1.2.0", "directory": "/home/cy/p"},
    "messages": [
        {"info": {"id": "a", "role": "user", "time": {"created": 1777000000000}}, "parts": [{"type": "text", "text": "go"}, {"type": "file", "url": "f"}]},
        {"info": {"id": "b", "role": "assistant", "modelID": "glm-5", "time": {"created": 1777000001000}, "path": {"cwd": "/home/cy/p/sub", "root": "/home/cy/p"}}, "parts": [
            {"type": "step-start"}, {"type": "text", "text": "one"},
            {"type": "tool", "tool": "bash", "callID": "k1", "state": {"status": "error", "error": "Aborted by user", "input": "echo hi", "time": {"start": 1777000001000, "end": 1777000001500}}},
            {"type": "step-finish", "reason": "tool-calls", "tokens": {"input": 5, "output": 2, "reasoning": 1, "cache": {"read": 3, "write": 4}}},
            {"type": "tool", "tool": "read", "callID": "k2", "state": {"status": "completed", "output": "text", "input": {"filePath": "/home/cy/p/z.md"}}},
            {"type": "step-finish", "reason": "stop", "tokens": {"input": 6, "output": 3}},
            {"type": "text", "text": "tail"}, {"type": "retry", "n": 1}]},
        {"info": {"id": "c", "role": "assistant", "tokens": {"input": 7}, "finish": "stop", "time": {"created": 1777000002, "completed": 1777000003}}, "parts": []},
        {"note": "no info"},
    ]})
OPENCODE_LINES = lines({"info": {"id": "x", "role": "user"}, "parts": [{"type": "text", "text": "hey"}]}, "not json", "", {"info": {"id": "y", "role": "assistant"}, "parts": [{"type": "text", "text": "yo"}]})
CURSOR = lines(
    {"role": "user", "message": {"content": [{"type": "text", "text": "<user_query> sum it </user_query><open_files>z</open_files>"}, {"type": "weird"}]}},
    {"role": "assistant", "message": {"content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "name": "Shell", "input": {"command": "ls", "working_directory": "/w"}}, {"type": "tool_use", "name": "mcp__x", "input": {"path": "/w/a/b.py"}}]}},
    {"role": "assistant", "message": {"content": "bye"}},
    {"type": "turn_ended", "status": "ok"},
)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    files = {"s-claude": CLAUDE, "s-codex": CODEX, "s-old": CODEX_OLD, "s-open": OPENCODE, "s-lines": OPENCODE_LINES, "s-cursor": CURSOR}
    (root / "t").mkdir()
    for name, body in files.items():
        (root / "t" / f"{name}.jsonl").write_text(body, encoding="utf-8")
    agents = {"s-claude": "Claude Code", "s-codex": "Codex CLI", "s-old": "codex", "s-open": "OpenCode", "s-lines": "opencode", "s-cursor": "Cursor"}
    sessions = [{"session_id": f"meta-{n}", "agent": a, "trajectory": f"t/{n}.jsonl", "bytes": len(files[n]), "source": {"repository": "o/r"},
                 "files_touched": ["a", "b"], "models": ["m"], "statistics": {"tool_calls": 2}, "initial_attribution": {"agent_percentage": 99.0, "total_committed": 5}}
                for n, a in agents.items()]
    sessions.append({"agent": "aider", "trajectory": "t/none.jsonl"})
    (root / "sessions.json").write_text(json.dumps({"sessions": sessions}))
    ledger, errors = build_ledger(spark, str(root / "sessions.json"), str(root / "t"))
    out = str(root / "ledger")
    write_ledger(ledger, out)
    return scan_ledger(spark, out), errors, ledger, str(root)


def rows(df, session, *cols, order=("seq",)):
    return [tuple(r) for r in df.where(F.col("session_id") == session).orderBy(*order).select(*cols).collect()]


def test_claude_calls_merge_by_message_id(built):
    got = rows(built[0].calls, "s-claude", "seq", "msg_id", "input_tokens", "output_tokens", "cache_create_tokens", "cache_create_5m", "cache_create_1h",
               "stop_reason", "speed", "service_tier", "n_text_chars", "n_thinking_chars", "n_thinking_blocks", "n_tool_uses", "text_head", "is_sidechain")
    assert got == [
        (1, "m1", 10, 25, 7, 4, 3, "tool_use", "fast", "standard", 9, 3, 1, 1, "Reading é", False),
        (10, None, None, None, None, None, None, None, None, None, 0, 0, 0, 0, None, False),
    ]


def test_claude_tool_gets_its_result(built):
    text = "File does not exist"
    got = rows(built[0].tool_calls, "s-claude", "seq", "tool_use_id", "tool_kind", "file_path", "read_offset", "result_chars", "result_hash", "is_error",
               "error_head", "result_latency_ms", "is_interrupted")
    assert got == [(3, "t1", "read", "src/a.py", 3, len(text), hashlib.sha1(text.encode()).hexdigest(), True, text, 1500, False)]


def test_claude_turns_and_events(built):
    turns = rows(built[0].user_turns, "s-claude", "seq", "prompt_id", "chars", "human_chars", "is_meta", "is_interrupt", "has_system_reminder")
    assert turns == [(0, "u0", 49, 6, False, False, True), (6, None, 29, 0, True, True, False), (11, "u9", 15, 15, False, False, False)]
    events = rows(built[0].events, "s-claude", "seq", "event_type", "subtype", "value")
    assert events == [(6, "user_image", None, None), (7, "system", "compact_boundary", "auto"), (8, "permission-mode", None, "default"),
                      (12, "file-history-snapshot", None, "2")]


def test_codex_calls_are_closed_by_counters(built):
    got = rows(built[0].calls, "s-codex", "seq", "model", "timezone", "cwd", "harness_version", "input_tokens", "cache_read_tokens", "output_tokens",
               "n_text_chars", "n_thinking_chars", "n_tool_uses", "stop_reason", "text_head", "context_window")
    same = ("gpt-5.4", "Europe/Berlin", "/home/bob/x", "0.9.1")
    assert got == [(0, *same, 100, 40, 9, 0, 3, 2, "tool_use", None, 1000), (9, *same, 120, None, 4, 4, 0, 0, "end_turn", "Done", None)]


def test_codex_without_counters_falls_back_to_messages(built):
    assert rows(built[0].calls, "s-old", "seq", "model", "n_text_chars", "input_tokens", "text_head") == [(0, "gpt-5.3-codex", 5, None, "Hello")]


def test_codex_tools(built):
    got = rows(built[0].tool_calls, "s-codex", "seq", "tool_use_id", "tool_kind", "file_path", "command_head", "content_chars", "is_error", "result_chars")
    assert got == [(6, "c1", "write", "src/new.py", None, len(PATCH), None, None), (7, "c2", "bash", None, "ls -l", None, True, 4)]


def test_codex_echoes_are_dropped_once_per_message(built):
    assert rows(built[0].user_turns, "s-codex", "seq", "text") == [(2, "do it"), (4, "do it")]


def test_codex_events(built):
    got = rows(built[0].events, "s-codex", "seq", "event_type", "subtype", "value")
    assert got == [(0, "session_meta", "openai", "0.9.1"), (1, "turn_context", "ro", "model=gpt-5.4;approval=never;effort=high"),
                   (10, "event_msg", "token_count_norate", None), (13, "compacted", None, None)]
    assert rows(built[0].events, "s-codex", "payload_chars")[0] == (5,)


def test_opencode_steps(built):
    got = rows(built[0].calls, "s-open", "seq", "msg_id", "input_tokens", "output_tokens", "cache_read_tokens", "cache_create_tokens", "stop_reason", "n_text_chars",
               "n_tool_uses", "text_head", "harness_version", order=("seq", F.col("input_tokens").asc_nulls_last()))
    assert got == [(1, "b", 5, 2, 3, 4, "tool-calls", 3, 1, "one", "1.2.0"), (1, "b", 6, 3, None, None, "stop", 0, 1, None, "1.2.0"),
                   (1, "b", None, None, None, None, None, 4, 0, "tail", "1.2.0"), (2, "c", 7, None, None, None, "stop", 0, 0, None, "1.2.0")]
    times = rows(built[0].calls, "s-open", F.col("ts").cast("string"), order=("seq", "ts"))
    assert times[-1] == ("2026-04-24 03:06:43",)


def test_opencode_tools_and_events(built):
    got = rows(built[0].tool_calls, "s-open", "tool_use_id", "tool_kind", "command_head", "file_path", "is_error", "error_head", "is_interrupted", "result_latency_ms", "result_chars",
               order=("tool_use_id",))
    assert got == [("k1", "bash", "echo hi", None, True, "Aborted by user", True, 500, 15), ("k2", "read", None, "z.md", False, None, False, None, 4)]
    events = rows(built[0].events, "s-open", "seq", "event_type", "subtype")
    assert events == [(0, "part", "file"), (1, "part", "retry"), (3, "unparsed_message", None)]


def test_opencode_one_message_per_line(built):
    assert rows(built[0].user_turns, "s-lines", "seq", "text", "prompt_id") == [(0, "hey", "x")]
    assert rows(built[0].calls, "s-lines", "seq", "msg_id", "n_text_chars") == [(1, "y", 2)]


def test_cursor(built):
    assert rows(built[0].calls, "s-cursor", "seq", "n_text_chars", "n_tool_uses", "stop_reason", "ts") == [(1, 2, 2, "tool_use", None), (2, 3, 0, "end_turn", None)]
    assert rows(built[0].tool_calls, "s-cursor", "tool_kind", "command_head", "file_path", order=("tool_name",)) == [("bash", "ls", None), ("mcp", None, "/w/a/b.py")]
    assert rows(built[0].user_turns, "s-cursor", "human_chars", "is_meta") == [(6, False)]
    assert rows(built[0].events, "s-cursor", "seq", "event_type", "subtype", "value") == [(0, "user_block", "weird", None), (3, "turn_ended", None, "ok")]


def test_bad_lines_are_kept_aside(built):
    got = sorted((r.session_id, r.line_no) for r in built[1].collect())
    assert got == [("s-claude", 5), ("s-lines", 1)]


def test_catalog_and_plan(spark, built):
    sessions = scan_catalog(spark, built[3] + "/sessions.json")
    assert sessions.count() == 7
    assert [tuple(r) for r in skipped_agents(sessions).collect()] == [("aider", 1)]
    row = sessions.where("session_id = 's-open'").first()
    assert (row.agent, row.repo, row.n_files_touched, row.attr_total_committed, row.stat_tool_calls, row.models) == ("opencode", "o/r", 2, 5, 2, '["m"]')
    plan = plan_inputs(sessions, limit=2)
    sizes = [r.bytes for r in plan.collect()]
    assert len(sizes) == 2 and sizes[0] >= sizes[1]
    ids = spark.createDataFrame([("s-old",), ("gone",)], "session_id string")
    assert [r.session_id for r in plan_inputs(sessions, ids=ids).collect()] == ["s-old"]
    assert [r.session_id for r in missing_ids(sessions, ids).collect()] == ["gone"]


def test_totals(built):
    got = {r.agent: r.asDict() for r in ingest_totals(built[2], built[1]).collect()}
    assert got["claude_code"]["calls"] == 2 and got["claude_code"]["bad_lines"] == 1 and got["opencode"]["sessions"] == 2


def test_line_numbers_do_not_depend_on_splits(spark, built, tmp_path):
    from tollbook.sources.transcripts import scan_jsonl
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "long.jsonl").write_text("".join(f'{{"n": {i}}}\n' for i in range(3000)))
    plan = spark.createDataFrame([("long", "cursor", "r", "cursor")], "session_id string, agent string, repo string, fmt string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = scan_jsonl(spark, str(tmp_path / "f"), plan)
        assert got.where(F.col("line") != F.concat(F.lit('{"n": '), F.col("seq").cast("string"), F.lit("}"))).count() == 0
        assert got.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_records_that_look_whole_are_not_lost(spark):
    """Text after a value is an error, repeated keys and long strings are not, reasons differ."""
    from tollbook.sources import transcripts

    lines = ['{"a":1}', '{"a":1}{"b":2}', '{"a":1} more', '{"a":1},{"b":2}', '{"a":1,"a":2}', "junk", "5"]
    frame = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "session_id string, seq int, line string")
    long = frame.where("seq = 0").withColumn("seq", F.lit(99)).withColumn("line", F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), 24 << 20), F.lit('"}')))
    records, errors = transcripts.parse_records(frame.unionByName(long))
    found = {r.seq: r.a for r in records.select("seq", F.length(F.try_variant_get("v", "$.a", "string")).alias("a")).collect()}
    assert found == {0: 1, 4: 1, 6: None, 99: 24 << 20}
    assert {r.line_no for r in errors.collect()} == {1, 2, 3, 5}
    kept = records.where("seq = 4").select(F.try_variant_get("v", "$.a", "int").alias("a")).collect()
    assert kept[0].a == 2


def test_a_record_that_is_too_large_gets_its_own_reason(spark, monkeypatch):
    from tollbook.sources import transcripts

    monkeypatch.setattr(transcripts, "RECORD_BYTES", 20)
    frame = spark.createDataFrame([("s", 0, '{"a":"' + "x" * 40 + '"}'), ("s", 1, '{"a":1}'), ("s", 2, "junk")], "session_id string, seq int, line string")
    _, errors = transcripts.parse_records(frame)
    assert {r.line_no: "too large" in r.exception for r in errors.collect()} == {0: True, 2: False}


def test_one_large_message_does_not_take_the_others_with_it(spark, monkeypatch):
    from tollbook.sources import transcripts

    head = {"info": {"version": "9", "directory": "/d"}, "messages": [{"info": {"id": str(i)}, "parts": []} for i in range(3)]}
    head["messages"][1]["parts"] = [{"type": "text", "text": "y" * (24 << 20)}]
    frame = spark.createDataFrame([("s", "opencode", "r", "opencode", json.dumps(head, indent=1))], "session_id string, agent string, repo string, fmt string, blob string")
    messages, errors = transcripts.document_messages(frame)
    got = messages.select("seq", "version", F.length(F.try_variant_get("v", "$.parts[0].text", "string")).alias("n")).collect()
    assert sorted((r.seq, r.version, r.n) for r in got) == [(0, "9", None), (1, "9", 24 << 20), (2, "9", None)] and errors.count() == 0
    monkeypatch.setattr(transcripts, "RECORD_BYTES", 1000)
    messages, errors = transcripts.document_messages(frame)
    assert sorted(r.seq for r in messages.select("seq").collect()) == [0, 2]
    assert [(r.line_no, "too large" in r.exception) for r in errors.collect()] == [(1, True)]


def test_only_lines_that_can_matter_are_parsed(spark):
    from tollbook.ingest import texts

    body = [
        ("s", 0, '{"type":"assistant","message":{"id":"m1","content":[{"type":"tool_use","id":"t1"}]}}'), ("s", 1, '{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id" : "t1","content":"yes"}]}}'),
        ("s", 2, '{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"t2","content":"t1"}]}}'), ("s", 3, '{"id":"t\\u0031","x":1}'), ("s", 4, "no record at all"), ("r", 1, '{"id":"t1"}'), ("s", 5, '{"text":"id t1"}')]
    lines = spark.createDataFrame([(*b[:2], "claude_code", "r", "claude_code", b[2]) for b in body], "session_id string, seq int, agent string, repo string, fmt string, line string")
    sampled = spark.createDataFrame([("s", 0, "t1", None)], "session_id string, seq int, tool_use_id string, msg_id string")
    kept = texts.lines_that_matter(lines, sampled)
    assert sorted((r.session_id, r.seq) for r in kept.collect()) == [("s", 0), ("s", 1), ("s", 3)]
    none = spark.createDataFrame([], "session_id string, seq int, v variant")
    found = texts.records_that_matter(lines, sampled)
    assert [r.text for r in texts.result_texts(sampled, found, none).collect()] == ["yes"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("from_json") < plan.index("regexp_extract_all")  # plans are read from below: the ids are met first


@pytest.mark.parametrize("harness, joins", [(codex, 2), (opencode, 0)])
def test_prompts_do_not_wait_for_a_state_they_do_not_use(spark, harness, joins):
    """Each running value is a join; codex has one to count echoes and one to look up what accounts for them."""
    names = ["session_id", "agent", "repo", "fmt", "version", "directory"]
    records = spark.range(1).select(*[F.lit("x").alias(n) for n in names], F.col("id").cast("int").alias("seq"), F.parse_json(F.format_string('{"a": %d}', "id")).alias("v"))
    assert harness.parse(records).user_turns._jdf.queryExecution().optimizedPlan().toString().count("Join ") == joins
