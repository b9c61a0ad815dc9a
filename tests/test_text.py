"""Column functions on awkward values."""

import json
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tollbook.functions import clock, coercion, measures, metrics, models, prompts, tools, variants
from tollbook.functions.agents import normalize_agent
from tollbook.plans import labels as lab, probes, verdicts


def each(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_human_text(spark):
    got = each(spark, [
        "a <system-reminder x=1>long\ntext</system-reminder> b", "<user_query> one </user_query> x <user_query>two</user_query>",
        "[Request interrupted by user for tool use]", "<timestamp> open", "  many\n\n  lines ", None, "<b>kept</b>"], prompts.human_text)
    assert got == ["a b", "one\ntwo", "", "open", "many lines", "", "<b>kept</b>"]


def test_human_lines_keep_breaks(spark):
    assert each(spark, ["a  b\n\n\n\nc\n", "<git_diff>x</git_diff>y"], prompts.human_lines) == ["a b\n\nc", "y"]


def test_slash_commands(spark):
    got = each(spark, ["/clear", "//note", " /x", "a /x", "<command-name>c"], lambda x: prompts.prompt_columns(x)["is_slash_command"])
    assert got == [True, False, True, False, True]


def test_tool_kinds(spark):
    got = each(spark, ["Read", " MultiEdit ", "mcp__srv__go", "mcp_tool", "CallMcpTool", "Exec_Command", "TodoWrite", "unheard", None, ""], tools.tool_kind)
    assert got == ["read", "edit", "mcp", "mcp", "mcp", "bash", "todo", "other", "other", "other"]


@pytest.mark.parametrize("raw,bases,want", [
    ("/r/a.py", ["/r"], "a.py"), ("/root/a", ["/r"], "/root/a"), ("/r", ["/r"], "."), ("/r/", ["/r"], "."), ("/r/s/a", ["/r/s", "/r"], "a"),
    ("/r/a", ["", "/r"], "a"), ("rel", ["/r"], "rel"), (None, ["/r"], None)])
def test_rel_path(spark, raw, bases, want):
    assert each(spark, [raw], lambda x: tools.rel_path(x, [F.lit(b) for b in bases])) == [want]


def test_result_text(spark):
    values = ['"plain"', '[{"type":"text","text":"a"},{"type":"text"},"b",{"type":"image","n":1}]', "null", '{"k":1}', '"[1]"']
    assert each(spark, values, lambda x: tools.result_text(variants.node(F.parse_json(F.concat(F.lit('{"v":'), x, F.lit("}"))), "v"))) == [
        "plain", 'ab{"n":1,"type":"image"}', "", '{"k":1}', "[1]"]


def test_payload_sizes(spark):
    got = each(spark, ['"é"', '{"a":"é"}', "null", "[]", '{ "b" : 1 }'], lambda x: variants.size_of(F.parse_json(x)))
    assert got == [1, len('{"a":"é"}'.encode()), 0, 2, 7]


def test_times(spark):
    got = each(spark, ["2026-04-24T21:13:53.677Z", "2026-04-24 21:13:53", "2026-04-24T21:13:53.1234567+02:00", "2026-13-24T21:13:53", "short", None], clock.iso_time)
    assert got == [datetime(2026, 4, 24, 21, 13, 53, 677000), datetime(2026, 4, 24, 21, 13, 53), datetime(2026, 4, 24, 21, 13, 53, 123456), None, None, None]
    got = each(spark, ["1777000000000", "1777000000", "0", "-5", "x", None], clock.epoch_time)
    assert got[0] == got[1] == datetime(2026, 4, 24, 3, 6, 40) and got[2:] == [None] * 4


def test_models(spark):
    assert each(spark, ["anthropic/Claude-Sonnet-4.6", "openai/gpt-5.4", "a/b/c", None], models.norm_model) == ["claude-sonnet-4-6", "gpt-5.4", "c", None]
    assert each(spark, ["claude-opus-4-6", "gpt-5.3-codex", "glm-5", None], models.model_family) == ["opus", "gpt-5.3-codex", "other", "unknown"]
    assert each(spark, ["Claude Code", " codex CLI", "aider", None], normalize_agent) == ["claude_code", "codex", None, None]


def test_longest_pattern_wins(ws):
    got = {r.model: r.p_input for r in ws.model_prices.collect()}
    assert got["gpt-5.4-mini"] == 0.75 and got["openai/gpt-5.4"] == 2.5 and "glm-5" not in got


def test_version_keys_sort_by_number(spark):
    assert each(spark, ["2.10.0-beta", "2.9", "x.1", None], metrics.version_key) == [[2, 10, 0], [2, 9], [None, 1], None]


def test_ratios_of_nothing_are_null(spark):
    assert each(spark, [0, 4, None], lambda x: metrics.pct(F.lit(1), x), "int") == [None, 25.0, None]
    assert each(spark, [0.5, 1.0, None], lambda x: metrics.bands(x, [(1, "low")], "high"), "double") == ["low", "high", "high"]


def test_numbered_listings(spark):
    plain = "one\ntwo 3: x\nthree"
    image = '[{"type":"image","data":"' + "A" * 2500 + '"}]'
    got = each(spark, ["1\ta\n2\tb\n\n", "  10→x\n  11→y", "1: a\nfree\nfree\n", "1| a\n2| b", plain, image, ""],
               lambda x: F.struct(*[c.alias(n) for n, c in measures.numbered_listing(x).items()]))
    assert [(r.style, r.n_prefixed_lines, r.prefix_chars, r.n_lines) for r in got] == [
        ("tab", 2, 4, 4), ("arrow", 2, 10, 2), ("none", 0, 0, 4), ("pipe", 2, 6, 2), ("none", 0, 0, 3), ("image_base64", 0, 0, 1), ("none", 0, 0, 1)]


def test_reply_structure(spark):
    text = "# Plan\n- a\n1) b\n**Recap:**\nx\n```\n# no\n- no\n```\n## Other\nlast"
    got = each(spark, [text, ""], lambda x: measures.reply_structure(x))
    assert (got[0].headers, got[0].bullets, got[0].fence_lines) == (3, 2, 2)
    assert got[0].summary_chars == len("x\n```\n# no\n- no\n```\n") and got[0].header_chars == len("# Plan\n**Recap:**\n## Other\n")
    assert got[1].headers == 0


def test_written_input(spark):
    inp = {"file_path": "src/a.TSX", "content": "a\n\t b\"\n", "edits": [{"new_text": "é"}], "n": 5}
    df = spark.createDataFrame([(json.dumps(inp, ensure_ascii=False), "src/a.TSX")], "j string, file_path string").withColumn("inp", F.parse_json("j"))
    r = probes.measure_write(df).first()
    body = json.dumps(inp, ensure_ascii=False, separators=(",", ":")).encode()
    assert (r.ext, r.json_bytes, r.string_leaf_chars, r.content_chars) == ("tsx", len(body), 9 + 7 + 1, 7)
    assert (r.n_newlines, r.n_quotes, r.indent_chars) == (2, 1, 2)


def test_compression_ratio(spark):
    text = "the same line\n" * 400
    df = spark.createDataFrame([(text,), ("ü",), ("",)], "text string")
    got = {r.result_chars: r for r in probes.measure_bash(df).collect()}
    assert len(got) == 2 and got[len(text)].gzip_bytes == len(zlib.compress(text.encode(), 6)) and got[len(text)].bucket == ">=20"


def outcome(spark, values, rule):
    got = each(spark, values, lambda x: rule(F.try_variant_get(F.parse_json(x), "$.v", "variant")))
    return [(r.value, r.coerced, r.invalid) for r in got]


def test_coercion(spark):
    def v(*xs):
        return [f'{{"v":{x}}}' for x in xs] + ["{}"]
    assert outcome(spark, v('"a"', '" B "', '"c"', "1", "null"), lambda x: coercion.coerce_enum(x, ["a", "b"], "a")) == [
        ("a", False, False), ("b", True, False), ("a", False, True), ("a", False, True), ("a", False, True), ("a", False, True)]
    assert outcome(spark, v("true", '" YES"', '"no"', "0", "null"), coercion.coerce_flag) == [
        (True, False, False), (True, True, False), (False, True, False), (False, True, False), (False, False, True), (False, False, True)]
    assert outcome(spark, v('"en"', '"PL"', '"en-US"', '"eng"', '"1x"'), coercion.coerce_language) == [
        ("en", False, False), ("pl", True, False), ("en", True, False), ("unknown", False, True), ("unknown", False, True), ("unknown", False, True)]
    assert outcome(spark, v("3", '"4.9"', "true", '"x"'), coercion.coerce_integer) == [
        (3, False, False), (4, True, False), (1, True, False), (None, False, True), (None, False, True)]
    assert outcome(spark, v('"s"', "5", "null"), lambda x: coercion.coerce_text(x, "d")) == [
        ("s", False, False), ("5", True, False), ("d", False, True), ("d", False, True)]


def test_clip(spark):
    assert each(spark, ["abcdefghij", "abc"], lambda x: verdicts.clip(x, 4, 2)) == ["abcd\n... 4 chars omitted ...\nij", "abc"]


def test_wilson_holds_the_rate(spark):
    df = spark.createDataFrame([(0, 10), (3, 10), (10, 10)], "h int, n int")
    low, high = verdicts.wilson(F.col("h"), F.col("n"))
    got = df.select("h", low.alias("low"), high.alias("high")).collect()
    assert all(0 <= r.low <= r.h / 10 <= r.high <= 1 for r in got)
    assert (got[1].low, got[1].high) == (pytest.approx(0.10779, abs=1e-4), pytest.approx(0.60322, abs=1e-4))


def test_last_tools_look_back_forty_rows(spark, ws):
    prompts_df = spark.createDataFrame([("s", "codex", "r", 100, "now")], "session_id string, agent string, repo string, seq int, text string")
    rows = [("s", i, f"t{i}", f"tool{i}" if i in (50, 98) else None) for i in range(40, 100)]
    tools_df = spark.createDataFrame(rows, "session_id string, seq int, tool_use_id string, tool_name string")
    calls = spark.createDataFrame([("s", 99, "m", "before"), ("s", 100, "m2", "same record")], "session_id string, seq int, msg_id string, text_head string")
    got = lab.prompt_context(ws, prompts_df, tools_df, calls).first()
    assert (got.prev_tools, got.prev_text) == (["tool98"], "before")


def test_cases_from_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("session_id,seq,k_before,stratum,file_path\na,3.0,,x,f.py\nb,oops,1,y,\nc,4,2,,\n")
    got = {r.session_id: r for r in verdicts.read_cases(spark, str(tmp_path / "c.csv"), "hot_file_cause").collect()}
    assert set(got) == {"a", "c"}
    assert (got["a"].seq, got["a"].k_before, got["a"].k_after, got["a"].facts) == (3, 10, 10, {"file_path": "f.py"}) and got["c"].stratum is None


def test_raw_texts_of_sampled_rows(spark):
    from tests import test_ingest as raw
    from tollbook.ingest.texts import reply_texts, result_texts, tool_inputs
    from tollbook.sources.transcripts import parse_records
    lines = [("s", f, "r", f, i, x) for f, body in (("claude_code", raw.CLAUDE), ("codex", raw.CODEX)) for i, x in enumerate(body.split("\n")) if x.strip()]
    lines = [(f"s-{f}", f, r, f, i, x) for _, f, r, _, i, x in lines]
    records, _ = parse_records(spark.createDataFrame(lines, "session_id string, agent string, repo string, fmt string, seq int, line string"))
    messages = spark.createDataFrame([("s-open", 1, raw.OPENCODE)], "session_id string, seq int, j string").select(
        "session_id", "seq", F.try_variant_get(F.parse_json("j"), "$.messages[1]", "variant").alias("v"))
    asked = spark.createDataFrame([("s-claude_code", 3, "t1"), ("s-codex", 7, "c2"), ("s-open", 1, "k2"), ("s-codex", 6, "c1")], "session_id string, seq int, tool_use_id string")
    got = {r.tool_use_id: r.text for r in result_texts(asked, records, messages).collect()}
    assert got == {"t1": "File does not exist", "c2": "boom", "k2": "text"}
    inputs = {r.tool_use_id: r.j for r in tool_inputs(asked, records).withColumn("j", F.to_json("inp")).collect()}
    assert json.loads(inputs["t1"])["offset"] == 3 and json.loads(inputs["c2"]) == {"command": ["ls", "-l"]}
    replies = spark.createDataFrame([("s-claude_code", 1, "m1")], "session_id string, seq int, msg_id string")
    assert reply_texts(replies, records, messages).first().text == "Reading é"


def test_tool_inputs_of_messages(spark):
    from tollbook.ingest.texts import tool_inputs
    part = lambda i, given, **more: {"type": "tool", "tool": "write", "callID": i, "state": {"input": given}, **more}
    message = {"parts": [{"type": "text", "text": "k1"}, part("k1", {"filePath": "/a", "content": "é"}, filePath="/b"), part("k1", {"content": "second"}), part("k2", "echo hi"), part("k3", '{"a": 1}', filePath='/q"x'),
                         part("k4", None, filePath="/c"), part("", {"z": 2}, id="k5"), part("k6", {"filePath": "", "n": 1}, filePath="/d")]}
    messages = spark.createDataFrame([("s", 1, json.dumps(message))], "session_id string, seq int, j string").select("session_id", "seq", F.parse_json("j").alias("v"))
    records = messages.limit(0).withColumn("fmt", F.lit("codex"))
    asked = spark.createDataFrame([("s", 1, f"k{i}") for i in range(1, 8)], "session_id string, seq int, tool_use_id string")
    got = {r.tool_use_id: json.loads(r.j) for r in tool_inputs(asked, records, messages).withColumn("j", F.to_json("inp")).collect()}
    assert got == {"k1": {"filePath": "/a", "content": "é"}, "k2": {"command": "echo hi"}, "k3": {"a": 1, "filePath": '/q"x'}, "k4": {"filePath": "/c"}, "k5": {"z": 2}, "k6": {"filePath": "/d", "n": 1}}


def test_deflated_sizes_copy_no_text():
    """Memory beside the column stays that of one text's output."""
    import tracemalloc
    import zlib

    import pyarrow as pa

    from tollbook.functions.measures import deflated_sizes

    texts = ["é" * 2_000_000, None, "", *(str(i) * 400_000 for i in range(10, 20))]
    column = pa.array(texts)
    tracemalloc.start()
    got = deflated_sizes(column).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [None if t is None else len(zlib.compress(t.encode(), 6)) for t in texts] and peak < 1_000_000


def test_python_gets_small_batches(ws):
    assert int(ws.spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 * 1024 * 1024
