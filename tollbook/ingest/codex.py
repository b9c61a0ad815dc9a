"""codex: a running state of model and folder; a token counter closes each response."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tollbook.functions.clock import iso_time
from tollbook.functions.prompts import prompt_columns
from tollbook.functions.tools import with_tool_input
from tollbook.functions.variants import as_text, dump, filled, flag, is_list, is_object, is_text, kind, node, shown, size_of, text, whole
from tollbook.ingest.common import Parts, ROW, TEXT_HEAD, attach_results, event_row, total_length
from tollbook.operators.running import Carry, running, span_blocks

# Item types.
CALL_ITEMS = ["function_call", "custom_tool_call", "local_shell_call", "tool_search_call", "web_search_call"]
OUTPUT_ITEMS = ["function_call_output", "custom_tool_call_output", "local_shell_call_output", "tool_search_call_output"]
DEFAULT_NAMES = {"web_search_call": "web_search", "tool_search_call": "tool_search", "local_shell_call": "local_shell"}
VALUE_KEYS = ["reason", "status", "call_id", "command", "name"]


def joined(v):
    """Text of a message body: a string, or the texts of a list put together."""
    pieces = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda b: F.coalesce(F.when(is_object(b), text(b, "text")), as_text(b), F.lit("")))
    return F.when(is_list(v), F.array_join(pieces, "")).otherwise(F.coalesce(as_text(v), F.lit("")))


def parse(records: DataFrame, span: int | None = None) -> Parts:
    blocks = span_blocks("seq", span) if span else span_blocks("seq")
    v = F.col("v")
    r = records.where(is_object(v)).withColumns({
        "typ": text(v, "type"), "ts": iso_time(text(v, "timestamp")),
        "p": F.when(is_object(node(v, "payload")), node(v, "payload"))})
    p = F.col("p")
    r = r.withColumn("ptype", shown(p, "type"))
    context, opened = F.col("typ") == "turn_context", F.col("typ") == "session_meta"
    counted = (F.col("typ") == "event_msg") & (F.col("ptype") == "token_count")
    closes = F.coalesce(counted & is_object(node(p, "info")), F.lit(False))
    r = r.withColumn("closes", closes)
    turns = _turns(r, span)  # of no state
    # the state as of each record, and the response it belongs to
    r = running(r, ["session_id"], ["seq"], [
        Carry("model", F.when(context, filled(p, "model")), "last"),
        Carry("timezone", F.when(context, filled(p, "timezone")), "last"),
        Carry("cwd", F.when(context | opened, filled(p, "cwd")), "last"),
        Carry("harness_version", F.when(opened, filled(p, "cli_version")), "last"),
        Carry("segment", F.col("closes").cast("long"), inclusive=False),
        Carry("closed_at", F.when(F.col("closes"), F.col("seq")), "max", inclusive=False),
    ], blocks).withColumn("segment", F.coalesce("segment", F.lit(0)))
    item = r.where("typ = 'response_item'")
    tools = attach_results(_tool_calls(item), _outputs(item))
    return Parts(_calls(r, item), tools, turns, _events(r))


def _calls(r: DataFrame, item: DataFrame) -> DataFrame:
    p = F.col("p")
    spoken = (F.col("ptype") == "message") & (text(p, "role") == "assistant")
    body = joined(node(p, "content"))
    said = F.when(spoken, body)
    thought = F.when(F.col("ptype") == "reasoning", F.length(joined(node(p, "summary"))) + F.length(joined(node(p, "content"))))
    is_call = F.col("ptype").isin(*CALL_ITEMS)
    sums = item.select("session_id", "segment", "seq", said.alias("said"), thought.alias("thought"), is_call.cast("int").alias("call")).groupBy(
        "session_id", "segment").agg(
        F.sum(F.length("said")).alias("n_text_chars"), F.sum("thought").alias("n_thinking_chars"), F.sum("call").alias("n_tool_uses"),
        F.min_by(F.substring("said", 1, TEXT_HEAD), F.when(F.col("said") != "", F.col("seq"))).alias("text_head"))
    last = "info.last_token_usage"
    closers = r.where("closes").select(
        "session_id", "agent", "repo", "segment", (F.coalesce(F.col("closed_at") + 1, F.lit(0))).cast("int").alias("seq"), "ts", "model",
        "timezone", "cwd", "harness_version", whole(p, f"{last}.input_tokens").alias("input_tokens"),
        whole(p, f"{last}.cached_input_tokens").alias("cache_read_tokens"), whole(p, f"{last}.output_tokens").alias("output_tokens"),
        whole(p, f"{last}.reasoning_output_tokens").alias("reasoning_tokens"), whole(p, "info.model_context_window").alias("context_window"))
    zeros = {c: F.coalesce(c, F.lit(0)) for c in ("n_text_chars", "n_thinking_chars", "n_tool_uses")}
    counted = closers.join(sums, ["session_id", "segment"], "left").withColumns(zeros).withColumns({
        "n_thinking_blocks": F.when(F.col("n_thinking_chars") > 0, 1).otherwise(0),
        "stop_reason": F.when(F.col("n_tool_uses") > 0, "tool_use").otherwise("end_turn")}).drop("segment")

    # sessions without any counter: one row per assistant message, under the final state
    state = ["model", "timezone", "cwd", "harness_version"]
    final = r.groupBy("session_id").agg(F.max_by(F.struct(*state), "seq").alias("_s"), F.bool_or("closes").alias("_counted"))
    bare = item.where(spoken).select(*ROW, "ts", body.alias("_body")).join(
        final.where("NOT _counted").select("session_id", "_s.*"), "session_id")
    nil = F.lit(0)
    bare = bare.withColumns({
        "n_text_chars": F.length("_body").cast("long"), "text_head": F.substring("_body", 1, TEXT_HEAD), "n_thinking_chars": nil.cast("long"),
        "n_thinking_blocks": nil, "n_tool_uses": nil}).drop("_body")
    return counted.unionByName(bare, allowMissingColumns=True)


def _tool_calls(item: DataFrame) -> DataFrame:
    p = F.col("p")
    t = item.where(F.col("ptype").isin(*CALL_ITEMS))
    fallback = F.lit(None).cast("string")
    for ptype, name in DEFAULT_NAMES.items():
        fallback = F.when(F.col("ptype") == ptype, name).otherwise(fallback)
    args = F.coalesce(node(p, "arguments"), node(p, "input"), node(p, "action"), node(p, "query"))
    t = t.withColumn("args", args).withColumn("raw", as_text(F.col("args")))
    parsed = F.when(F.ltrim("raw").startswith("{"), F.try_parse_json("raw"))
    t = t.withColumn("inp", F.when(is_object(F.col("args")), F.col("args")).otherwise(F.when(is_object(parsed), parsed)))
    t = t.select(
        *ROW, "ts", "cwd", "inp", F.when(F.col("inp").isNull(), F.col("raw")).alias("raw"), F.lit(0).alias("pos"),
        F.coalesce(filled(p, "call_id"), filled(p, "id")).alias("tool_use_id"), F.coalesce(filled(p, "name"), fallback).alias("tool_name"),
        size_of(F.col("args")).alias("input_chars"))
    return with_tool_input(t, F.col("tool_name"), F.col("inp"), [F.col("cwd")], F.col("raw")).drop("cwd", "inp", "raw")


def _outputs(item: DataFrame) -> DataFrame:
    p = F.col("p")
    out = node(p, "output")
    def part(k):
        x = node(out, k)
        return F.when(is_text(x) | is_list(x), joined(x))
    body = (F.when(out.isNull(), "").when(is_text(out) | is_list(out), joined(out))
            .when(is_object(out), F.coalesce(part("output"), part("text"), part("content"), dump(out)))
            .otherwise(F.try_variant_get(out, "$", "string")))
    failed = F.when(is_object(out) & node(out, "success").isNotNull(), ~flag(out, "success"))
    return item.where(F.col("ptype").isin(*OUTPUT_ITEMS)).select(
        "session_id", text(p, "call_id").alias("tool_use_id"), "seq", F.lit(0).alias("pos"), body.alias("result"),
        failed.alias("explicit"), F.col("ts").alias("result_ts"))


def _turns(r: DataFrame, span: int | None) -> DataFrame:
    """User messages, plus echoed ones that no user message accounts for: of the echoes of a
    text as many are dropped, from the first on, as there are messages with that text."""
    blocks = span_blocks("seq", span) if span else span_blocks("seq")
    p = F.col("p")
    message = node(p, "message")
    typed = r.where("typ = 'event_msg' AND ptype = 'user_message'").select(
        *ROW, "ts", F.when(is_text(message), as_text(message)).otherwise(F.coalesce(dump(message), F.lit(""))).alias("_body"))
    echoed = r.where((F.col("typ") == "response_item") & (F.col("ptype") == "message") & (text(p, "role") == "user")).select(*ROW, "ts", joined(node(p, "content")).alias("_body"))
    accounted = typed.groupBy("session_id", "_body").agg(F.count(F.lit(1)).alias("_known"))
    nth = running(echoed, ["session_id", "_body"], ["seq"], [Carry("_nth", F.lit(1).cast("long"))], blocks)
    extra = nth.join(accounted, ["session_id", "_body"], "left").where(F.col("_nth") > F.coalesce("_known", F.lit(0)))
    both = typed.unionByName(extra.drop("_nth", "_known"))
    return both.withColumns(prompt_columns(F.col("_body"))).drop("_body")


def _events(r: DataFrame) -> DataFrame:
    v, p, typ, ptype = F.col("v"), F.col("p"), F.col("typ"), F.col("ptype")
    def none_word(x):
        return F.coalesce(x, F.lit("None"))
    is_item, is_event = F.coalesce(typ == "response_item", F.lit(False)), F.coalesce(typ == "event_msg", F.lit(False))
    role = F.coalesce(text(p, "role"), F.lit("None"))
    message = is_item & (ptype == "message")
    handled = F.coalesce((message & role.isin("assistant", "user"))
                         | (is_item & ((ptype == "reasoning") | ptype.isin(*CALL_ITEMS) | ptype.isin(*OUTPUT_ITEMS)))
                         | (is_event & ((ptype == "user_message") | F.col("closes"))), F.lit(False))
    idle = is_event & (ptype == "token_count")
    base = node(p, "base_instructions")
    effort = F.coalesce(shown(p, "collaboration_mode.settings.reasoning_effort"), shown(p, "effort"))
    first_value = F.coalesce(*[
        F.when(F.coalesce(kind(node(p, k)).rlike("^(STRING|BIGINT|DOUBLE|DECIMAL|BOOLEAN)"), F.lit(False)), shown(p, k)) for k in VALUE_KEYS])
    subtype = (F.when(typ == "session_meta", shown(p, "model_provider")).when(typ == "turn_context", shown(p, "sandbox_policy.type"))
               .when(message, F.concat(F.lit("message:"), role)).when(idle, "token_count_norate").when(is_item | is_event, ptype))
    value = (F.when(typ == "session_meta", shown(p, "cli_version"))
             .when(typ == "turn_context", F.concat(F.lit("model="), none_word(F.col("model")), F.lit(";approval="),
                                                   none_word(shown(p, "approval_policy")), F.lit(";effort="), none_word(effort)))
             .when(is_event & ~idle & (ptype != "agent_message"), first_value))
    def whole_payload():
        return F.when(p.isNull(), 2).otherwise(size_of(p))
    payload = (F.when(typ == "session_meta", size_of(F.when(is_object(base), node(base, "text")).otherwise(base)))
               .when(typ == "turn_context", whole_payload()).when(message, F.length(joined(node(p, "content"))))
               .when(idle, 0).when(is_event & (ptype == "agent_message"), size_of(node(p, "message")))
               .when(is_item | is_event, whole_payload()).otherwise(size_of(v)))
    ts = F.when(typ == "session_meta", F.coalesce("ts", iso_time(text(p, "timestamp")))).otherwise(F.col("ts"))
    return r.where(~handled).withColumn("ts", ts).select(
        *ROW, "ts", *event_row(F.coalesce(F.nullif(typ, F.lit("")), F.lit("unknown")), subtype, value, payload))
