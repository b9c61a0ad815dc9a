"""opencode: messages made of parts; a step-finish part closes each response."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tollbook.functions.clock import epoch_time, latency_ms
from tollbook.functions.prompts import interrupted, prompt_columns
from tollbook.functions.tools import with_tool_input
from tollbook.functions.variants import dump, filled, is_object, items, node, shown, size_of, text, whole
from tollbook.ingest.common import ERROR_HEAD, Parts, ROW, TEXT_HEAD, event_row, of_type, texts_of
from tollbook.operators.running import Carry, running, span_blocks


def parse(messages: DataFrame, span: int | None = None) -> Parts:
    """``messages``: session columns, seq, v, version, directory."""
    v = F.col("v")
    info = node(v, "info")
    m = messages.withColumn("good", is_object(v) & F.try_variant_get(v, "$.info", "variant").isNotNull())
    odd = m.where("NOT good").select(*ROW, F.lit(None).cast("timestamp_ntz").alias("ts"), *event_row("unparsed_message", None, None, size_of(v)))
    m = m.where("good").withColumns({
        "info": F.when(is_object(info), info), "parts": items(v, "parts")})
    i = F.col("info")
    m = m.withColumns({
        "role": shown(i, "role"), "ts": epoch_time(shown(i, "time.created")), "done_ts": epoch_time(shown(i, "time.completed")),
        "cwd": filled(i, "path.cwd"), "model": F.coalesce(shown(i, "modelID"), shown(i, "model.modelID")), "msg_id": shown(i, "id"),
        "parent_id": shown(i, "parentID"), "finish": shown(i, "finish")})
    blocks = span_blocks("seq", span) if span else span_blocks("seq")
    said = "role IS NULL OR role <> 'user'"
    # the last root so far is asked of tools alone
    rooted = running(m, ["session_id"], ["seq"], [Carry("root", filled(i, "path.root"), "last")], blocks).where(said)
    asked, said = m.where("role = 'user'"), m.where(said)
    parts = _parts(said)
    return Parts(_calls(said, parts), _tools(_parts(rooted, "root")), _turns(asked), odd.unionByName(_events(asked, parts)))


def _parts(said: DataFrame, *more: str) -> DataFrame:
    """Parts of a message, numbered by the step they belong to. The window is one message."""
    b = F.col("b")
    keep = [*ROW, "ts", "cwd", "directory", "model", "msg_id", "parent_id", "version", "finish", "role", *more]
    p = said.select(*keep, F.posexplode("parts").alias("pos", "b")).where(is_object(b)).withColumn("ptype", shown(b, "type"))
    before = Window.partitionBy("session_id", "seq").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return p.withColumn("step", F.coalesce(F.sum(F.when(F.col("ptype") == "step-finish", 1).otherwise(0)).over(before), F.lit(0)))


def _tokens(t) -> dict:
    return {"input_tokens": whole(t, "input"), "output_tokens": whole(t, "output"), "reasoning_tokens": whole(t, "reasoning"),
            "cache_read_tokens": whole(t, "cache.read"), "cache_create_tokens": whole(t, "cache.write")}


def _calls(said: DataFrame, parts: DataFrame) -> DataFrame:
    b, ptype = F.col("b"), F.col("ptype")
    body = F.coalesce(text(b, "text"), F.lit(""))
    said_text = F.when(ptype == "text", body)
    end = F.coalesce(F.nullif(shown(b, "time.end"), F.lit("0")), shown(b, "time.start"))
    close = F.when(ptype == "step-finish", F.struct(epoch_time(end).alias("ts"), shown(b, "reason").alias("reason"), *[c.alias(n) for n, c in _tokens(node(b, "tokens")).items()]))
    steps = parts.groupBy("session_id", "seq", "step").agg(
        F.coalesce(F.sum(F.length(said_text)), F.lit(0)).alias("n_text_chars"),
        F.coalesce(F.sum(F.when(ptype == "reasoning", F.length(body))), F.lit(0)).alias("n_thinking_chars"),
        F.count(F.when(ptype == "tool", 1)).alias("n_tool_uses"),
        F.min_by(F.substring(said_text, 1, TEXT_HEAD), F.when(said_text != "", F.col("pos"))).alias("text_head"),
        F.max(close).alias("close"))
    i = F.col("info")
    heads = said.select(*ROW, F.col("ts").alias("m_ts"), "done_ts", "cwd", "model", "msg_id", "parent_id", F.col("version").alias("harness_version"),
                        "finish", "role", F.struct(*[c.alias(n) for n, c in _tokens(node(i, "tokens")).items()]).alias("own"))
    # a message with no closed step is one response of its own; otherwise parts after the last step are a tail
    closed = steps.groupBy("session_id", "seq").agg(F.count("close").alias("n_closed"))
    zero_step = heads.select("session_id", "seq").withColumn("step", F.lit(0)).join(steps.select("session_id", "seq", "step"), ["session_id", "seq", "step"], "left_anti")
    s = steps.unionByName(zero_step, allowMissingColumns=True).join(closed, ["session_id", "seq"], "left").join(heads, ["session_id", "seq"])
    s = s.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_text_chars", "n_thinking_chars", "n_tool_uses", "n_closed")})
    has_close, alone = F.col("close").isNotNull(), (F.col("n_closed") == 0) & F.coalesce(F.col("role") == "assistant", F.lit(False))
    some = (F.col("n_text_chars") > 0) | (F.col("n_thinking_chars") > 0) | (F.col("n_tool_uses") > 0)
    s = s.where(has_close | alone | some)
    names = list(_tokens(F.lit(None)))
    return s.withColumns({
        "ts": F.when(has_close, F.coalesce("close.ts", "m_ts")).when(alone, F.coalesce("done_ts", "m_ts")).otherwise(F.col("m_ts")),
        "stop_reason": F.when(has_close, F.col("close.reason")).otherwise(F.col("finish")),
        "n_thinking_blocks": F.when(F.col("n_thinking_chars") > 0, 1).otherwise(0),
        **{n: F.when(has_close, F.col(f"close.{n}")).when(alone, F.col(f"own.{n}")) for n in names}}).drop("close", "own")


def _tools(parts: DataFrame) -> DataFrame:
    b = F.col("b")
    state = node(b, "state")
    t = parts.where("ptype = 'tool'").withColumn("state", F.when(is_object(state), state))
    s = F.col("state")
    given, raw = node(s, "input"), text(s, "input")
    parsed = F.try_parse_json(raw)
    as_command = F.parse_json(F.to_json(F.struct(raw.alias("command"))))
    inp = (F.when(is_object(given), given).when(raw.isNotNull() & parsed.isNull(), as_command).when(is_object(parsed), parsed))
    t = t.withColumn("inp", inp)
    failed = F.coalesce(text(s, "status") == "error", F.lit(False)) | (F.coalesce(shown(s, "error"), F.lit("")) != "")
    err = filled(s, "error")
    out = F.coalesce(text(s, "output"), dump(node(s, "output")), F.lit(""))
    start, end = epoch_time(shown(s, "time.start")), epoch_time(shown(s, "time.end"))
    t = t.select(
        *ROW, "msg_id", "inp", "cwd", "root", "directory", F.coalesce(filled(b, "callID"), filled(b, "id")).alias("tool_use_id"),
        shown(b, "tool").alias("tool_name"), filled(b, "filePath").alias("_beside"), failed.alias("is_error"), err.alias("_err"),
        F.when(failed & err.isNotNull(), err).otherwise(out).alias("_out"), start.alias("ts"), end.alias("result_ts"))
    t = t.withColumns({
        "input_chars": F.when(F.col("inp").isNull(), 2).otherwise(size_of(F.col("inp"))),
        "result_chars": F.length("_out").cast("long"), "result_hash": F.sha1("_out"),
        "error_head": F.when(F.col("is_error"), F.substring("_out", 1, ERROR_HEAD)),
        "is_interrupted": interrupted(F.col("_out")) | F.coalesce(F.lower("_err").contains("abort"), F.lit(False)),
        "result_latency_ms": latency_ms(F.col("ts"), F.col("result_ts")).cast("long")})
    bases = [F.coalesce(c, F.lit("")) for c in ("cwd", "root", "directory")]
    t = with_tool_input(t, F.col("tool_name"), F.col("inp"), bases, beside=F.col("_beside"))
    return t.drop("inp", "cwd", "root", "directory", "_beside", "_err", "_out")


def _turns(asked: DataFrame) -> DataFrame:
    listed = of_type(F.col("parts"), "text")
    t = asked.where(F.size(listed) > 0).select(*ROW, "ts", F.col("msg_id").alias("prompt_id"), F.array_join(texts_of(listed), "\n").alias("_body"))
    return t.withColumns(prompt_columns(F.col("_body"))).drop("_body")


def _events(asked: DataFrame, parts: DataFrame) -> DataFrame:
    b = F.col("b")
    mine = asked.select(*ROW, "ts", F.explode("parts").alias("b")).where(text(b, "type").isin("file", "patch", "agent", "snapshot"))
    theirs = parts.where(F.coalesce(~F.col("ptype").isin("text", "reasoning", "tool", "step-finish", "step-start"), F.lit(True)))
    return mine.select(*ROW, "ts", *event_row("part", shown(b, "type"), None, size_of(b))).unionByName(
        theirs.select(*ROW, "ts", *event_row("part", F.col("ptype"), None, size_of(b))))
