"""Raw texts behind ledger rows: tool results, tool inputs, final replies.

Sampled keys meet the exploded records by equality on session and id, however far apart. Of raw lines only
those that can matter are parsed: ids are cut from the text first (``records_that_matter``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tollbook.functions.variants import as_text, dump, filled, is_object, items, node, text
from tollbook.ingest import claude_code, codex, cursor, opencode
from tollbook.ingest.common import of_type, texts_of
from tollbook.sources.transcripts import parsed_lines, split_errors


def _claude(records: DataFrame, typ: str) -> DataFrame:
    v = F.col("v")
    return records.where((F.col("fmt") == "claude_code") & (text(v, "type") == typ)).withColumns({
        "ts": F.lit(None).cast("timestamp_ntz"), "cwd": F.lit(None).cast("string"), "blocks": items(v, "message.content")})


# Keys whose values name a call, a result or a message.
ID_VALUES = r'"(?:tool_use_id|call_id|callID|id)"\s*:\s*"((?:[^"\\]|\\.)*)"'
MOST_SAMPLED = 200_000  # sampled rows whose ids are sent to all tasks: some 20 MB


def lines_that_matter(lines: DataFrame, sampled: DataFrame) -> DataFrame:
    """Raw lines (session_id, seq, line, ...) of which a sampled row may need something: they hold one of its ids, as
    the value of an id key, or stand at its place; nothing is parsed for it. A line with an escape in an id is kept.

    A sample of more than ``MOST_SAMPLED`` rows is met by sessions alone, and its lines are all kept."""
    names = [c for c in ("tool_use_id", "msg_id") if c in sampled.columns]
    each = sampled.select("session_id", F.col("seq").cast("long").alias("_at"), F.array_compact(F.array(*names)).alias("_ids"))
    if each.limit(MOST_SAMPLED + 1).count() > MOST_SAMPLED:
        return lines.join(each.select("session_id").distinct(), "session_id", "left_semi")
    wanted = each.groupBy("session_id").agg(F.array_distinct(F.flatten(F.collect_list("_ids"))).alias("_ids"), F.collect_set("_at").alias("_at"))
    found = F.regexp_extract_all("line", F.lit(ID_VALUES), 1)
    here = F.array_contains("_at", F.col("seq").cast("long"))
    near = lines.join(F.broadcast(wanted), "session_id")
    return near.where(here | F.arrays_overlap(found, "_ids") | F.exists(found, lambda x: x.contains("\\"))).select(*lines.columns)


def records_that_matter(lines: DataFrame, sampled: DataFrame) -> DataFrame:
    """Parsed records of the lines of which a sampled row may need something."""
    return split_errors(parsed_lines(lines_that_matter(lines, sampled)))[0]


def result_texts(sampled: DataFrame, records: DataFrame, messages: DataFrame) -> DataFrame:
    """``sampled`` (session_id, seq, tool_use_id, ...) with the text of the first result that
    names the call."""
    p = node(F.col("v"), "payload")
    item = records.where((F.col("fmt") == "codex") & (text(F.col("v"), "type") == "response_item")).withColumns({
        "p": p, "ptype": text(p, "type"), "ts": F.lit(None).cast("timestamp_ntz")})
    b, state = F.col("b"), node(F.col("b"), "state")
    err = F.when(text(state, "status") == "error", filled(state, "error"))
    inline = messages.select("session_id", "seq", F.explode(items(F.col("v"), "parts")).alias("b")).where(text(b, "type") == "tool").select(
        "session_id", "seq", F.coalesce(filled(b, "callID"), filled(b, "id")).alias("tool_use_id"),
        F.coalesce(err, text(state, "output"), dump(node(state, "output")), F.lit("")).alias("text"))
    found = (
        claude_code._tool_results(_claude(records, "user")).select("session_id", "seq", "tool_use_id", F.col("result").alias("text"))
        .unionByName(codex._outputs(item).select("session_id", "seq", "tool_use_id", F.col("result").alias("text")))
        .unionByName(inline)
    ).withColumnRenamed("seq", "r_seq")
    near = sampled.join(found, ["session_id", "tool_use_id"]).where(F.col("r_seq") >= F.col("seq"))
    keys = sampled.columns
    return near.groupBy(*keys).agg(F.min_by("text", "r_seq").alias("text"))


def _message_inputs(messages: DataFrame) -> DataFrame:
    """Inputs of the calls of messages: the first call of an id counts, a text that is no JSON is a
    command, and a path beside the input belongs to it."""
    b, state = F.col("b"), node(F.col("b"), "state")
    given, raw, beside = node(state, "input"), text(state, "input"), filled(b, "filePath")
    parsed = F.try_parse_json(raw)
    inp = (F.when(is_object(given), dump(given)).when(raw.isNotNull() & parsed.isNull(), F.to_json(F.struct(raw.alias("command"))))
           .when(is_object(parsed), dump(parsed)).otherwise(F.lit("{}")))
    own = F.coalesce(dump(node(F.try_parse_json("_dump"), "filePath")), F.lit("null"))
    comma = F.when(F.col("_dump") == "{}", "").otherwise(",")
    joined = F.concat(F.expr("left(_dump, length(_dump) - 1)"), comma, F.expr("substring(to_json(named_struct('filePath', _beside)), 2)"))
    calls = messages.select("session_id", "seq", F.posexplode(items(F.col("v"), "parts")).alias("_at", "b")).where(text(b, "type") == "tool").select(
        "session_id", "seq", "_at", F.coalesce(filled(b, "callID"), filled(b, "id")).alias("tool_use_id"), inp.alias("_dump"), beside.alias("_beside"))
    calls = calls.withColumn("_dump", F.when(F.col("_beside").isNotNull() & own.isin("null", '""', "0", "false", "[]", "{}"), joined).otherwise(F.col("_dump")))
    return calls.groupBy("session_id", "seq", "tool_use_id").agg(F.min_by("_dump", "_at").alias("_dump"))


def tool_inputs(sampled: DataFrame, records: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """``sampled`` with the input object of the call, ``inp``, as JSON parsed again; harnesses
    only carry it in the record (or message, of the document harness) the call is in."""
    b = F.col("b")
    claude = _claude(records, "assistant").select("session_id", "seq", F.explode("blocks").alias("b")).select(
        "session_id", "seq", text(b, "id").alias("tool_use_id"), dump(node(b, "input")).alias("_dump"))
    p = node(F.col("v"), "payload")
    args = F.coalesce(node(p, "arguments"), node(p, "input"))
    coded = records.where(F.col("fmt") == "codex").select(
        "session_id", "seq", F.coalesce(text(p, "call_id"), text(p, "id")).alias("tool_use_id"),
        F.coalesce(F.when(F.try_parse_json(as_text(args)).isNotNull(), as_text(args)), dump(args)).alias("_dump"))
    found = claude.unionByName(coded)
    if messages is not None:
        found = found.unionByName(_message_inputs(messages))
    return sampled.join(found, ["session_id", "seq", "tool_use_id"]).withColumn("inp", F.try_parse_json("_dump")).drop("_dump")


def reply_texts(sampled: DataFrame, records: DataFrame, messages: DataFrame) -> DataFrame:
    """``sampled`` (session_id, seq, msg_id, ...) with the text of the reply: for claude_code
    all text blocks of the message id, elsewhere those of the record or message itself."""
    said = _claude(records, "assistant").select(
        "session_id", F.col("seq").alias("r_seq"), filled(F.col("v"), "message.id").alias("msg_id"),
        F.array_join(texts_of(of_type(F.col("blocks"), "text")), "").alias("piece"))
    near = sampled.join(said, ["session_id", "msg_id"]).where(F.col("r_seq") >= F.col("seq"))
    ordered = F.array_sort(F.collect_list(F.struct("r_seq", "piece")))
    claude = near.groupBy(*sampled.columns).agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("text"))
    plain = text(F.col("v"), "message.content")
    listed = F.array_join(texts_of(of_type(items(F.col("v"), "message.content"), "text")), "\n")
    lines = records.where(F.col("fmt") == "cursor").select("session_id", "seq", F.coalesce(plain, listed).alias("text"))
    docs = messages.select("session_id", "seq", F.array_join(texts_of(of_type(items(F.col("v"), "parts"), "text")), "").alias("text"))
    own = sampled.join(lines.unionByName(docs), ["session_id", "seq"])
    return claude.unionByName(own.select(claude.columns))
