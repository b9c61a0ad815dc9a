"""Steps the harnesses share: block sums, matching results to calls, final shape."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tollbook.functions.clock import latency_ms, to_millis
from tollbook.functions.prompts import interrupted
from tollbook.functions.variants import text
from tollbook.operators.running import Carry, running, span_blocks
from tollbook.schemas import CALLS, EVENTS, TOOL_CALLS, USER_TURNS, conform

TEXT_HEAD, ERROR_HEAD, VALUE_HEAD = 300, 200, 300
ROW = ["session_id", "agent", "repo", "seq"]


@dataclass
class Parts:
    """Ledger rows of one harness."""

    calls: DataFrame
    tool_calls: DataFrame
    user_turns: DataFrame
    events: DataFrame


def of_type(blocks: Column, *names: str) -> Column:
    return F.filter(blocks, lambda b: F.coalesce(text(b, "type").isin(*names), F.lit(False)))


def texts_of(blocks: Column, key: str = "text") -> Column:
    return F.transform(blocks, lambda b: F.coalesce(text(b, key), F.lit("")))


def total_length(strings: Column) -> Column:
    """Characters of all strings together; 0 for none."""
    added = F.aggregate(strings, F.lit(0).cast("long"), lambda acc, s: acc + F.length(s))
    return F.coalesce(added, F.lit(0).cast("long"))


def how_many(blocks: Column) -> Column:
    return F.when(blocks.isNull(), 0).otherwise(F.size(blocks))


def first_filled(strings: Column, n: int = TEXT_HEAD) -> Column:
    return F.substring(F.get(F.filter(strings, lambda s: s != ""), F.lit(0)), 1, n)


def event_row(event_type, subtype, value, payload) -> list[Column]:
    def col(x):
        return x if isinstance(x, Column) else F.lit(x)
    return [col(event_type).cast("string").alias("event_type"), col(subtype).cast("string").alias("subtype"),
            F.substring(col(value).cast("string"), 1, VALUE_HEAD).alias("value"), col(payload).cast("long").alias("payload_chars")]


def attach_results(tools: DataFrame, results: DataFrame, span: int | None = None) -> DataFrame:
    """Give every tool call the result that names it.

    ``tools`` and ``results`` carry session_id, tool_use_id, seq and pos (place in the
    record). A result belongs to the latest call of its id before it; a result for an id not
    yet seen belongs to none. Of several results the last one counts, but an explicit error
    flag outlives later results without one."""
    blocks = span_blocks("seq", span) if span else span_blocks("seq")
    # only what the ledger keeps of a result goes through the exchanges, not its text
    facts = F.struct(F.length("result").cast("long").alias("result_chars"), F.sha1("result").alias("result_hash"),
                     interrupted(F.col("result")).alias("is_interrupted"), F.substring("result", 1, ERROR_HEAD).alias("head"))
    results = results.withColumn("facts", facts).drop("result")
    key, place = ["session_id", "tool_use_id"], F.struct("seq", "pos")
    marks = tools.where("tool_use_id <> ''").select(*key, "seq", "pos", F.lit(0).alias("side"), place.alias("call")).unionByName(
        results.where("tool_use_id <> ''").select(*key, "seq", "pos", F.lit(1).alias("side"), "facts", "explicit", "result_ts"),
        allowMissingColumns=True)
    owned = running(marks, key, ["seq", "pos", "side"], [Carry("owner", F.col("call"), "last")], blocks)
    owned = owned.where("side = 1 AND owner IS NOT NULL").select(
        *key, "seq", "pos", F.col("owner.seq").alias("o_seq"), F.col("owner.pos").alias("o_pos"), "facts", "explicit", "result_ts")
    owner = [*key, "o_seq", "o_pos"]
    states = running(owned, owner, ["seq", "pos"], [Carry("state", F.col("explicit"), "last")], blocks)
    states = states.withColumn("state", F.coalesce("state", F.lit(False)))
    timed = F.when(F.col("result_ts").isNotNull(), place)
    last = states.groupBy(*owner).agg(
        F.max_by("facts", place).alias("facts"), F.max_by("state", place).alias("is_error"),
        F.max_by("facts.head", F.when(F.col("state"), place)).alias("error_head"),
        F.max_by("result_ts", timed).alias("result_ts"))
    last = last.select(
        *key, F.col("o_seq").alias("seq"), F.col("o_pos").alias("pos"), "is_error", "error_head", "result_ts",
        "facts.result_chars", "facts.result_hash", "facts.is_interrupted")
    return tools.join(last, [*key, "seq", "pos"], "left").withColumn("result_latency_ms", latency_ms(F.col("ts"), F.col("result_ts")).cast("long"))


def in_ledger_shape(p: Parts) -> Parts:
    """Declared columns and millisecond time stamps."""
    def cut(df, *cols):
        return df.withColumns({c: to_millis(F.col(c)) for c in cols if c in df.columns})
    return Parts(
        conform(cut(p.calls, "ts"), CALLS), conform(cut(p.tool_calls, "ts", "result_ts"), TOOL_CALLS),
        conform(cut(p.user_turns, "ts"), USER_TURNS), conform(cut(p.events, "ts"), EVENTS))
