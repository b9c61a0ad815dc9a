"""Ledger counts against the counts the catalog gives for the same sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tollbook.functions.metrics import ratio, rows, rows_where, total, yes, zero
from tollbook.operators.quantiles import med
from tollbook.operators.ranking import top_per
from tollbook.plans.workspace import Workspace

# Metric, ledger column, catalog column.
METRICS = [
    ("tool_calls", "n_tool_calls", "stat_tool_calls"),
    ("calls", "n_calls", "stat_assistant_messages"),
    ("output_tokens", "sum_output_tokens", "stat_output_tokens"),
    ("user_turns(!meta)", "n_user_turns", "stat_user_messages"),
    ("calls (api)", "n_calls", "ckpt_api_call_count"),
    ("output_tokens (api)", "sum_output_tokens", "ckpt_output_tokens"),
    ("output-reasoning", "sum_output_net", "stat_output_tokens"),
    ("user_turns(all)", "n_user_turns_all", "stat_user_messages"),
]
OURS = ["n_calls", "sum_output_tokens", "sum_output_net", "n_tool_calls", "n_user_turns", "n_user_turns_all"]
THEIRS = ["stat_assistant_messages", "stat_output_tokens", "stat_tool_calls", "stat_user_messages", "ckpt_api_call_count", "ckpt_output_tokens"]


def session_counts(ws: Workspace) -> DataFrame:
    """Every session found in calls, tool calls or prompts, with both sets of counts."""
    c = ws.calls.groupBy("session_id").agg(
        rows().alias("n_calls"), total("output_tokens").alias("sum_output_tokens"),
        (total("output_tokens") - total("reasoning_tokens")).alias("sum_output_net"))
    t = ws.tool_calls.groupBy("session_id").agg(rows().alias("n_tool_calls"))
    u = ws.user_turns.groupBy("session_id").agg(rows_where(~yes("is_meta")).alias("n_user_turns"), rows().alias("n_user_turns_all"))
    ids = reduce(DataFrame.union, [x.select("session_id") for x in (c, t, u)]).distinct()
    s = ws.sessions.select("session_id", "agent", *THEIRS)
    out = reduce(lambda a, b: a.join(b, "session_id", "left"), [c, t, u, s], ids)
    return out.withColumns({x: zero(x).cast("long") for x in [*OURS, *THEIRS]})


def _by_metric(ws: Workspace) -> DataFrame:
    """One row per session and metric."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(a).alias("ours"), F.col(b).alias("theirs")) for m, a, b in METRICS])
    long = session_counts(ws).select("session_id", F.coalesce("agent", F.lit("(unknown)")).alias("agent"), F.explode(cells).alias("x"))
    gap = F.when(F.col("x.theirs") > 0, ratio(F.col("x.ours") - F.col("x.theirs"), F.col("x.theirs")))
    return long.select("session_id", "agent", "x.*", gap.alias("rel_delta"))


def agreement(ws: Workspace) -> DataFrame:
    """Totals, median relative gap and exact matches per metric and agent."""
    return ws.grouped(
        _by_metric(ws), ["metric", "agent"],
        [rows().alias("sessions"), F.sum("ours").alias("ledger_total"), F.sum("theirs").alias("metadata_total"),
         rows_where(F.col("ours") == F.col("theirs")).alias("exact"), rows_where(F.col("theirs") == 0).alias("metadata_zero")],
        {"median_rel_delta": med("rel_delta")}).orderBy("metric", "agent")


def worst_sessions(ws: Workspace, k: int = 5) -> DataFrame:
    """The ``k`` sessions of every metric that are furthest off."""
    far = _by_metric(ws).where("theirs > 0")
    return top_per(far, ["metric"], [F.abs("rel_delta").desc_nulls_last(), F.col("session_id").asc()], k).orderBy("metric", F.abs("rel_delta").desc())
