"""Registered queries: every result and derived table over the driver's tables.

A workspace is built once per (application, folder) and shared by all queries. Doubles are
rounded and nested values written as text, so that results compare across engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, ShortType

from tollbook.plans import RESULTS, Workspace, studies
from tollbook.registered_text import TEXT_QUERIES
from tollbook.sources.testbed import ledger_from_events

DIGITS, SHIFT = 6, 2.137e-8

# Smaller minimum group sizes, as the driver's tables are small.
PARAMETERS: dict[str, dict] = {
    "t03_by_tool_kind": {"min_results": 100},
    "t05_claude_code_by_version": {"min_sessions": 2},
    "t05_codex_by_version": {"min_sessions": 2},
    "t05_headline": {"min_sessions": 2},
    "t07_by_model": {"min_calls": 50},
    "t14_concentration_by_repo": {"min_files": 3},
    "t14_headline": {"min_repo_edits": 50},
    "t15_by_agent_model_family": {"min_sessions": 3},
    "t15_by_mode": {"min_sessions": 3},
    "t15_by_repo_agent": {"min_sessions": 3},
    "t17_by_permission_mode_and_mode": {"min_sessions": 2},
    "t17_headline": {"min_sessions": 5},
    "t22_pairs": {"min_sessions": 1},
    "t22_model_totals_within_switchers": {"min_sessions": 1},
    "t22_within_pair_comparison": {"min_sessions": 1},
    "t22_headline": {"min_sessions": 1},
    "t24_by_version_claude_code": {"min_sessions": 2},
}

_WORKSPACES: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str, **options) -> Workspace:
    key = (spark.sparkContext.applicationId, f"{sf_dir}{sorted(options.items())}")
    if key not in _WORKSPACES:
        _WORKSPACES[key] = Workspace(ledger_from_events(spark.read.parquet(f"{sf_dir}/events.parquet")), **options)
    return _WORKSPACES[key]


def presented(df: DataFrame) -> DataFrame:
    """Round doubles, widen integers, write arrays as dotted text."""
    def show(field) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DoubleType):
            c = F.round(c + F.lit(SHIFT), DIGITS)
        elif isinstance(field.dataType, (IntegerType, ShortType)):
            c = c.cast(LongType())
        elif isinstance(field.dataType, ArrayType):
            c = F.array_join(c.cast("array<string>"), ".")
        return c.alias(field.name)
    return df.select(*[show(f) for f in df.schema.fields])


def sample_labels(ws: Workspace) -> DataFrame:
    """Labels derived from the prompts themselves, standing in for classified ones."""
    # The label names.
    names = ["follow_up", "approval", "question", "meta_other", "failure_report", "correction", "new_task", "interruption"]
    turn = (F.col("chars") + F.col("seq")) % 8
    label = F.element_at(F.array(*[F.lit(n) for n in names]), (turn + 1).cast("int"))
    return ws.prompts.select(
        "session_id", "agent", "repo", "seq", label.alias("label"),
        (turn.isin(4, 5) | ((F.col("chars") + F.col("seq")) % 11 == 0)).alias("pushback"), F.lit("neutral").alias("sentiment"))


def _result(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return presented(RESULTS[name](workspace(spark, sf_dir), **PARAMETERS.get(name, {})))
    return run


def _labelled(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ws = workspace(spark, sf_dir)
        return presented(fn(ws, sample_labels(ws)))
    return run


def _with_text(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return presented(fn(workspace(spark, sf_dir), spark, sf_dir))
    return run


# Derived tables that are registered themselves, with the columns that are compared.
DERIVED = {
    "model_prices": None,
    "calls_priced": "session_id seq agent model model_norm provider is_priced month c5m_tokens c1h_tokens ctx_tokens input_usd "
                    "cache_read_usd cache_write_usd output_usd cost_usd",
    "session_price": None,
    "calls_idx": "session_id seq call_idx cum_cost_usd cost_usd",
    "seq_pos": None,
    "sessions_x": "session_id agent repo mode harness_version user_hash session_model p_input n_calls n_sidechain_calls n_fast_calls "
                  "session_cost_usd output_tokens ctx_tokens n_tool_calls n_tool_errors n_human_turns n_interrupts committed_lines",
    "turns": "session_id turn_idx user_seq user_ts next_user_seq next_user_ts n_calls last_call_seq last_call_ts turn_cost_usd "
             "last_call_seq_adj last_call_ts_adj prev_last_call_ts_adj",
}


def _derived(name: str, cols: str | None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = getattr(workspace(spark, sf_dir), name)
        return presented(df.select(*cols.split()) if cols else df)
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name, cols in DERIVED.items():
        out[name] = _derived(name, cols)
    for name in sorted(RESULTS):
        out[name] = _result(name)
    for name in ("unread_by_next_label", "cost_by_label", "pushback_cost", "bill_summary"):
        out[name] = _labelled(getattr(studies, name))
    for name, fn in TEXT_QUERIES.items():
        out[name] = _with_text(fn)
    return out
