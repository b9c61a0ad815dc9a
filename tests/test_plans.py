"""What the physical plans must not contain."""

import re

import pytest

from tests.conftest import TESTDATA
from tollbook import registered
from tollbook.plans import RESULTS, Workspace
from tollbook.sources.testbed import ledger_from_events


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def big(spark):
    return registered.workspace(spark, TESTDATA, block_span=50)


def test_no_cross_products(big):
    """Scalar totals are subqueries and every join has an equality."""
    for name, fn in RESULTS.items():
        plan = plan_of(fn(big, **registered.PARAMETERS.get(name, {})))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_no_percentile_over_groups_of_unknown_size(big):
    for name, fn in RESULTS.items():
        assert "percentile(" not in plan_of(fn(big, **registered.PARAMETERS.get(name, {}))), name


def test_no_sketch_for_every_distinct_value(big):
    """A distinct count beside a sketch would keep a sketch per counted value, all merged in one task."""
    for name in ("c01_headline", "c02_headline", "t16_task_tool_usage", "t18_interrupts_by_agent", "t18_queue_operations"):
        lines = plan_of(RESULTS[name](big, **registered.PARAMETERS.get(name, {}))).splitlines()
        assert any("percentile_approx" in line for line in lines), name
        assert not any("percentile_approx" in line and "distinct" in line for line in lines), name


# Tables that a query must do without: what it returns needs none of their columns.
NEEDLESS = {
    "t03_top_repeated_files": {"tool_facts", "seq_pos", "sessions_x", "calls_priced"}, "concurrent_files": {"tool_facts", "seq_pos", "sessions_x", "edits"},
    "t20_edit_thrash": {"tool_facts", "sessions_x", "file_visits"}, "t23_by_hour_bucket": {"sessions_x", "session_price", "user_turns"},
    "label_file_mentions": {"batched_items", "tool_calls", "calls"}, "label_repairs": {"batched_items", "tool_calls", "calls"},
}


@pytest.mark.parametrize("name", NEEDLESS)
def test_no_tables_beyond_need(spark, name, monkeypatch):
    fresh = Workspace(ledger_from_events(spark.read.parquet(f"{TESTDATA}/events.parquet")))
    monkeypatch.setattr(registered, "workspace", lambda *a, **k: fresh)
    registered.queries()[name](spark, TESTDATA)
    assert fresh._built and not NEEDLESS[name] & set(fresh._built)


def test_filters_and_columns_reach_the_scan(ws):
    plan = plan_of(RESULTS["t21_headline"](ws))
    assert re.search(r"PushedFilters: \[IsNotNull\(agent\), EqualTo\(agent,claude_code\)\]", plan)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"session_id", "agent", "speed", "cost_usd"}


def test_one_exchange_for_a_plain_aggregate(ws):
    assert plan_of(RESULTS["t01_unpriced_models"](ws)).count("Exchange hashpartitioning") == 1
