"""A ledger small enough to work out by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tollbook.plans import RESULTS, Workspace
from tollbook.plans import studies
from tollbook.schemas import LEDGER, conform
from tollbook.sources.ledger import Ledger

T0 = datetime(2026, 5, 1, 12)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def table(spark, name, rows):
    schema = LEDGER[name]
    kinds = {f.name: f for f in schema.fields}
    cols = sorted({c for r in rows for c in r})
    from pyspark.sql.types import StructType
    df = spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], StructType([kinds[c] for c in cols]))
    return conform(df, schema)


CALLS = [
    # a long reply answered after two seconds; the later call is stamped after the next prompt
    dict(session_id="a", agent="codex", seq=1, ts=at(10), msg_id="m1", model="gpt-5.4", input_tokens=1000, cache_read_tokens=400, output_tokens=10, n_text_chars=6000, text_head="long", stop_reason="end_turn", cwd="/home/ann/x"),
    dict(session_id="a", agent="codex", seq=2, ts=at(13), msg_id="m2", model="gpt-5.4", input_tokens=500, output_tokens=1, n_text_chars=50, text_head="late", stop_reason="max_tokens", cwd="/home/ann/x"),
    dict(session_id="a", agent="codex", seq=6, ts=at(30), msg_id="m3", model="gpt-5.4", input_tokens=300, output_tokens=5, n_text_chars=100, text_head="end", stop_reason="end_turn", cwd="/home/ann/x"),
    # cache re-written after seven minutes; one call on a side chain
    dict(session_id="b", agent="claude_code", seq=1, ts=at(0), msg_id="n1", model="anthropic/claude-sonnet-4.6", input_tokens=100, cache_read_tokens=0, cache_create_tokens=900, output_tokens=10),
    dict(session_id="b", agent="claude_code", seq=2, ts=at(420), msg_id="n2", model="anthropic/claude-sonnet-4.6", input_tokens=0, cache_create_tokens=600, cache_create_5m=200, cache_create_1h=400, output_tokens=20),
    dict(session_id="b", agent="claude_code", seq=3, ts=at(421), msg_id="n3", model="anthropic/claude-sonnet-4.6", is_sidechain=True, input_tokens=5, output_tokens=7),
    dict(session_id="c", agent="cursor", seq=1, n_text_chars=10, msg_id="p1"),
]
TURNS = [
    dict(session_id="a", agent="codex", seq=0, ts=at(0), text="go", chars=2, human_chars=2, is_meta=False, is_interrupt=False),
    dict(session_id="a", agent="codex", seq=3, ts=at(12), text="more", chars=4, human_chars=4, is_meta=False, is_interrupt=False),
    dict(session_id="b", agent="claude_code", seq=0, ts=at(-5), text="hi", chars=2, human_chars=2, is_meta=False, is_interrupt=False),
    dict(session_id="b", agent="claude_code", seq=9, ts=at(430), text="", chars=30, human_chars=0, is_meta=True, is_interrupt=True),
]
TOOLS = [
    dict(session_id="a", agent="codex", seq=1, tool_use_id="t1", tool_kind="read", file_path="f", ts=at(9), result_chars=100, result_hash="h", is_error=False),
    dict(session_id="a", agent="codex", seq=2, tool_use_id="t2", tool_kind="read", file_path="f", ts=at(11), result_chars=100, result_hash="h", is_error=False),
    dict(session_id="a", agent="codex", seq=4, tool_use_id="t3", tool_kind="write", file_path="f", ts=at(20), content_chars=400, input_chars=500, is_error=None),
    dict(session_id="a", agent="codex", seq=5, tool_use_id="t4", tool_kind="read", file_path="f", ts=at(21), result_chars=400, result_hash="g", is_error=True, error_head="ENOENT: nothing"),
    dict(session_id="b", agent="claude_code", seq=2, tool_use_id="u1", tool_kind="write", file_path="f", ts=at(15), content_chars=80, result_chars=5, result_hash="h"),
    dict(session_id="b", agent="claude_code", seq=2, tool_use_id="u2", tool_kind="edit", file_path="f", ts=at(400), new_string_chars=40, old_string_chars=9),
]
SESSIONS = [
    dict(session_id="a", agent="codex", repo="r", attr_agent_percentage=99.0, attr_total_committed=10),
    dict(session_id="b", agent="claude_code", repo="r", attr_agent_percentage=3.0, attr_total_committed=0),
    dict(session_id="c", agent="cursor", repo=None),
]
EVENTS = [dict(session_id="a", agent="codex", seq=3, event_type="compacted"), dict(session_id="b", agent="claude_code", seq=1, event_type="attachment", payload_chars=60)]


@pytest.fixture(scope="module", params=[2, 1000], ids=["narrow blocks", "wide blocks"])
def w(request, spark):
    ledger = Ledger(**{n: table(spark, n, rows) for n, rows in dict(calls=CALLS, tool_calls=TOOLS, user_turns=TURNS, events=EVENTS, sessions=SESSIONS).items()})
    return Workspace(ledger, block_span=request.param)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict() for r in df.collect()}


def test_prices(w):
    got = by(w.calls_priced, "msg_id")
    assert got["m1"]["cost_usd"] == pytest.approx((600 * 2.5 + 400 * 0.25 + 10 * 15) / 1e6)
    assert got["m1"]["ctx_tokens"] == 1000
    assert got["n1"]["cost_usd"] == pytest.approx((100 * 3 + 900 * 3.75 + 10 * 15) / 1e6)
    assert got["n2"]["cache_write_usd"] == pytest.approx((200 * 3.75 + 400 * 6) / 1e6)
    assert got["p1"]["cost_usd"] is None and not got["p1"]["is_priced"]
    for r in got.values():
        if r["cost_usd"] is not None:
            assert r["cost_usd"] == pytest.approx(r["input_usd"] + r["cache_read_usd"] + r["cache_write_usd"] + r["output_usd"])


def test_positions(w):
    got = by(w.seq_pos, "session_id", "seq")
    assert (got["a", 0]["calls_before"], got["a", 0]["tools_before"]) == (0, 0)
    assert (got["a", 3]["calls_before"], got["a", 3]["tools_before"]) == (2, 2)
    assert got["b", 2]["tools_before"] == 2 and got["b", 3]["calls_before"] == 2


def test_turns_leave_out_calls_stamped_after_the_next_prompt(w):
    t = by(w.turns.where("session_id = 'a'"), "turn_idx")[1]
    assert (t["last_call_seq"], t["last_call_seq_adj"], t["n_calls"], t["n_calls_adj"], t["next_user_seq"]) == (2, 1, 2, 1, 3)
    later = by(w.turns.where("session_id = 'a'"), "turn_idx")[2]
    assert later["prev_last_call_ts_adj"] == at(10) and later["next_user_ts"] is None and later["last_call_seq_adj"] == 6


def test_turn_without_times_keeps_its_calls(w):
    t = one(w.turns.where("session_id = 'c'"))
    assert (t["turn_idx"], t["n_calls"], t["last_call_seq_adj"], t["last_call_ts_adj"]) == (0, 1, 1, None)


def test_unread_reply(w):
    h = one(RESULTS["t11_headline"](w))
    assert (h["unread_replies"], h["final_replies_measured"], h["median_seconds_before_next_prompt"]) == (1, 1, 2.0)
    assert h["median_seconds_needed_to_read"] == pytest.approx(288.0)
    assert one(RESULTS["t11_longest_unread_replies"](w))["n_text_chars"] == 6000


def test_cache_break(w):
    h = one(RESULTS["t02_headline"](w))
    assert h["recached_tokens_after_gap_gt_5min"] == 600
    got = by(RESULTS["t02_by_gap_bucket"](w), "gap_bucket")
    assert got["3. 5-60 min"]["breaks"] == 1


def test_repeats(w):
    h = one(RESULTS["t03_headline"](w))
    assert (h["repeated_tool_results"], h["repeated_chars"]) == (1, 100)
    assert by(RESULTS["t03_by_agent"](w), "agent")["claude_code"]["repeated_chars"] is None


def test_truncation(w):
    h = one(RESULTS["t06_headline"](w))
    assert h["truncated_calls"] == 1 and h["usd_paid_to_resume_after_truncation"] == pytest.approx(300 * 2.5 / 1e6)


def test_missing_path(w):
    h = one(RESULTS["t07_headline"](w))
    assert h["missing_path_errors"] == 1 and h["usd_of_the_next_3_calls_after_the_error"] == pytest.approx((300 * 2.5 + 5 * 15) / 1e6)


def test_rewrite_of_a_read_file(w):
    got = by(RESULTS["t10_rewrite_ratio_distribution"](w), "bucket")
    assert got["4. bigger than what was read"]["writes"] == 1


def test_self_reread(w):
    h = one(RESULTS["t20_headline"](w))
    assert (h["reads_of_a_just_written_file"], h["reread_chars"]) == (1, 400)


def test_compaction(w):
    h = one(RESULTS["t19_headline"](w))
    assert (h["compaction_boundaries"], h["reads_in_the_20_tool_calls_after_a_boundary"], h["reread_chars"]) == (1, 1, 400)


def test_edits_and_what_follows(w):
    from tollbook.plans.tooling import edits
    got = by(edits(w), "session_id", "tool_kind")
    assert got["a", "write"]["error_within_3_tool_calls"] and not got["b", "edit"]["error_within_3_tool_calls"]
    assert got["a", "write"]["next_human_chars"] is None and got["a", "write"]["short_correction_next"] is False


def test_concurrent_edits(w):
    s = one(RESULTS["concurrent_summary"](w))
    assert s == {"overlapping_pairs": 1, "sessions_involved": 2, "files_with_overlap": 1, "files_edited_total": 1}


def test_interrupts(w):
    h = one(RESULTS["t18_headline"](w))
    cost = (100 * 3 + 900 * 3.75 + 10 * 15) / 1e6 + (200 * 3.75 + 400 * 6 + 20 * 15) / 1e6
    assert h["interrupts"] == 1 and h["usd_sunk_before_interrupts"] == pytest.approx(cost)


def test_survival(w):
    got = by(RESULTS["code_survival"](w), "agent", "mode")
    assert got["codex", "vibe"]["gen_lines_est"] == 10.0 and got["codex", "vibe"]["pct_survive_est"] == 100.0
    assert by(RESULTS["survival_distribution_vibe"](w), "bucket") == {"5. 75-100%": {"bucket": "5. 75-100%", "sessions": 1}}


def test_labels_meet_turns(w, spark):
    labels = spark.createDataFrame([("a", 0, "new_task", False, "neutral"), ("a", 3, "correction", True, "neutral")],
                                   "session_id string, seq int, label string, pushback boolean, sentiment string")
    assert one(studies.unread_by_next_label(w, labels))["label"] == "correction"
    cost = by(studies.cost_by_label(w, labels), "label")
    assert sum(r["pct_of_bill"] for r in cost.values()) == pytest.approx(100)


def test_all_results_run_on_it(w, tmp_path):
    from tollbook.plans.run import run_all
    report = run_all(w, str(tmp_path))
    assert [r["name"] for r in report if r["error"]] == [] and len(report) == len(RESULTS)
    failing = run_all(w, "/proc/nowhere", only=["t01_headline"])
    assert failing[0]["error"]


def test_invariants(w):
    main = w.calls_priced.where("NOT is_sidechain").count()
    assert w.turns.agg(F.sum("n_calls")).first()[0] == main
    shares = [r.pct_of_total_usd for r in RESULTS["t01_by_agent"](w).collect()]
    assert sum(shares) == pytest.approx(100)
    steps = w.seq_pos.where("calls_before < 0 OR tools_before < 0").count()
    assert steps == 0
