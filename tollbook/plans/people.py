"""The human side: unread replies, waiting time, what the harness adds to prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tollbook.functions.metrics import (
    at_most, bands, chars_as_tokens, pct, ratio, rows, rows_where, seconds_between, sum_where, usd, version_key, yes, zero,
)
from tollbook.operators.quantiles import med
from tollbook.plans.catalog_of_results import result
from tollbook.plans.workspace import Workspace

CHARS_PER_WORD, WORDS_PER_MINUTE = 5.0, 250.0

# ---------------------------------------------------------------- unread replies


def final_replies(ws: Workspace) -> DataFrame:
    """Last reply of a turn with the time left to read it before the next prompt."""
    def build():
        t = ws.turns.where("last_call_seq_adj IS NOT NULL AND next_user_ts IS NOT NULL AND last_call_ts_adj IS NOT NULL")
        t = t.where(~yes("next_is_interrupt")).select(
            "session_id", "agent", "turn_idx", "user_seq", "next_user_seq", F.col("last_call_seq_adj").alias("seq"),
            seconds_between("last_call_ts_adj", "next_user_ts").alias("delta_s"))
        c = ws.calls_priced.where("NOT is_sidechain AND coalesce(n_text_chars, 0) > 0").select(
            "session_id", "seq", "n_text_chars", "model", "output_tokens", "output_usd")
        s = ws.sessions_x.select("session_id", "p_output")
        n = F.col("n_text_chars").cast("double")
        return t.join(c, ["session_id", "seq"]).join(s, "session_id").withColumns({
            "words": n / CHARS_PER_WORD,
            "read_time_s": n / CHARS_PER_WORD / WORDS_PER_MINUTE * 60.0,
            "text_tokens": chars_as_tokens("n_text_chars"),
            "text_usd": usd(chars_as_tokens("n_text_chars"), "p_output"),
        }).withColumn("unread", F.col("delta_s") < 0.5 * F.col("read_time_s"))
    return ws.table("final_replies", build)


@result("t11_by_agent")
def unread_by_agent(ws: Workspace) -> DataFrame:
    u = F.col("unread")
    return ws.grouped(
        final_replies(ws), ["agent"],
        [rows().alias("final_replies"), rows_where(u).alias("unread_replies"), pct(rows_where(u), rows()).alias("pct_replies_unread"),
         F.sum("text_tokens").alias("final_text_tokens"), sum_where(u, "text_tokens").alias("unread_text_tokens"),
         pct(sum_where(u, "text_tokens"), F.sum("text_tokens")).alias("pct_text_tokens_unread"),
         sum_where(u, "text_usd").alias("unread_usd")],
        {"median_read_time_s": med("read_time_s"), "median_delta_s": med("delta_s")},
    ).orderBy(F.desc("final_replies"), "agent")


@result("t11_delta_vs_read_time_distribution")
def reading_time_left(ws: Workspace) -> DataFrame:
    d, r = F.col("delta_s"), F.col("read_time_s")
    bucket = (F.when(d < 0.25 * r, "1. <25% of read time").when(d < 0.5 * r, "2. 25-50%").when(d < r, "3. 50-100%")
              .when(d < 5 * r, "4. 1-5x").otherwise("5. >5x (took their time)"))
    n = final_replies(ws).agg(rows()).scalar()
    return ws.grouped(
        final_replies(ws).withColumn("bucket", bucket), ["bucket"],
        [rows().alias("final_replies"), F.sum("text_tokens").alias("text_tokens"), F.sum("text_usd").alias("usd")],
        {"median_text_chars": med("n_text_chars")},
    ).withColumn("pct_of_replies", pct("final_replies", n)).orderBy("bucket")


@result("t11_by_reply_length")
def unread_by_length(ws: Workspace) -> DataFrame:
    u = F.col("unread")
    length = bands("n_text_chars", [(500, "1. <500 chars"), (2000, "2. 0.5-2k"), (6000, "3. 2-6k")], "4. >6k chars")
    return final_replies(ws).groupBy(length.alias("length_bucket")).agg(
        rows().alias("final_replies"), pct(rows_where(u), rows()).alias("pct_unread"), F.sum("text_tokens").alias("text_tokens"),
        sum_where(u, "text_usd").alias("unread_usd")).orderBy("length_bucket")


@result("t11_longest_unread_replies")
def longest_unread(ws: Workspace, n: int = 20) -> DataFrame:
    return final_replies(ws).where("unread").select(
        "session_id", "turn_idx", "agent", "n_text_chars", "read_time_s", "delta_s", "text_usd",
    ).orderBy(F.desc("n_text_chars"), "session_id", "turn_idx").limit(n)


@result("t11_ordering_diagnostic")
def turn_order_check(ws: Workspace) -> DataFrame:
    t = ws.turns.where("next_user_ts IS NOT NULL AND last_call_ts IS NOT NULL")
    return ws.grouped(
        t, ["agent"],
        [rows().alias("turns_with_a_next_prompt"),
         rows_where(F.col("last_call_seq_adj").isNull()).alias("turns_dropped_no_call_before_next_prompt"),
         rows_where(~F.col("last_call_seq").eqNullSafe(F.col("last_call_seq_adj"))).alias("turns_where_last_call_ts_was_after_next_prompt")],
        {"median_raw_delta_s": med(seconds_between("last_call_ts", "next_user_ts")),
         "median_adjusted_delta_s": med(seconds_between("last_call_ts_adj", "next_user_ts"))},
    ).orderBy(F.desc("turns_with_a_next_prompt"), "agent")


@result("t11_headline")
def unread_headline(ws: Workspace) -> DataFrame:
    u = F.col("unread")
    return ws.grouped(
        final_replies(ws), [],
        [sum_where(u, "text_usd").alias("usd_final_text_that_could_not_be_read"),
         pct(sum_where(u, "text_tokens"), F.sum("text_tokens")).alias("pct_of_final_text_tokens_unread"),
         rows_where(u).alias("unread_replies"), rows().alias("final_replies_measured")],
        {"median_seconds_before_next_prompt": med("delta_s"), "median_seconds_needed_to_read": med("read_time_s")},
    ).withColumn("pct_of_all_output_usd", pct("usd_final_text_that_could_not_be_read", ws.bill_total("output_usd")))


# ---------------------------------------------------------------- waiting

HUMAN_USD_PER_HOUR = 60.0
LONGEST_WAIT_S = 1800


def turn_times(ws: Workspace) -> DataFrame:
    """Agent time of a turn and the human time before it (longer pauses are breaks)."""
    def build():
        worked, waited = seconds_between("user_ts", "last_call_ts_adj"), seconds_between("prev_last_call_ts_adj", "user_ts")
        t = ws.turns.where("user_ts IS NOT NULL AND last_call_ts_adj IS NOT NULL").select(
            "session_id", "agent", "turn_idx", "n_calls", "turn_cost_usd", worked.alias("agent_time_s"),
            F.when(waited.between(0, LONGEST_WAIT_S), waited).alias("human_time_s"))
        s = ws.sessions_x.select("session_id", "mode", "committed_lines")
        return t.where("agent_time_s >= 0").join(s, "session_id")
    return ws.table("turn_times", build)


def _hours(x):
    return F.sum(x) / 3600.0


@result("t12_by_agent")
def waiting_by_agent(ws: Workspace) -> DataFrame:
    return ws.grouped(
        turn_times(ws), ["agent"],
        [rows().alias("turns"), _hours("agent_time_s").alias("agent_hours"), _hours("human_time_s").alias("human_wait_hours"),
         F.sum("turn_cost_usd").alias("usd"), ratio(F.sum("turn_cost_usd"), _hours("agent_time_s")).alias("usd_per_agent_hour")],
        {"median_agent_time_s": med("agent_time_s"), "p90_agent_time_s": (F.col("agent_time_s"), 0.9),
         "median_human_time_s": med("human_time_s")},
    ).orderBy(F.desc("turns"), "agent")


@result("t12_by_mode")
def waiting_by_mode(ws: Workspace) -> DataFrame:
    watch = HUMAN_USD_PER_HOUR * _hours("agent_time_s")
    return ws.grouped(
        turn_times(ws), ["mode"],
        [rows().alias("turns"), _hours("agent_time_s").alias("agent_hours"), _hours("human_time_s").alias("human_wait_hours"),
         F.sum("turn_cost_usd").alias("token_usd"), watch.alias("human_usd_if_watching_at_60ph"),
         ratio(watch, F.sum("turn_cost_usd")).alias("ratio_wait_cost_to_token_cost")],
        {"median_agent_time_s": med("agent_time_s")},
    ).orderBy(F.desc("agent_hours"), "mode")


@result("t12_per_session")
def waiting_per_session(ws: Workspace) -> DataFrame:
    s = turn_times(ws).groupBy("session_id").agg(
        F.max("agent").alias("agent"), _hours("agent_time_s").alias("h"), _hours("human_time_s").alias("wait"),
        F.sum("turn_cost_usd").alias("cost"))
    return ws.grouped(
        s, ["agent"], [rows().alias("sessions"), F.sum("h").alias("agent_hours"), F.sum("cost").alias("usd")],
        {"median_agent_hours_per_session": med("h"), "p90_agent_hours_per_session": (F.col("h"), 0.9),
         "median_human_hours_per_session": med("wait")},
    ).orderBy(F.desc("agent_hours"), "agent")


@result("t12_agent_time_buckets")
def waiting_buckets(ws: Workspace) -> DataFrame:
    bucket = bands("agent_time_s", [(30, "1. <30 s"), (120, "2. 0.5-2 min"), (600, "3. 2-10 min"), (1800, "4. 10-30 min")], "5. >30 min")
    n = turn_times(ws).agg(rows()).scalar()
    return turn_times(ws).groupBy(bucket.alias("bucket")).agg(
        rows().alias("turns"), _hours("agent_time_s").alias("agent_hours"), F.sum("turn_cost_usd").alias("usd"),
    ).withColumn("pct_of_turns", pct("turns", n)).orderBy("bucket")


@result("t12_headline")
def waiting_headline(ws: Workspace) -> DataFrame:
    hours, cost = _hours("agent_time_s"), F.sum("turn_cost_usd")
    return ws.grouped(
        turn_times(ws), [],
        [hours.alias("total_agent_working_hours"), cost.alias("total_token_usd_in_those_turns"),
         (HUMAN_USD_PER_HOUR * hours).alias("human_usd_at_60_per_hour_if_watching"),
         ratio(HUMAN_USD_PER_HOUR * hours, cost).alias("ratio_human_wait_cost_to_token_cost"),
         _hours("human_time_s").alias("total_human_typing_and_thinking_hours"),
         ratio(cost, hours).alias("usd_of_tokens_per_agent_hour")],
        {"median_agent_seconds_per_turn": med("agent_time_s")})


# ---------------------------------------------------------------- harness text


def injections(ws: Workspace) -> DataFrame:
    """Events that carry text into the prompt side."""
    e = ws.events.where("payload_chars > 0").select(
        "session_id", "event_type", F.coalesce("subtype", "event_type").alias("subtype"), "payload_chars")
    return e.join(ws.sessions_x.select("session_id", "agent", "harness_version", "mode"), "session_id")


def _attached():
    return sum_where(F.col("event_type") == "attachment", "payload_chars")


@result("t24_injected_by_subtype")
def injected_kinds(ws: Workspace, n: int | None = None) -> DataFrame:
    return at_most(ws.grouped(
        injections(ws).withColumnRenamed("payload_chars", "_c"), ["agent", "event_type", "subtype"],
        [rows().alias("events"), F.sum("_c").alias("payload_chars"), chars_as_tokens(F.sum("_c")).alias("payload_tokens")],
        {"median_payload_chars": med("_c")},
    ).orderBy(F.desc("payload_chars"), "agent", "event_type", "subtype"), n)


def _typed(ws):
    return ws.user_turns.where(~yes("is_meta"))


@result("t24_injected_vs_human_by_agent")
def injected_against_typed(ws: Workspace) -> DataFrame:
    inj = injections(ws).groupBy("agent").agg(F.sum("payload_chars").alias("injected_chars"), _attached().alias("attachment_chars"))
    typed = _typed(ws).groupBy("agent").agg(F.sum("human_chars").alias("human_chars"))
    return inj.join(typed, "agent", "left").withColumns({
        "pct_injected_of_prompt_side": pct("injected_chars", F.col("injected_chars") + F.col("human_chars")),
        "pct_attachments_of_prompt_side": pct("attachment_chars", F.col("attachment_chars") + F.col("human_chars")),
    }).orderBy(F.desc("injected_chars"), "agent")


@result("t24_by_version_claude_code")
def injected_by_version(ws: Workspace, min_sessions: int = 50) -> DataFrame:
    inj = injections(ws).where("agent = 'claude_code' AND harness_version IS NOT NULL").groupBy("harness_version").agg(
        F.count_distinct("session_id").alias("sessions"), _attached().alias("_att"))
    s = ws.sessions_x.where("agent = 'claude_code'").select("session_id", "harness_version")
    typed = _typed(ws).select("session_id", "human_chars").join(s, "session_id").groupBy("harness_version").agg(
        F.sum("human_chars").alias("_typed"))
    return inj.where(F.col("sessions") >= min_sessions).join(typed, "harness_version", "left").select(
        "harness_version", version_key("harness_version").alias("vkey"), "sessions",
        ratio("_att", "sessions").alias("attachment_chars_per_session"), ratio("_typed", "sessions").alias("human_chars_per_session"),
        pct("_att", F.col("_att") + F.col("_typed")).alias("pct_injected"),
    ).orderBy(F.asc_nulls_last("vkey"), "harness_version")


@result("t24_per_session_distribution")
def injected_per_session(ws: Workspace) -> DataFrame:
    p = injections(ws).groupBy("session_id").agg(F.max("agent").alias("agent"), _attached().alias("chars"))
    return ws.grouped(
        p, ["agent"], [rows().alias("sessions"), F.max("chars").alias("max_attachment_chars")],
        {"median_attachment_chars_per_session": med("chars"), "p90_attachment_chars_per_session": (F.col("chars"), 0.9)},
    ).orderBy(F.desc("sessions"), "agent")


@result("t24_headline")
def injected_headline(ws: Workspace) -> DataFrame:
    typed = _typed(ws).agg(F.sum("human_chars")).scalar()
    return injections(ws).agg(
        _attached().alias("harness_attachment_chars"), chars_as_tokens(_attached()).alias("harness_attachment_tokens"),
        F.sum("payload_chars").alias("all_event_payload_chars"),
        rows_where(F.col("event_type") == "attachment").alias("attachment_events"),
    ).withColumn("human_typed_chars", typed).withColumn(
        "pct_of_prompt_side_written_by_the_harness",
        pct("harness_attachment_chars", F.col("harness_attachment_chars") + F.col("human_typed_chars")))
