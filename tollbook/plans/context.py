"""What fills the context: expired caches, repeated and long-lived results, truncation,
compaction, re-reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tollbook.functions.metrics import (
    at_most, bands, call_tie, chars_as_tokens, lead_part, millis_between, pct, rows, rows_where, sum_where, total, usd, yes, zero,
)
from tollbook.operators.neighbourhood import pairs_within, rows_in_reach, sums_behind
from tollbook.operators.quantiles import med
from tollbook.operators.running import Carry, lookback, lookahead, running
from tollbook.plans.catalog_of_results import result
from tollbook.plans.workspace import Workspace

# ---------------------------------------------------------------- cache breaks


def call_gaps(ws: Workspace) -> DataFrame:
    """claude_code main-line calls in time order with the gap to the previous one. A cache
    break re-writes at least half of the previous context."""
    def build():
        c = ws.calls_priced.where("agent = 'claude_code' AND NOT is_sidechain AND ts IS NOT NULL").select(
            "session_id", "seq", "ts", "month", "ctx_tokens", "cache_create_tokens", "c5m_tokens", "c1h_tokens",
            "cache_write_usd", "cost_usd", call_tie().alias("_tie"))
        c = running(c, ["session_id"], ["ts", "seq", "_tie"], [lookback("prev", "ctx_tokens", "ts")], ws.time_blocks())
        before = F.col("prev.ctx_tokens")
        return c.where("prev IS NOT NULL").withColumns({
            "gap_min": millis_between("prev.ts", "ts") / 60000.0,
            "cache_break": yes((before > 0) & (zero("cache_create_tokens") >= 0.5 * before)),
        }).drop("prev", "_tie")
    return ws.table("call_gaps", build)


@result("t02_by_gap_bucket")
def breaks_by_gap(ws: Workspace) -> DataFrame:
    broke = F.col("cache_break")
    n = call_gaps(ws).agg(rows()).scalar()
    bucket = bands("gap_min", [(1, "1. <1 min"), (5, "2. 1-5 min"), (60, "3. 5-60 min")], "4. >60 min")
    return ws.grouped(
        call_gaps(ws).withColumn("gap_bucket", bucket), ["gap_bucket"],
        [rows().alias("calls"), rows_where(broke).alias("breaks"), pct(rows_where(broke), rows()).alias("break_rate_pct"),
         total("cache_create_tokens").alias("recached_tokens"),
         sum_where(broke, zero("cache_create_tokens")).alias("recached_tokens_on_breaks"),
         total("cache_write_usd").alias("cache_write_usd"),
         sum_where(broke, zero("cache_write_usd")).alias("cache_write_usd_on_breaks")],
        {"median_gap_min": med("gap_min")},
    ).withColumn("pct_of_calls", pct("calls", n)).orderBy("gap_bucket")


@result("t02_break_rate_fine_grained")
def breaks_by_fine_gap(ws: Workspace) -> DataFrame:
    bucket = bands("gap_min", [
        (0.25, "1. <15 s"), (1, "2. 15-60 s"), (5, "3. 1-5 min"), (20, "4. 5-20 min"), (60, "5. 20-60 min"),
        (300, "6. 1-5 h")], "7. >5 h")
    return call_gaps(ws).groupBy(bucket.alias("gap_bucket")).agg(
        rows().alias("calls"), pct(rows_where(F.col("cache_break")), rows()).alias("break_rate_pct"),
        total("cache_write_usd").alias("cache_write_usd")).orderBy("gap_bucket")


@result("t02_ttl_era_by_month")
def cache_lifetimes(ws: Workspace) -> DataFrame:
    return call_gaps(ws).where("month IS NOT NULL").groupBy("month").agg(
        rows().alias("calls"), F.sum("c5m_tokens").alias("cache_write_5m_tokens"),
        F.sum("c1h_tokens").alias("cache_write_1h_tokens"),
        pct(F.sum("c1h_tokens"), F.sum(F.col("c5m_tokens") + F.col("c1h_tokens"))).alias("pct_tokens_1h"),
        total("cache_write_usd").alias("cache_write_usd"),
        pct(rows_where(F.col("cache_break")), rows()).alias("break_rate_pct")).orderBy("month")


@result("t02_gap_gt_5min_by_month")
def long_gaps(ws: Workspace) -> DataFrame:
    away = F.col("gap_min") > 5
    after = sum_where(away, zero("cache_write_usd"))
    return call_gaps(ws).where("month IS NOT NULL").groupBy("month").agg(
        rows_where(away).alias("calls_after_gap_gt_5min"), after.alias("cache_write_usd_after_gap_gt_5min"),
        pct(after, total("cache_write_usd")).alias("pct_of_month_cache_write_usd")).orderBy("month")


@result("t02_headline")
def cache_headline(ws: Workspace) -> DataFrame:
    gap, broke = F.col("gap_min"), F.col("cache_break")
    after = sum_where(gap > 5, zero("cache_write_usd"))
    return call_gaps(ws).agg(
        after.alias("usd_recached_after_gap_gt_5min"),
        pct(rows_where(broke & (gap < 1)), rows_where(gap < 1)).alias("break_rate_pct_gap_lt_1min"),
        pct(rows_where(broke & (gap > 60)), rows_where(gap > 60)).alias("break_rate_pct_gap_gt_60min"),
        sum_where(gap > 5, zero("cache_create_tokens")).alias("recached_tokens_after_gap_gt_5min"),
    ).withColumn("pct_of_all_cache_write_usd", pct("usd_recached_after_gap_gt_5min", ws.bill_total("cache_write_usd"))
    ).withColumn("pct_of_total_usd", pct("usd_recached_after_gap_gt_5min", ws.bill_total()))


# ---------------------------------------------------------------- repeated results


def repeat_marks(ws: Workspace) -> DataFrame:
    """Tool results, plus one negative row for the first sight of each (session, hash).

    Adding up ``mark`` (or ``mark * result_chars``) over any grouping gives the repeats in
    it: all results less the first ones. The first row of a hash is an aggregate, so a hash
    shared by a third of all results is reduced before it is exchanged. It takes no positions or
    prices, so none are worked out for it."""
    def build():
        cols = ["agent", "tool_kind", "seq", "command_head", "file_path", "result_chars"]
        seen = ws.tool_calls.where("session_id IS NOT NULL AND seq IS NOT NULL AND result_hash IS NOT NULL AND coalesce(result_chars, 0) > 0").select(
            "session_id", "result_hash", F.coalesce("tool_use_id", F.lit("")).alias("_tie"), *cols)
        row = F.struct(*cols)
        first = seen.groupBy("session_id", "result_hash").agg(
            F.min_by(row, F.struct("seq", "_tie", "result_chars")).alias("_first"), rows().alias("occ_total"))
        return seen.select("session_id", *cols, F.lit(1).alias("mark"), F.lit(1).alias("is_row"),
                           F.lit(None).cast("long").alias("occ_total")).unionByName(
            first.select("session_id", "_first.*", F.lit(-1).alias("mark"), F.lit(0).alias("is_row"), "occ_total"))
    return ws.table("repeat_marks", build)


def priced_marks(ws: Workspace) -> DataFrame:
    """``repeat_marks`` with the prices of their sessions; sessions that are not listed have none."""
    attrs = ws.sessions_x.select("session_id", F.lit(True).alias("in_catalog"), "p_input", "p_cache_read")
    return repeat_marks(ws).join(attrs, "session_id", "left").withColumn("in_catalog", yes("in_catalog"))


def _again():
    return F.sum("mark")


def _again_chars(x="result_chars"):
    """NULL when the group has no repeat at all, as a filtered sum would be."""
    return F.when(_again() > 0, F.sum(F.col("mark") * F.col(x)))


@result("t03_by_agent")
def repeats_by_agent(ws: Workspace) -> DataFrame:
    n, chars = F.sum("is_row"), F.sum(F.col("is_row") * F.col("result_chars"))
    return repeat_marks(ws).groupBy("agent").agg(
        n.alias("tool_results"), _again().alias("repeated_results"), pct(_again(), n).alias("pct_results_repeated"),
        chars.alias("result_chars"), _again_chars().alias("repeated_chars"),
        pct(_again_chars(), chars).alias("pct_chars_repeated")).orderBy(F.desc("result_chars"), "agent")


@result("t03_by_tool_kind")
def repeats_by_kind(ws: Workspace, min_results: int = 500) -> DataFrame:
    n, chars = F.sum("is_row"), F.sum(F.col("is_row") * F.col("result_chars"))
    return repeat_marks(ws).groupBy("agent", "tool_kind").agg(
        n.alias("tool_results"), _again().alias("repeated_results"), pct(_again(), n).alias("pct_results_repeated"),
        _again_chars().alias("repeated_chars"), pct(_again_chars(), chars).alias("pct_chars_repeated"),
    ).where(F.col("tool_results") >= min_results).orderBy(F.desc_nulls_last("repeated_chars"), "agent", "tool_kind")


@result("t03_usd_by_agent")
def repeats_usd(ws: Workspace) -> DataFrame:
    marks = priced_marks(ws).where("in_catalog")
    def cost(price):
        return F.when(F.sum(F.when(F.col(price).isNotNull(), F.col("mark"))) > 0,
                      F.sum(F.col("mark") * usd(chars_as_tokens("result_chars"), price)))
    return marks.groupBy("agent").agg(
        _again_chars().alias("repeated_chars"), chars_as_tokens(_again_chars()).alias("repeated_tokens"),
        cost("p_input").alias("usd_lower_bound"), cost("p_cache_read").alias("usd_if_cached_once"),
    ).orderBy(F.desc_nulls_last("usd_lower_bound"), "agent")


@result("t03_top_repeated_bash_commands")
def repeated_commands(ws: Workspace, n: int = 20) -> DataFrame:
    return repeat_marks(ws).where("tool_kind = 'bash' AND command_head IS NOT NULL").groupBy("command_head").agg(
        _again().alias("repeated_occurrences"), F.count_distinct("session_id").alias("sessions"),
        _again_chars().alias("repeated_chars"),
    ).select(
        lead_part("command_head", 90).alias("command_head_90"), "*").drop("command_head").where("repeated_occurrences > 0").orderBy(F.desc("repeated_occurrences"), "command_head_90").limit(n)


@result("t03_top_repeated_files")
def repeated_files(ws: Workspace, n: int = 20) -> DataFrame:
    return repeat_marks(ws).where("tool_kind = 'read' AND file_path IS NOT NULL").groupBy("file_path", "tool_kind").agg(
        _again().alias("repeated_occurrences"), F.count_distinct("session_id").alias("sessions"),
        _again_chars().alias("repeated_chars"),
    ).select(
        lead_part("file_path", 90).alias("file_path_90"), "*").drop("file_path").where("repeated_occurrences > 0").orderBy(F.desc("repeated_chars"), "file_path_90").limit(n)


@result("t03_worst_offender_sessions")
def repeating_sessions(ws: Workspace, n: int = 20) -> DataFrame:
    return repeat_marks(ws).groupBy("session_id").agg(
        F.max("agent").alias("agent"), _again().alias("repeated_results"), _again_chars().alias("repeated_chars"),
        F.max("occ_total").alias("max_times_same_result"),
    ).orderBy(F.desc_nulls_last("repeated_chars"), "session_id").limit(n)


@result("t03_headline")
def repeats_headline(ws: Workspace) -> DataFrame:
    n, chars = F.sum("is_row"), F.sum(F.col("is_row") * F.col("result_chars"))
    bound = F.sum(F.when(F.col("in_catalog"), F.col("mark") * usd(chars_as_tokens("result_chars"), "p_input")))
    return priced_marks(ws).agg(
        pct(_again_chars(), chars).alias("pct_of_tool_result_chars_exact_repeats"),
        _again().alias("repeated_tool_results"), pct(_again(), n).alias("pct_of_tool_results_repeated"),
        _again_chars().alias("repeated_chars"), bound.alias("usd_lower_bound_fresh_input"))


# ---------------------------------------------------------------- context rent


def rents(ws: Workspace) -> DataFrame:
    """A result is read again by every later call of its session, at the cache-read price."""
    later = F.greatest(F.col("n_calls") - F.col("calls_before"), F.lit(0))
    r = ws.tool_facts.where("in_catalog AND coalesce(result_chars, 0) > 0").withColumn("later_calls", later)
    r = r.withColumn("rent_tokens", chars_as_tokens("result_chars") * F.col("later_calls"))
    return r.withColumn("rent_usd", usd("rent_tokens", "p_cache_read"))


def _rent_sums():
    return [F.sum("result_chars").alias("result_chars"), F.avg("later_calls").alias("avg_later_calls"),
            F.sum("rent_tokens").alias("rent_tokens"), F.sum("rent_usd").alias("rent_usd")]


@result("t04_by_tool_kind")
def rent_by_kind(ws: Workspace, n: int | None = None) -> DataFrame:
    return at_most(rents(ws).groupBy("agent", "tool_kind").agg(rows().alias("tool_results"), *_rent_sums()).orderBy(
        F.desc_nulls_last("rent_usd"), "agent", "tool_kind"), n)


@result("t04_by_result_size_bucket")
def rent_by_size(ws: Workspace) -> DataFrame:
    size = bands("result_chars", [(1000, "1. <1k"), (10000, "2. 1-10k"), (50000, "3. 10-50k")], "4. >50k")
    whole = rents(ws).agg(rows().alias("n"), F.sum("result_chars").alias("chars"), F.sum("rent_usd").alias("usd"))
    return rents(ws).groupBy(size.alias("size_bucket")).agg(rows().alias("tool_results"), *_rent_sums()).withColumns({
        "pct_of_results": pct("tool_results", whole.select("n").scalar()),
        "pct_of_result_chars": pct("result_chars", whole.select("chars").scalar()),
        "pct_of_rent_usd": pct("rent_usd", whole.select("usd").scalar()),
    }).orderBy("size_bucket")


@result("t04_rent_vs_actual_cache_read")
def rent_against_bill(ws: Workspace) -> DataFrame:
    billed = ws.calls_priced.groupBy("agent").agg(
        total("cache_read_tokens").alias("cache_read_tokens"), total("cache_read_usd").alias("cache_read_usd"))
    return rents(ws).groupBy("agent").agg(F.sum("rent_tokens").alias("rent_tokens"), F.sum("rent_usd").alias("rent_usd")).join(
        billed, "agent").withColumns({
            "pct_of_cache_read_tokens": pct("rent_tokens", "cache_read_tokens"),
            "pct_of_cache_read_usd": pct("rent_usd", "cache_read_usd"),
        }).orderBy(F.desc_nulls_last("rent_usd"), "agent")


@result("t04_top20_single_results_by_rent")
def dearest_results(ws: Workspace, n: int = 20) -> DataFrame:
    return rents(ws).select(
        "session_id", "seq", "agent", "tool_kind",
        F.coalesce(lead_part("command_head", 70), lead_part("file_path", 70)).alias("what"),
        "result_chars", "later_calls", "rent_tokens", "rent_usd",
    ).orderBy(F.desc_nulls_last("rent_usd"), "session_id", "seq").limit(n)


@result("t04_headline")
def rent_headline(ws: Workspace) -> DataFrame:
    claude, big = F.col("agent") == "claude_code", F.col("result_chars") > 10000
    read = ws.calls_priced.where(F.col("agent") == "claude_code").agg(total("cache_read_tokens")).scalar()
    return rents(ws).agg(
        sum_where(claude, "rent_tokens").alias("_claude_tokens"),
        sum_where(claude, "rent_usd").alias("rent_usd_claude_code"),
        F.sum("rent_usd").alias("rent_usd_all_agents_upper_bound"),
        sum_where(big, "rent_usd").alias("rent_usd_from_results_over_10k_chars"),
        pct(sum_where(big, "rent_usd"), F.sum("rent_usd")).alias("pct_of_rent_from_results_over_10k"),
        pct(rows_where(big), rows()).alias("pct_of_results_over_10k_chars"),
        F.sum("rent_tokens").alias("rent_tokens_all_agents_upper_bound"),
    ).withColumn("pct_of_claude_code_cache_read_tokens_from_tool_results", pct("_claude_tokens", read)).drop("_claude_tokens")


# ---------------------------------------------------------------- truncated replies


def continuations(ws: Workspace) -> DataFrame:
    """Main-line calls with the input side of the next one; truncated = hit the output cap."""
    def build():
        side = zero("input_usd") + zero("cache_read_usd") + zero("cache_write_usd")
        c = ws.calls_priced.where(~F.col("is_sidechain")).select(
            "session_id", "agent", "seq", "model", "stop_reason", "output_tokens", "ctx_tokens",
            zero("cost_usd").alias("cost_usd"), side.alias("input_side_usd"), call_tie().alias("_tie"))
        c = running(c, ["session_id"], ["seq", "_tie"], [lookahead("after", "input_side_usd", "ctx_tokens")], ws.blocks())
        return c.withColumns({
            "next_call_input_usd": F.col("after.input_side_usd"), "next_call_ctx_tokens": F.col("after.ctx_tokens"),
            "truncated": yes(F.col("stop_reason").isin("max_tokens", "length")),
        }).drop("after", "_tie", "input_side_usd")
    return ws.table("continuations", build)


@result("t06_by_agent")
def truncated_by_agent(ws: Workspace) -> DataFrame:
    cut = F.col("truncated")
    return continuations(ws).groupBy("agent").agg(
        rows().alias("calls"), rows_where(cut).alias("truncated_calls"),
        pct(rows_where(cut), rows()).alias("pct_calls_truncated"),
        sum_where(cut, "next_call_input_usd").alias("usd_of_continuation_input"),
        sum_where(cut, "next_call_ctx_tokens").alias("continuation_ctx_tokens"),
    ).orderBy(F.desc("truncated_calls"), "agent")


@result("t06_by_model")
def truncated_by_model(ws: Workspace) -> DataFrame:
    return continuations(ws).where("truncated").groupBy("model", "stop_reason").agg(
        rows().alias("truncated_calls"), F.count_distinct("session_id").alias("sessions"),
        F.avg("output_tokens").alias("avg_output_tokens"),
        F.sum("next_call_input_usd").alias("usd_of_continuation_input"),
    ).orderBy(F.desc("truncated_calls"), "model", "stop_reason")


@result("t06_stop_reason_distribution")
def stop_reasons(ws: Workspace) -> DataFrame:
    c = continuations(ws)
    whole = c.groupBy("agent").agg(rows().alias("_n"))
    return c.groupBy("agent", "stop_reason").agg(rows().alias("calls")).join(whole, "agent").select(
        "agent", "stop_reason", "calls", pct("calls", "_n").alias("pct_of_agent_calls"),
    ).orderBy("agent", F.desc("calls"), "stop_reason")


@result("t06_headline")
def truncated_headline(ws: Workspace) -> DataFrame:
    cut = F.col("truncated")
    paid = sum_where(cut, "next_call_input_usd")
    return continuations(ws).agg(
        rows_where(cut).alias("truncated_calls"), pct(rows_where(cut), rows()).alias("pct_of_all_calls_truncated"),
        F.count_distinct(F.when(cut, F.col("session_id"))).alias("sessions_affected"),
        paid.alias("usd_paid_to_resume_after_truncation"),
    ).withColumn("pct_of_total_usd", pct(zero("usd_paid_to_resume_after_truncation"), ws.bill_total()))


# ---------------------------------------------------------------- compaction

REACH = 20


def boundaries(ws: Workspace) -> DataFrame:
    e = ws.events.where(
        ((F.col("event_type") == "system") & F.col("subtype").isin("compact_boundary", "microcompact_boundary"))
        | (F.col("event_type") == "compacted"))
    return e.select("session_id", "agent", "seq", "subtype", "value").join(
        ws.seq_pos.select("session_id", "seq", "tools_before", "calls_before"), ["session_id", "seq"])


def reads_after_boundary(ws: Workspace) -> DataFrame:
    """Reads among the 20 tool calls after a boundary."""
    def build():
        reads = ws.tool_facts.where("in_catalog AND tool_kind = 'read' AND file_path IS NOT NULL")
        first = reads.groupBy("session_id", "file_path").agg(F.min("seq").alias("first_read_seq"))
        reads = reads.select("session_id", F.col("seq").alias("read_seq"), "file_path", "tools_before",
                             zero("result_chars").alias("result_chars"), "p_cache_read", "p_cache_write_5m")
        marks = boundaries(ws).select("session_id", "agent", F.col("seq").alias("boundary_seq"), "subtype", "value", "tools_before")
        near = pairs_within(marks, reads, ["session_id"], "tools_before", 1, REACH)
        tokens = chars_as_tokens("result_chars")
        return near.join(first, ["session_id", "file_path"]).withColumns({
            "was_read_before_boundary": F.col("first_read_seq") < F.col("boundary_seq"),
            "reread_usd_one_pass": usd(tokens, "p_cache_read"),
            "reread_usd_recached": usd(tokens, F.coalesce("p_cache_write_5m", "p_cache_read")),
        })
    return ws.table("reads_after_boundary", build)


@result("t19_boundaries_by_subtype")
def boundary_kinds(ws: Workspace) -> DataFrame:
    return boundaries(ws).groupBy("agent", F.coalesce("subtype", F.lit("compacted")).alias("event_kind")).agg(
        rows().alias("boundaries"), F.count_distinct("session_id").alias("sessions"),
    ).orderBy(F.desc("boundaries"), "agent", "event_kind")


@result("t19_sessions_with_compaction")
def compacted_sessions(ws: Workspace) -> DataFrame:
    per = boundaries(ws).groupBy("session_id").agg(rows().alias("boundaries"))
    s = ws.sessions_x.where("n_calls > 0").select("session_id", "agent", "session_cost_usd").join(per, "session_id", "left")
    hit = yes(F.col("boundaries") > 0)
    return ws.grouped(
        s, ["agent"],
        [rows().alias("sessions"), rows_where(hit).alias("sessions_with_a_boundary"),
         pct(rows_where(hit), rows()).alias("pct_sessions_compacted"), F.max("boundaries").alias("max_boundaries"),
         sum_where(hit, "session_cost_usd").alias("usd_in_compacted_sessions")],
        {"median_boundaries_when_present": med(F.when(hit, F.col("boundaries")))},
    ).orderBy(F.desc("sessions"), "agent")


def _reread_sums():
    seen = F.col("was_read_before_boundary")
    return [sum_where(seen, "result_chars"), sum_where(seen, "reread_usd_one_pass"), sum_where(seen, "reread_usd_recached")]


@result("t19_rereads_after_boundary")
def rereads(ws: Workspace) -> DataFrame:
    seen = F.col("was_read_before_boundary")
    chars, once, again = _reread_sums()
    return reads_after_boundary(ws).groupBy("agent", F.coalesce("subtype", F.lit("compacted")).alias("event_kind")).agg(
        rows().alias("reads_in_next_20_tool_calls"), rows_where(seen).alias("reads_of_already_seen_paths"),
        pct(rows_where(seen), rows()).alias("pct_rereads"), chars.alias("reread_chars"),
        once.alias("reread_usd_one_pass"), again.alias("reread_usd_recached"),
    ).orderBy(F.desc("reads_in_next_20_tool_calls"), "agent", "event_kind")


@result("t19_top_reread_files")
def reread_files(ws: Workspace, n: int = 20) -> DataFrame:
    return reads_after_boundary(ws).where("was_read_before_boundary").groupBy("file_path").agg(
        rows().alias("rereads_after_a_boundary"), F.count_distinct("session_id").alias("sessions"),
        F.sum("result_chars").alias("chars"),
    ).select(
        lead_part("file_path", 80).alias("file_path_80"), "*").drop("file_path").orderBy(F.desc("rereads_after_a_boundary"), "file_path_80").limit(n)


@result("t19_headline")
def compaction_headline(ws: Workspace) -> DataFrame:
    seen = F.col("was_read_before_boundary")
    chars, once, again = _reread_sums()
    b = boundaries(ws).agg(rows().alias("n"), F.count_distinct("session_id").alias("s"))
    return reads_after_boundary(ws).agg(
        rows().alias("reads_in_the_20_tool_calls_after_a_boundary"),
        pct(rows_where(seen), rows()).alias("pct_of_those_reads_already_seen"), chars.alias("reread_chars"),
        once.alias("usd_of_the_rereads_first_pass_only"), again.alias("usd_of_the_rereads_at_cache_write_price"),
    ).withColumn("compaction_boundaries", b.select("n").scalar()).withColumn("sessions_with_a_boundary", b.select("s").scalar())


# ---------------------------------------------------------------- reading back own writes


def file_visits(ws: Workspace) -> DataFrame:
    """Reads, edits and writes of a path with what happened to it earlier in the session."""
    def build():
        v = ws.tool_facts.where("in_catalog AND file_path IS NOT NULL AND tool_kind IN ('read', 'edit', 'write')")
        v = v.select(
            "session_id", "agent", "seq", "tool_kind", "file_path", "input_chars", "content_chars", "old_string_chars",
            "new_string_chars", "result_chars", "calls_before", "mode", "s_repo", "p_output", "p_input", "p_cache_read",
            # rows without an id come last among those of one record
            F.coalesce("tool_use_id", F.lit("￿")).alias("_tie"),
            F.coalesce("input_chars", F.lit(0)).alias("_tie2"))
        changed = F.col("tool_kind").isin("write", "edit")
        return running(
            v, ["session_id", "file_path"], ["seq", "_tie", "_tie2"],
            [Carry("earlier_touches", F.lit(1).cast("long"), inclusive=False),
             Carry("max_earlier_read_chars", F.when(F.col("tool_kind") == "read", F.col("result_chars")), "max", inclusive=False),
             Carry("last_mod_call_idx", F.when(changed, F.col("calls_before")), "max", inclusive=False)],
            ws.blocks()).drop("_tie", "_tie2").withColumn("earlier_touches", zero("earlier_touches"))
    return ws.table("file_visits", build)


def _just_written():
    return yes((F.col("calls_before") - F.col("last_mod_call_idx")).between(0, 5))


THRASH_CALLS, THRASH_EDITS = 10, 3


def thrash(ws: Workspace) -> DataFrame:
    """Edits of a file at one call number (``edits`` of them) with the number of edits of the same file in the
    10 calls up to it. Only call numbers are taken, not what happened to the file before."""
    def build():
        e = ws.tool_calls.where("file_path IS NOT NULL AND tool_kind IN ('edit', 'write')").select("session_id", "seq", "agent", "file_path")
        e = e.join(ws.sessions.select("session_id"), "session_id").join(ws.seq_pos.select("session_id", "seq", "calls_before"), ["session_id", "seq"])
        held = e.groupBy("session_id", "file_path", "calls_before", "agent").agg(rows().alias("edits"))
        return sums_behind(held, ["session_id", "file_path"], "calls_before", THRASH_CALLS, F.col("edits"), "edits_in_last_10_calls")
    return ws.table("thrash", build)


@result("t20_self_rereads")
def self_rereads(ws: Workspace) -> DataFrame:
    back = _just_written()
    chars = zero("result_chars")
    return file_visits(ws).where(F.col("tool_kind") == "read").groupBy("agent").agg(
        rows().alias("reads"), rows_where(back).alias("reads_within_5_calls_of_a_write"),
        pct(rows_where(back), rows()).alias("pct_of_reads"), sum_where(back, chars).alias("reread_chars"),
        sum_where(back, usd(chars_as_tokens(chars), "p_input")).alias("usd_fresh_input_price"),
    ).orderBy(F.desc_nulls_last("reread_chars"), "agent")


def _thrashed():
    return F.col("edits_in_last_10_calls") >= THRASH_EDITS


@result("t20_edit_thrash")
def edit_thrash(ws: Workspace) -> DataFrame:
    hot, n = _thrashed(), F.sum("edits")
    return thrash(ws).groupBy("agent").agg(
        n.alias("edits"), zero(sum_where(hot, "edits")).alias("edits_in_a_thrash_window"),
        pct(zero(sum_where(hot, "edits")), n).alias("pct_of_edits"),
        F.count_distinct(F.when(hot, F.struct("session_id", "file_path"))).alias("distinct_thrashed_files"),
    ).orderBy(F.desc("edits"), "agent")


@result("t20_top_thrashed_files")
def thrashed_files(ws: Workspace, n: int = 20) -> DataFrame:
    return thrash(ws).where(_thrashed()).groupBy("file_path").agg(
        F.max("agent").alias("agent"), F.sum("edits").alias("edits_in_thrash_windows"),
        F.count_distinct("session_id").alias("sessions"), F.max("edits_in_last_10_calls").alias("worst_burst"),
    ).select(
        lead_part("file_path", 80).alias("file_path_80"), "*").drop("file_path").orderBy(F.desc("edits_in_thrash_windows"), "file_path_80").limit(n)


@result("t20_headline")
def reread_headline(ws: Workspace) -> DataFrame:
    back = _just_written()
    chars = zero("result_chars")
    hot = zero(sum_where(_thrashed(), "edits"))
    t = thrash(ws).agg(hot.alias("n"), pct(hot, F.sum("edits")).alias("p"))
    return file_visits(ws).where(F.col("tool_kind") == "read").agg(
        rows_where(back).alias("reads_of_a_just_written_file"), pct(rows_where(back), rows()).alias("pct_of_all_reads"),
        sum_where(back, chars).alias("reread_chars"),
        sum_where(back, usd(chars_as_tokens(chars), "p_input")).alias("usd_at_fresh_input_price"),
    ).withColumn("edits_inside_a_thrash_window", t.select("n").scalar()).withColumn(
        "pct_of_edits_in_thrash", t.select("p").scalar())
