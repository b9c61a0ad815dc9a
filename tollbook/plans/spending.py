"""What was spent: the bill by agent, model, session and committed line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tollbook.functions.metrics import (
    at_most, call_tie, bands, pct, ratio, rows, rows_where, seconds_between, sum_where, total, usd, version_key, zero,
)
from tollbook.functions.models import model_family
from tollbook.operators.quantiles import med
from tollbook.operators.ranking import first_row
from tollbook.operators.running import Carry, running
from tollbook.plans.catalog_of_results import result
from tollbook.plans.workspace import Workspace

COMPONENTS = ["input_usd", "cache_read_usd", "cache_write_usd", "output_usd"]


def per_line(spent="session_cost_usd", lines="committed_lines"):
    return ratio(F.sum(spent), F.sum(lines))


# ---------------------------------------------------------------- baseline


@result("t01_by_agent")
def bill_by_agent(ws: Workspace) -> DataFrame:
    return ws.calls_priced.groupBy("agent").agg(
        F.count_distinct("session_id").alias("sessions"),
        rows().alias("calls"),
        total("cost_usd").alias("usd"),
        total("input_tokens").alias("input_tokens"),
        total("cache_read_tokens").alias("cache_read_tokens"),
        F.sum(F.col("c5m_tokens") + F.col("c1h_tokens")).alias("cache_write_tokens"),
        total("output_tokens").alias("output_tokens"),
        total("ctx_tokens").alias("ctx_tokens"),
    ).withColumn("pct_of_total_usd", pct("usd", ws.bill_total())).orderBy(F.desc("usd"), "agent")


@result("t01_by_model")
def bill_by_model(ws: Workspace) -> DataFrame:
    return ws.calls_priced.groupBy("model").agg(
        F.max("provider").alias("provider"),
        rows().alias("calls"),
        F.count_distinct("session_id").alias("sessions"),
        total("cost_usd").alias("usd"),
        *[total(c).alias(c) for c in COMPONENTS],
    ).orderBy(F.desc("usd"), "model")


@result("t01_components_by_agent")
def bill_components(ws: Workspace) -> DataFrame:
    sums = ws.calls_priced.rollup("agent").agg(
        F.grouping("agent").alias("_all"), total("cost_usd").alias("usd"), *[total(c).alias(c) for c in COMPONENTS])
    return sums.select(
        F.when(F.col("_all") == 1, "ALL").otherwise(F.col("agent")).alias("agent"), "usd", *COMPONENTS,
        *[pct(c, "usd").alias("pct_" + c.removesuffix("_usd")) for c in COMPONENTS],
    ).orderBy(F.desc("usd"), "agent")


@result("t01_usd_per_session")
def bill_per_session(ws: Workspace) -> DataFrame:
    s = ws.sessions_x.where("session_cost_usd IS NOT NULL AND n_calls > 0")
    cost = F.col("session_cost_usd")
    return ws.grouped(
        s, ["agent"],
        [rows().alias("sessions"), F.avg(cost).alias("mean_usd"), F.max(cost).alias("max_usd")],
        {"p50_usd": (cost, 0.5), "p90_usd": (cost, 0.9), "p99_usd": (cost, 0.99)},
    ).orderBy(F.desc("sessions"), "agent")


@result("t01_per_committed_line_by_mode")
def line_price_by_mode(ws: Workspace) -> DataFrame:
    return ws.sessions_x.where("n_calls > 0").groupBy("mode").agg(
        rows().alias("sessions"),
        F.sum("session_cost_usd").alias("usd"),
        F.sum("committed_lines").alias("committed_lines"),
        per_line().alias("usd_per_committed_line"),
        per_line("ctx_tokens").alias("ctx_tokens_per_committed_line"),
        per_line("output_tokens").alias("output_tokens_per_committed_line"),
    ).orderBy(F.desc("usd"), "mode")


@result("t01_per_committed_line_by_agent_mode")
def line_price_by_agent_mode(ws: Workspace) -> DataFrame:
    return ws.sessions_x.where("n_calls > 0").groupBy("agent", "mode").agg(
        rows().alias("sessions"),
        F.sum("session_cost_usd").alias("usd"),
        F.sum("committed_lines").alias("committed_lines"),
        per_line().alias("usd_per_committed_line"),
    ).orderBy(F.desc("usd"), "agent", "mode")


@result("t01_unpriced_share")
def unpriced_share(ws: Workspace) -> DataFrame:
    free = ~F.col("is_priced")
    tokens = zero("ctx_tokens") + zero("output_tokens")
    return ws.calls_priced.groupBy("agent").agg(
        rows().alias("calls"),
        rows_where(free).alias("unpriced_calls"),
        F.sum(tokens).alias("all_tokens"),
        F.sum(F.when(free, tokens).otherwise(0)).alias("unpriced_tokens"),
    ).withColumns({
        "pct_calls_unpriced": pct("unpriced_calls", "calls"),
        "pct_tokens_unpriced": pct("unpriced_tokens", "all_tokens"),
    }).orderBy(F.desc("calls"), "agent")


@result("t01_unpriced_models")
def unpriced_models(ws: Workspace) -> DataFrame:
    return ws.calls_priced.where(~F.col("is_priced")).groupBy("model").agg(
        rows().alias("calls"), total("ctx_tokens").alias("ctx_tokens"), total("output_tokens").alias("output_tokens"),
    ).orderBy(F.desc("calls"), "model")


@result("t01_headline")
def bill_headline(ws: Workspace) -> DataFrame:
    lines = ws.sessions_x.agg(ratio(total("session_cost_usd"), F.sum("committed_lines"))).scalar()
    cost = zero("cost_usd")
    by = {f"usd_{a}": F.sum(F.when(F.col("agent") == a, cost)) for a in ("claude_code", "codex", "opencode")}
    shares = {"cache_read": "cache_read_usd", "cache_write": "cache_write_usd", "output": "output_usd", "fresh_input": "input_usd"}
    return ws.calls_priced.agg(
        F.sum(cost).alias("total_usd"),
        *[v.alias(k) for k, v in by.items()],
        *[pct(total(c), F.sum(cost)).alias(f"pct_usd_{k}") for k, c in shares.items()],
        pct(rows_where(~F.col("is_priced")), rows()).alias("pct_calls_unpriced"),
    ).withColumn("usd_per_committed_line_all", lines)


# ---------------------------------------------------------------- entry cost


def entries(ws: Workspace) -> DataFrame:
    """The first priced main-line call of every session and what its fresh prompt cost."""
    def build():
        c = ws.calls_priced.where(~F.col("is_sidechain") & F.col("is_priced")).withColumn("_tie", call_tie())
        keep = ["agent", "harness_version", "month", "model", "provider", "input_tokens", "cache_create_tokens",
                "p_cache_write_5m", "p_input", "cost_usd"]
        first = first_row(c, "session_id", ["seq", "_tie"], keep)
        tokens = zero("input_tokens") + zero("cache_create_tokens")
        return first.withColumns({
            "entry_tokens": tokens,
            "entry_usd": F.when(F.col("provider") == "anthropic", usd(tokens, "p_cache_write_5m"))
                          .otherwise(usd(zero("input_tokens"), "p_input")),
            "first_call_usd": zero("cost_usd"),
            "vkey": version_key("harness_version"),
        })
    return ws.table("entries", build)


def _entry_stats(ws, df, keys):
    return ws.grouped(
        df, keys, [rows().alias("sessions"), F.sum("entry_usd").alias("total_entry_usd")],
        {"median_entry_tokens": med("entry_tokens"), "p90_entry_tokens": (F.col("entry_tokens"), 0.9),
         "median_entry_usd": med("entry_usd")})


def _entry_by_version(ws, agent, min_sessions):
    df = entries(ws).where((F.col("agent") == agent) & F.col("harness_version").isNotNull())
    return _entry_stats(ws, df, ["harness_version", "vkey"]).where(F.col("sessions") >= min_sessions).orderBy(
        F.asc_nulls_last("vkey"), "harness_version")


@result("t05_claude_code_by_version")
def entry_claude_versions(ws: Workspace, min_sessions: int = 50) -> DataFrame:
    return _entry_by_version(ws, "claude_code", min_sessions)


@result("t05_codex_by_version")
def entry_codex_versions(ws: Workspace, min_sessions: int = 20) -> DataFrame:
    return _entry_by_version(ws, "codex", min_sessions)


@result("t05_by_agent_month")
def entry_by_month(ws: Workspace) -> DataFrame:
    return _entry_stats(ws, entries(ws).where("month IS NOT NULL"), ["agent", "month"]).orderBy("agent", "month")


@result("t05_totals_by_agent")
def entry_totals(ws: Workspace) -> DataFrame:
    return ws.grouped(
        entries(ws), ["agent"],
        [rows().alias("sessions"), F.sum("entry_tokens").alias("total_entry_tokens"), F.sum("entry_usd").alias("total_entry_usd")],
        {"median_entry_tokens": med("entry_tokens")},
    ).withColumn("pct_of_total_usd", pct("total_entry_usd", ws.bill_total())).orderBy(F.desc("total_entry_usd"), "agent")


@result("t05_headline")
def entry_headline(ws: Workspace, min_sessions: int = 50) -> DataFrame:
    v = _entry_by_version(ws, "claude_code", min_sessions)
    row = F.struct("harness_version", "median_entry_tokens", "median_entry_usd")
    place = F.struct("vkey", "harness_version")
    ends = v.agg(F.min_by(row, place).alias("a"), F.max_by(row, place).alias("z"))
    spent = entries(ws).agg(F.sum("entry_usd")).scalar()
    return ends.select(
        F.col("a.harness_version").alias("first_claude_code_version"),
        F.col("a.median_entry_tokens").alias("median_entry_tokens_first_version"),
        F.col("z.harness_version").alias("last_claude_code_version"),
        F.col("z.median_entry_tokens").alias("median_entry_tokens_last_version"),
        (100.0 * (ratio("z.median_entry_tokens", "a.median_entry_tokens") - 1)).alias("pct_change_in_median_entry_tokens"),
        F.col("z.median_entry_usd").alias("median_entry_usd_last_version"),
    ).withColumn("total_entry_usd_all_sessions", spent).withColumn(
        "pct_of_total_usd", pct("total_entry_usd_all_sessions", ws.bill_total()))


# ---------------------------------------------------------------- abandoned sessions


def outcomes(ws: Workspace) -> DataFrame:
    lines = F.col("committed_lines")
    return ws.sessions_x.where("n_calls > 0").withColumn(
        "outcome", F.when(lines.isNull(), "no attribution").when(lines == 0, "zero committed lines").otherwise("committed"))


def _lost():
    return F.col("outcome") != "committed"


@result("t13_by_agent")
def outcome_by_agent(ws: Workspace) -> DataFrame:
    out = ws.grouped(
        outcomes(ws), ["agent", "outcome"], [rows().alias("sessions"), F.sum("session_cost_usd").alias("usd")],
        {"median_session_usd": med("session_cost_usd"), "median_calls": med("n_calls")})
    # three outcomes per agent at most
    agent = Window.partitionBy("agent")
    return out.withColumns({
        "pct_of_agent_sessions": pct("sessions", F.sum("sessions").over(agent)),
        "pct_of_agent_usd": pct("usd", F.sum("usd").over(agent)),
    }).orderBy("agent", "outcome")


@result("t13_by_mode")
def outcome_by_mode(ws: Workspace) -> DataFrame:
    whole = outcomes(ws).agg(F.sum("session_cost_usd")).scalar()
    return ws.grouped(
        outcomes(ws), ["mode", "outcome"], [rows().alias("sessions"), F.sum("session_cost_usd").alias("usd")],
        {"median_human_turns": med("n_human_turns"), "median_tool_calls": med("n_tool_calls")},
    ).withColumn("pct_of_all_usd", pct("usd", whole)).orderBy(F.desc("usd"), "mode", "outcome")


@result("t13_size_of_abandoned_sessions")
def abandoned_sizes(ws: Workspace) -> DataFrame:
    size = bands("session_cost_usd", [(0.1, "1. <0.1 USD"), (1, "2. 0.1-1 USD"), (10, "3. 1-10 USD")], "4. >10 USD")
    return ws.grouped(
        outcomes(ws).where(_lost()).withColumn("usd_bucket", size), ["usd_bucket"],
        [rows().alias("abandoned_sessions"), F.sum("session_cost_usd").alias("usd")],
        {"median_calls": med("n_calls"), "median_human_turns": med("n_human_turns")},
    ).orderBy("usd_bucket")


@result("t13_where_do_they_die")
def last_prompt_position(ws: Workspace, min_calls: int = 3) -> DataFrame:
    """Relative position of the last human prompt, plain and weighted by cost.

    The weighted median is the smallest position at which the cost so far reaches half:
    costs are summed per position first, so equal positions move together."""
    last = ws.prompts.groupBy("session_id").agg(F.max("seq").alias("seq"))
    s = outcomes(ws).where(F.col("n_calls") > min_calls).select("session_id", "outcome", "session_cost_usd", "n_calls")
    at = ws.seq_pos.select("session_id", "seq", "calls_before")
    placed = s.join(last, "session_id").join(at, ["session_id", "seq"]).withColumn(
        "rel_position", ratio("calls_before", "n_calls"))
    steps = placed.groupBy("outcome", "rel_position").agg(F.sum("session_cost_usd").alias("step_usd"))
    parts = F.floor(F.col("rel_position") * 1024).cast("long")
    climbed = running(steps, ["outcome"], ["rel_position"], [Carry("cum_usd", F.col("step_usd"))], parts)
    halves = climbed.groupBy("outcome").agg(F.sum("step_usd").alias("tot_usd"))
    mid = climbed.join(halves, "outcome").groupBy("outcome").agg(
        F.min(F.when(F.col("cum_usd") >= 0.5 * F.col("tot_usd"), F.col("rel_position"))).alias("usd_weighted_median_position"))
    return ws.grouped(
        placed, ["outcome"], [rows().alias("sessions"), F.sum("session_cost_usd").alias("usd")],
        {"median_position_of_last_prompt": med("rel_position")},
    ).join(mid, "outcome", "left").orderBy(F.desc("usd"), "outcome")


@result("t13_most_expensive_abandoned")
def dearest_abandoned(ws: Workspace, n: int = 20) -> DataFrame:
    return outcomes(ws).where(_lost()).select(
        "session_id", "agent", "repo", "mode", "session_cost_usd", "n_calls", "n_human_turns", "n_tool_calls", "outcome",
    ).orderBy(F.desc_nulls_last("session_cost_usd"), "session_id").limit(n)


@result("t13_headline")
def abandoned_headline(ws: Workspace) -> DataFrame:
    lost = _lost()
    cost = F.col("session_cost_usd")
    return ws.grouped(
        outcomes(ws), [],
        [rows_where(lost).alias("abandoned_sessions"),
         pct(rows_where(lost), rows()).alias("pct_of_sessions_abandoned"),
         sum_where(lost, cost).alias("usd_abandoned"),
         pct(sum_where(lost, cost), F.sum(cost)).alias("pct_of_total_usd_abandoned"),
         sum_where(F.col("outcome") == "zero committed lines", cost).alias("usd_zero_committed_lines"),
         sum_where(F.col("outcome") == "no attribution", cost).alias("usd_no_attribution")],
        {"median_usd_of_an_abandoned_session": med(F.when(lost, cost))})


# ---------------------------------------------------------------- harness against model


def comparable(ws: Workspace) -> DataFrame:
    """Sessions of repos in which at least two agents worked; cursor reports no usage."""
    used = ws.sessions_x.where("n_calls > 0 AND agent IS NOT NULL")
    shared = used.groupBy("repo").agg(F.count_distinct("agent").alias("_n")).where("_n >= 2").select("repo")
    return used.where(F.col("agent") != "cursor").join(shared, "repo", "left_semi").withColumn(
        "model_family", model_family(F.col("session_model")))


def _line_bill(df, keys, min_sessions, *more):
    return df.groupBy(*keys).agg(
        rows().alias("sessions"), F.sum("session_cost_usd").alias("usd"), F.sum("committed_lines").alias("committed_lines"),
        per_line().alias("usd_per_committed_line"), *more).where(F.col("sessions") >= min_sessions)


@result("t15_by_agent_model_family")
def shared_repos_by_family(ws: Workspace, min_sessions: int = 10) -> DataFrame:
    return _line_bill(
        comparable(ws), ["agent", "model_family"], min_sessions,
        per_line("ctx_tokens").alias("ctx_tokens_per_committed_line"),
        per_line("output_tokens").alias("output_tokens_per_committed_line"),
    ).orderBy(F.desc("usd"), "agent", "model_family")


@result("t15_by_mode")
def shared_repos_by_mode(ws: Workspace, min_sessions: int = 10) -> DataFrame:
    return _line_bill(comparable(ws), ["mode", "agent"], min_sessions).orderBy("mode", F.desc("usd"), "agent")


@result("t15_by_repo_agent")
def shared_repos_by_repo(ws: Workspace, min_sessions: int = 10) -> DataFrame:
    return _line_bill(comparable(ws), ["repo", "agent"], min_sessions).where("committed_lines > 0").orderBy(
        "repo", F.desc("usd"), "agent")


@result("t15_headline")
def shared_repos_headline(ws: Workspace) -> DataFrame:
    per_agent = comparable(ws).groupBy("agent").agg(per_line().alias("upl"))
    repos = comparable(ws).agg(F.count_distinct("repo")).scalar()
    known = F.when(F.col("upl").isNotNull(), F.struct("upl", "agent"))
    ends = per_agent.agg(F.min(known).alias("a"), F.max(F.when(F.col("upl").isNotNull(), F.struct("upl", "agent"))).alias("z"))
    return ends.select(
        F.col("a.agent").alias("cheapest_agent_per_committed_line"), F.col("a.upl").alias("cheapest_usd_per_committed_line"),
        F.col("z.agent").alias("dearest_agent_per_committed_line"), F.col("z.upl").alias("dearest_usd_per_committed_line"),
        ratio("z.upl", "a.upl").alias("ratio_dearest_to_cheapest"),
    ).withColumn("repos_with_two_or_more_agents", repos)


# ---------------------------------------------------------------- fast mode


@result("t21_speed_share")
def speed_share(ws: Workspace) -> DataFrame:
    c = ws.calls_priced.where(F.col("agent") == "claude_code")
    bill = c.agg(rows().alias("n"), total("cost_usd").alias("usd"))
    return c.groupBy(F.coalesce("speed", F.lit("not recorded")).alias("speed")).agg(
        rows().alias("calls"), F.count_distinct("session_id").alias("sessions"), total("cost_usd").alias("usd"),
        total("output_tokens").alias("output_tokens"),
    ).withColumn("pct_of_calls", pct("calls", bill.select("n").scalar())).withColumn(
        "pct_of_usd", pct("usd", bill.select("usd").scalar())).orderBy(F.desc("calls"), "speed")


@result("t21_fast_sessions_vs_standard")
def fast_sessions(ws: Workspace) -> DataFrame:
    """Only sessions with at least one timed turn take part."""
    s = ws.sessions_x.where("agent = 'claude_code' AND n_calls > 0").select(
        "session_id", "session_cost_usd", "committed_lines",
        F.when(F.col("n_fast_calls") > 0, "uses fast").otherwise("never fast").alias("kind"))
    timed = ws.turns.where("user_ts IS NOT NULL AND last_call_ts_adj IS NOT NULL").select(
        "session_id", seconds_between("user_ts", "last_call_ts_adj").alias("took_s"))
    pace = ws.grouped(timed, ["session_id"], [rows().alias("_turns")], {"median_agent_time_s": med("took_s")})
    return ws.grouped(
        s.join(pace, "session_id"), ["kind"],
        [rows().alias("sessions"), F.sum("session_cost_usd").alias("usd"), per_line().alias("usd_per_committed_line")],
        {"median_agent_time_s_per_turn": med("median_agent_time_s")},
    ).orderBy(F.desc("sessions"), "kind")


@result("t21_fast_by_month")
def fast_by_month(ws: Workspace) -> DataFrame:
    fast = F.col("speed") == "fast"
    return ws.calls_priced.where("agent = 'claude_code' AND month IS NOT NULL").groupBy("month").agg(
        rows_where(fast).alias("fast_calls"), rows().alias("calls"), pct(rows_where(fast), rows()).alias("pct_fast"),
        sum_where(fast, zero("cost_usd")).alias("fast_usd")).orderBy("month")


@result("t21_headline")
def fast_headline(ws: Workspace) -> DataFrame:
    fast = F.col("speed") == "fast"
    return ws.calls_priced.where(F.col("agent") == "claude_code").agg(
        rows_where(fast).alias("fast_calls"),
        pct(rows_where(fast), rows()).alias("pct_of_claude_code_calls"),
        sum_where(fast, zero("cost_usd")).alias("fast_usd"),
        pct(sum_where(fast, zero("cost_usd")), total("cost_usd")).alias("pct_of_claude_code_usd"),
        F.count_distinct(F.when(fast, F.col("session_id"))).alias("sessions_using_fast"),
        pct(rows_where(F.col("speed").isNull()), rows()).alias("pct_of_calls_without_a_speed_field"))


# ---------------------------------------------------------------- same user, same repo, other model


def switchers(ws: Workspace, min_sessions: int = 3) -> DataFrame:
    """User x repo cells in which at least two models each ran ``min_sessions`` sessions."""
    nobody = F.substring(F.md5(F.lit("unknown")), 1, 10)
    s = ws.sessions_x.where("n_calls > 0 AND session_model IS NOT NULL").where(F.col("user_hash") != nobody)
    cells = s.groupBy("user_hash", "repo", "session_model").agg(
        rows().alias("sessions"), F.sum("session_cost_usd").alias("usd"), F.sum("committed_lines").alias("committed_lines"),
        F.sum("ctx_tokens").alias("ctx_tokens"), F.sum("output_tokens").alias("output_tokens"),
    ).where(F.col("sessions") >= min_sessions)
    several = cells.groupBy("user_hash", "repo").agg(rows().alias("_n")).where("_n >= 2")
    return cells.join(several.select("user_hash", "repo"), ["user_hash", "repo"], "left_semi")


@result("t22_pairs")
def switch_pairs(ws: Workspace, min_sessions: int = 3) -> DataFrame:
    return switchers(ws, min_sessions).select(
        "user_hash", "repo", "session_model", "sessions", "usd", "committed_lines",
        ratio("usd", "committed_lines").alias("usd_per_committed_line"),
        ratio("ctx_tokens", "committed_lines").alias("ctx_tokens_per_committed_line"),
    ).orderBy("user_hash", "repo", F.desc("usd"), "session_model")


@result("t22_model_totals_within_switchers")
def switch_models(ws: Workspace, min_sessions: int = 3) -> DataFrame:
    return switchers(ws, min_sessions).groupBy("session_model").agg(
        rows().alias("user_repo_cells"), F.sum("sessions").alias("sessions"), F.sum("usd").alias("usd"),
        F.sum("committed_lines").alias("committed_lines"),
        per_line("usd").alias("usd_per_committed_line"),
        per_line("output_tokens").alias("output_tokens_per_committed_line"),
    ).orderBy(F.desc("usd"), "session_model")


def _cheapest_and_dearest(ws, min_sessions):
    cells = switchers(ws, min_sessions).where("committed_lines > 0").withColumn("upl", ratio("usd", "committed_lines"))
    return cells.groupBy("user_hash", "repo").agg(
        rows().alias("_models"), F.min(F.struct("upl", "session_model")).alias("a"),
        F.max(F.struct("upl", "session_model")).alias("z")).where("_models >= 2")


@result("t22_within_pair_comparison")
def switch_extremes(ws: Workspace, min_sessions: int = 3, n: int | None = None) -> DataFrame:
    return at_most(_cheapest_and_dearest(ws, min_sessions).select(
        "user_hash", "repo",
        F.col("a.session_model").alias("cheapest_model"), F.col("a.upl").alias("cheapest_usd_per_line"),
        F.col("z.session_model").alias("dearest_model"), F.col("z.upl").alias("dearest_usd_per_line"),
        ratio("z.upl", "a.upl").alias("ratio"),
    ).orderBy(F.desc_nulls_last("ratio"), "user_hash", "repo"), n)


@result("t22_headline")
def switch_headline(ws: Workspace, min_sessions: int = 3) -> DataFrame:
    spread = _cheapest_and_dearest(ws, min_sessions).withColumn("ratio", ratio("z.upl", "a.upl"))
    middle = ws.grouped(spread, [], [rows().alias("_n")], {"m": med("ratio")}).select("m").scalar()
    return switchers(ws, min_sessions).agg(
        F.count_distinct("user_hash", "repo").alias("user_repo_pairs_that_switched_models"),
        F.count_distinct("session_model").alias("models_involved"),
        F.sum("sessions").alias("sessions"), F.sum("usd").alias("usd"),
        per_line("usd").alias("usd_per_committed_line_overall"),
    ).withColumn("median_dearest_to_cheapest_ratio_within_a_pair", middle)


# ---------------------------------------------------------------- local hour

# Minutes from UTC, northern summer.
ZONE_MINUTES = {
    "Europe/Berlin": 120, "Europe/Paris": 120, "Europe/Madrid": 120, "Europe/Stockholm": 120,
    "Europe/Amsterdam": 120, "Europe/Brussels": 120, "Europe/Rome": 120, "Europe/Athens": 180,
    "Europe/London": 60, "Etc/UTC": 0, "America/Los_Angeles": -420, "America/Denver": -360,
    "America/Chicago": -300, "America/New_York": -240, "America/Toronto": -240,
    "America/Sao_Paulo": -180, "Asia/Tokyo": 540, "Asia/Shanghai": 480, "Asia/Kolkata": 330,
    "Asia/Karachi": 300, "Africa/Nairobi": 180, "Australia/Melbourne": 600,
}
NIGHT, DAY, EVENING = "1. night 0-6", "2. day 6-18", "3. evening 18-24"


def local_starts(ws: Workspace) -> DataFrame:
    """Local hour of the first timed codex call of every session."""
    def build():
        c = ws.calls_priced.where("agent = 'codex' AND ts IS NOT NULL AND timezone IS NOT NULL")
        c = c.withColumn("_tie", call_tie())
        first = first_row(c, "session_id", ["seq", "_tie"], ["timezone", "ts"])
        offsets = F.create_map(*[F.lit(x) for pair in ZONE_MINUTES.items() for x in pair])
        moved = first.withColumn("offset_min", F.try_element_at(offsets, F.col("timezone"))).where("offset_min IS NOT NULL")
        hour = F.hour(F.col("ts") + F.make_dt_interval(mins=F.col("offset_min")))
        # only these columns of a session: its model, version and home folder need counts of all their values
        s = ws.sessions.select("session_id", F.col("attr_total_committed").alias("committed_lines"))
        s = s.join(ws.session_bills.select("session_id", "session_cost_usd"), "session_id", "left").join(ws.session_tools, "session_id", "left").select(
            "session_id", "session_cost_usd", "committed_lines", zero("n_tool_calls").alias("n_tool_calls"), zero("n_tool_errors").alias("n_tool_errors"))
        return moved.withColumn("local_hour", hour.cast("long")).withColumn(
            "hour_bucket", bands("local_hour", [(6, NIGHT), (18, DAY)], EVENING)).drop("ts").join(s, "session_id")
    return ws.table("local_starts", build)


def _hour_stats():
    nothing = zero("committed_lines") == 0
    return [
        F.sum("session_cost_usd").alias("usd"),
        pct(F.sum("n_tool_errors"), F.sum("n_tool_calls")).alias("tool_error_rate_pct"),
        pct(rows_where(nothing), rows()).alias("abandonment_rate_pct"),
        per_line().alias("usd_per_committed_line"),
    ]


@result("t23_sessions_per_local_hour")
def starts_by_hour(ws: Workspace) -> DataFrame:
    return local_starts(ws).groupBy("local_hour").agg(rows().alias("sessions"), *_hour_stats()).orderBy("local_hour")


@result("t23_by_hour_bucket")
def starts_by_part_of_day(ws: Workspace) -> DataFrame:
    n = local_starts(ws).agg(rows()).scalar()
    return ws.grouped(
        local_starts(ws), ["hour_bucket"], [rows().alias("sessions"), *_hour_stats()],
        {"median_session_usd": med("session_cost_usd")},
    ).withColumn("pct_of_sessions", pct("sessions", n)).orderBy("hour_bucket")


@result("t23_by_timezone")
def starts_by_zone(ws: Workspace) -> DataFrame:
    return local_starts(ws).groupBy("timezone", "offset_min").agg(
        rows().alias("sessions"), F.sum("session_cost_usd").alias("usd"),
        pct(rows_where(F.col("local_hour") < 6), rows()).alias("pct_started_at_night"),
    ).orderBy(F.desc("sessions"), "timezone")


@result("t23_headline")
def starts_headline(ws: Workspace) -> DataFrame:
    night, day = F.col("hour_bucket") == NIGHT, F.col("hour_bucket") == DAY
    lost = zero("committed_lines") == 0
    cost, lines = F.col("session_cost_usd"), F.col("committed_lines")
    return ws.grouped(
        local_starts(ws), [],
        [rows().alias("codex_sessions_with_a_timezone"),
         pct(rows_where(night), rows()).alias("pct_of_sessions_started_at_night"),
         pct(sum_where(night, cost), F.sum(cost)).alias("pct_of_codex_usd_spent_at_night"),
         pct(rows_where(night & lost), rows_where(night)).alias("abandonment_rate_pct_night"),
         pct(rows_where(day & lost), rows_where(day)).alias("abandonment_rate_pct_day"),
         ratio(sum_where(night, cost), sum_where(night, lines)).alias("usd_per_committed_line_night"),
         ratio(sum_where(day, cost), sum_where(day, lines)).alias("usd_per_committed_line_day")],
        {"median_session_usd_night": med(F.when(night, cost))})
