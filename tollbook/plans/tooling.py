"""How tools are used: missing paths, ceremony, polling, rewriting, hot files, subagents,
permission modes, interrupts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tollbook.functions.metrics import (
    at_most, bands, chars_as_tokens, lead_part, pct, ratio, rows, rows_where, sum_where, total, usd, yes, zero,
)
from tollbook.operators.neighbourhood import rows_in_reach
from tollbook.operators.quantiles import Distinct, med
from tollbook.operators.ranking import most_frequent
from tollbook.operators.running import Carry, running
from tollbook.plans.catalog_of_results import result
from tollbook.plans.context import file_visits
from tollbook.plans.spending import per_line
from tollbook.plans.workspace import Workspace

# ---------------------------------------------------------------- missing paths

# The wordings of a missing path.
MISSING = "(does not exist|No such file|ENOENT|not found|File not found)"


def file_calls(ws: Workspace) -> DataFrame:
    """File tool calls; those that named a missing path carry the USD of the next 3 calls.

    Only the failures look the later bill up, by equality on (session, call number)."""
    def build():
        missing = yes("is_error") & F.coalesce("error_head", F.lit("")).rlike(MISSING)
        t = ws.tool_facts.where("in_catalog AND tool_kind IN ('read', 'edit', 'write')").select(
            "session_id", "agent", "seq", "tool_kind", "file_path", "session_model", "mode", "calls_before", "cum_cost_usd",
            F.least(F.col("calls_before") + 3, F.col("n_calls")).alias("call_idx"), missing.alias("missing_path"))
        bill = ws.calls_idx.select("session_id", "call_idx", F.col("cum_cost_usd").alias("_then"))
        failed = t.where("missing_path").join(bill, ["session_id", "call_idx"], "left").withColumn(
            "usd_next_3_calls", F.coalesce("_then", "cum_cost_usd") - F.col("cum_cost_usd")).drop("_then")
        fine = t.where("NOT missing_path").withColumn("usd_next_3_calls", F.lit(None).cast("double"))
        return failed.unionByName(fine)
    return ws.table("file_calls", build)


@result("t07_by_agent")
def missing_by_agent(ws: Workspace) -> DataFrame:
    bad = F.col("missing_path")
    return file_calls(ws).groupBy("agent").agg(
        rows().alias("file_tool_calls"), rows_where(bad).alias("missing_path_errors"),
        pct(rows_where(bad), rows()).alias("pct_missing_path"),
        F.count_distinct(F.when(bad, F.col("session_id"))).alias("sessions_affected"),
        F.sum("usd_next_3_calls").alias("usd_of_next_3_calls"),
    ).orderBy(F.desc("missing_path_errors"), "agent")


@result("t07_by_model")
def missing_by_model(ws: Workspace, min_calls: int = 1000) -> DataFrame:
    bad = F.col("missing_path")
    return file_calls(ws).groupBy(F.col("session_model").alias("model")).agg(
        rows().alias("file_tool_calls"), rows_where(bad).alias("missing_path_errors"),
        pct(rows_where(bad), rows()).alias("pct_missing_path"), F.sum("usd_next_3_calls").alias("usd_of_next_3_calls"),
    ).where(F.col("file_tool_calls") >= min_calls).orderBy(F.desc("pct_missing_path"), "model")


@result("t07_by_tool_kind")
def missing_by_kind(ws: Workspace) -> DataFrame:
    bad = F.col("missing_path")
    return file_calls(ws).groupBy("agent", "tool_kind").agg(
        rows().alias("calls"), rows_where(bad).alias("missing_path_errors"),
        pct(rows_where(bad), rows()).alias("pct_missing_path"),
    ).orderBy(F.desc("missing_path_errors"), "agent", "tool_kind")


@result("t07_top_missing_paths")
def missing_paths(ws: Workspace, n: int = 20) -> DataFrame:
    return file_calls(ws).where("missing_path AND file_path IS NOT NULL").groupBy("file_path").agg(
        rows().alias("errors"), F.count_distinct("session_id").alias("sessions"),
    ).select(
        lead_part("file_path", 80).alias("file_path_80"), "*").drop("file_path").orderBy(F.desc("errors"), "file_path_80").limit(n)


@result("t07_headline")
def missing_headline(ws: Workspace) -> DataFrame:
    bad = F.col("missing_path")
    return file_calls(ws).agg(
        rows_where(bad).alias("missing_path_errors"), pct(rows_where(bad), rows()).alias("pct_of_file_tool_calls"),
        F.count_distinct(F.when(bad, F.col("session_id"))).alias("sessions_affected"),
        F.sum("usd_next_3_calls").alias("usd_of_the_next_3_calls_after_the_error"),
    ).withColumn("pct_of_total_usd", pct("usd_of_the_next_3_calls_after_the_error", ws.bill_total()))


# ---------------------------------------------------------------- ceremony


def ceremonies(ws: Workspace) -> DataFrame:
    """Tool calls with the output tokens their input took to write."""
    tokens = chars_as_tokens(zero("input_chars"))
    return ws.tool_facts.where("in_catalog").select(
        "session_id", "agent", "tool_kind", "input_chars", "mode", "committed_lines", "session_cost_usd",
        tokens.alias("ceremony_tokens"), usd(tokens, "p_output").alias("ceremony_usd"),
        F.col("tool_kind").isin("todo", "task").alias("is_ceremony"))


@result("t08_by_agent")
def ceremony_by_agent(ws: Workspace) -> DataFrame:
    own, kind = yes("is_ceremony"), F.col("tool_kind")
    return ceremonies(ws).groupBy("agent").agg(
        rows().alias("tool_calls"), rows_where(own).alias("ceremony_calls"), pct(rows_where(own), rows()).alias("pct_of_tool_calls"),
        sum_where(kind == "todo", "ceremony_tokens").alias("todo_tokens"),
        sum_where(kind == "task", "ceremony_tokens").alias("task_tokens"),
        sum_where(own, "ceremony_usd").alias("ceremony_usd"),
    ).orderBy(F.desc_nulls_last("ceremony_usd"), "agent")


@result("t08_sessions_with_vs_without")
def ceremony_sessions(ws: Workspace) -> DataFrame:
    s = ceremonies(ws).groupBy("session_id").agg(
        F.max("mode").alias("mode"), F.max("committed_lines").alias("committed_lines"),
        F.max("session_cost_usd").alias("session_cost_usd"), F.bool_or(yes("is_ceremony")).alias("_own"))
    kind = F.when(F.col("_own"), "uses todo/task").otherwise("no todo/task")
    return s.groupBy("mode", kind.alias("kind")).agg(
        rows().alias("sessions"), pct(rows_where(F.col("committed_lines") > 0), rows()).alias("pct_sessions_with_commits"),
        F.sum("session_cost_usd").alias("usd"), F.sum("committed_lines").alias("committed_lines"),
        per_line().alias("usd_per_committed_line")).orderBy("mode", "kind")


@result("t08_by_agent_and_kind")
def ceremony_by_kind(ws: Workspace) -> DataFrame:
    return ws.grouped(
        ceremonies(ws).where("is_ceremony"), ["agent", "tool_kind"],
        [rows().alias("calls"), F.sum("ceremony_tokens").alias("tokens"), F.sum("ceremony_usd").alias("usd")],
        {"median_input_chars": med("input_chars")},
    ).orderBy(F.desc_nulls_last("usd"), "agent", "tool_kind")


@result("t08_headline")
def ceremony_headline(ws: Workspace) -> DataFrame:
    own = yes("is_ceremony")
    return ceremonies(ws).agg(
        rows_where(own).alias("ceremony_tool_calls"), pct(rows_where(own), rows()).alias("pct_of_all_tool_calls"),
        sum_where(own, "ceremony_tokens").alias("output_tokens_spent_on_ceremony"),
        sum_where(own, "ceremony_usd").alias("ceremony_usd"),
    ).withColumn("pct_of_all_output_usd", pct("ceremony_usd", ws.bill_total("output_usd")))


# ---------------------------------------------------------------- polling

# The commands that only wait.
POLL = "(^|[;&| ])sleep [0-9]+|gh run watch|(^|[;&| ])wait($|[;&| ])"
BURST_CALLS = 5


def shell_calls(ws: Workspace) -> DataFrame:
    return ws.tool_facts.where("tool_kind = 'bash' AND command_head IS NOT NULL").select(
        "session_id", "agent", "seq", "command_head", "calls_before", F.col("command_head").rlike(POLL).alias("is_poll"))


def polls(ws: Workspace) -> DataFrame:
    """Waiting commands with the bill of the call that issued them and the number of polls
    in the 5 calls from there on."""
    def build():
        p = shell_calls(ws).where("is_poll")
        ahead = rows_in_reach(p, ["session_id"], "calls_before", 0, BURST_CALLS - 1, "polls_in_next_5_calls")
        issuer = ws.calls_idx.select("session_id", F.col("call_idx").alias("calls_before"),
                                     F.col("cost_usd").alias("call_usd"), "ctx_tokens")
        return p.join(ahead, ["session_id", "calls_before"]).join(issuer, ["session_id", "calls_before"], "left")
    return ws.table("polls", build)


@result("t09_by_agent")
def polls_by_agent(ws: Workspace) -> DataFrame:
    shells = shell_calls(ws).groupBy("agent").agg(rows().alias("bash_calls"))
    return polls(ws).groupBy("agent").agg(
        rows().alias("polling_calls"), F.count_distinct("session_id").alias("sessions"),
        F.sum("call_usd").alias("usd_of_the_calls_that_issued_them"), F.sum("ctx_tokens").alias("ctx_tokens"),
    ).join(shells, "agent").withColumn("pct_of_bash_calls", pct("polling_calls", "bash_calls")).orderBy(
        F.desc("polling_calls"), "agent")


@result("t09_polling_sequences")
def poll_bursts(ws: Workspace) -> DataFrame:
    n = F.col("polls_in_next_5_calls")
    burst = (F.when(n >= 4, "4+ polls in 5 calls").when(n == 3, "3 polls in 5 calls")
             .when(n == 2, "2 polls in 5 calls").otherwise("isolated"))
    return polls(ws).groupBy(burst.alias("burst")).agg(
        rows().alias("polling_calls"), F.sum("call_usd").alias("usd"), F.sum("ctx_tokens").alias("ctx_tokens"),
    ).orderBy(F.desc("polling_calls"), "burst")


@result("t09_top_polling_commands")
def poll_commands(ws: Workspace, n: int = 20) -> DataFrame:
    return polls(ws).groupBy("command_head").agg(
        rows().alias("polling_calls"), F.count_distinct("session_id").alias("sessions"), F.sum("call_usd").alias("usd"),
    ).select(
        lead_part("command_head", 80).alias("command_head_80"), "*").drop("command_head").orderBy(F.desc("polling_calls"), "command_head_80").limit(n)


@result("t09_headline")
def polls_headline(ws: Workspace) -> DataFrame:
    burst = F.col("polls_in_next_5_calls") >= 2
    n = shell_calls(ws).agg(rows()).scalar()
    return polls(ws).agg(
        rows().alias("polling_bash_calls"), F.count_distinct("session_id").alias("sessions_that_poll"),
        F.sum("call_usd").alias("usd_of_calls_that_issued_a_poll"), rows_where(burst).alias("polls_inside_a_burst"),
        sum_where(burst, "call_usd").alias("usd_in_bursts"),
    ).withColumn("pct_of_all_bash_calls", pct("polling_bash_calls", n)).withColumn(
        "pct_of_total_usd", pct("usd_of_calls_that_issued_a_poll", ws.bill_total()))


# ---------------------------------------------------------------- rewriting known files

BIG_QUOTE = 1500


def full_writes(ws: Workspace) -> DataFrame:
    tokens = chars_as_tokens(zero("content_chars"))
    return file_visits(ws).where("tool_kind = 'write' AND coalesce(content_chars, 0) > 0").withColumns({
        "content_tokens": tokens, "content_usd": usd(tokens, "p_output"),
        "rewrite_ratio": F.when(F.col("max_earlier_read_chars") > 0, ratio(zero("content_chars"), "max_earlier_read_chars")),
        "known": F.col("earlier_touches") > 0,
    })


def _overhead():
    extra = F.col("input_chars") - F.col("content_chars") - 40
    return F.when(F.col("input_chars").isNotNull() & (F.col("content_chars") > 100), ratio(extra, "content_chars"))


@result("t10_writes_on_known_files")
def known_writes(ws: Workspace) -> DataFrame:
    k = F.col("known")
    return full_writes(ws).groupBy("agent").agg(
        rows().alias("writes"), rows_where(k).alias("writes_on_known_files"),
        pct(rows_where(k), rows()).alias("pct_writes_on_known_files"),
        sum_where(k, "content_tokens").alias("output_tokens_on_known_files"),
        sum_where(k, "content_usd").alias("usd_on_known_files"), F.sum("content_usd").alias("usd_all_writes"),
    ).orderBy(F.desc_nulls_last("usd_on_known_files"), "agent")


@result("t10_rewrite_ratio_distribution")
def rewrite_ratios(ws: Workspace) -> DataFrame:
    r = F.col("rewrite_ratio")
    bucket = (F.when(r.isNull(), "0. no earlier read").when(r < 0.25, "1. <25% of the file").when(r < 0.9, "2. 25-90%")
              .when(r <= 1.1, "3. ~same size (90-110%)").otherwise("4. bigger than what was read"))
    return ws.grouped(
        full_writes(ws).where("known").withColumn("bucket", bucket), ["bucket"],
        [rows().alias("writes"), F.sum("content_tokens").alias("content_tokens"), F.sum("content_usd").alias("usd")],
        {"median_content_chars": med(zero("content_chars"))},
    ).orderBy("bucket")


@result("t10_big_old_string_edits")
def quoted_edits(ws: Workspace) -> DataFrame:
    big = F.col("old_string_chars") > BIG_QUOTE
    cost = usd(chars_as_tokens(zero("old_string_chars")), "p_output")
    return file_visits(ws).where("tool_kind = 'edit'").groupBy("agent").agg(
        rows().alias("edits"), rows_where(big).alias("edits_old_string_over_1500"), pct(rows_where(big), rows()).alias("pct"),
        sum_where(big, "old_string_chars").alias("old_string_chars"), sum_where(big, cost).alias("usd_old_string"),
        F.sum(cost).alias("usd_old_string_all_edits"),
    ).orderBy(F.desc_nulls_last("usd_old_string"), "agent")


@result("t10_json_overhead_for_writes")
def write_overhead(ws: Workspace) -> DataFrame:
    return ws.grouped(
        full_writes(ws).where("input_chars IS NOT NULL AND content_chars > 100"), ["agent"],
        [rows().alias("writes"), chars_as_tokens(F.sum(F.col("input_chars") - F.col("content_chars"))).alias("extra_tokens_vs_bare_content")],
        {"median_json_overhead_ratio": med(_overhead()), "p90_json_overhead_ratio": (_overhead(), 0.9)},
    ).orderBy(F.desc("writes"), "agent")


@result("t10_top_rewritten_files")
def rewritten_files(ws: Workspace, n: int = 20) -> DataFrame:
    return full_writes(ws).where("known").groupBy("file_path").agg(
        F.max("agent").alias("agent"), rows().alias("writes_on_known_file"), F.sum("content_chars").alias("content_chars"),
        F.sum("content_usd").alias("usd")).select(
        lead_part("file_path", 80).alias("file_path_80"), "*").drop("file_path").orderBy(F.desc_nulls_last("usd"), "file_path_80").limit(n)


@result("t10_headline")
def rewrite_headline(ws: Workspace) -> DataFrame:
    k = F.col("known")
    quotes = file_visits(ws).where(f"tool_kind = 'edit' AND old_string_chars > {BIG_QUOTE}").agg(
        F.sum(usd(chars_as_tokens("old_string_chars"), "p_output"))).scalar()
    return ws.grouped(
        full_writes(ws), [],
        [sum_where(k, "content_usd").alias("usd_output_writes_to_files_already_in_context"),
         rows_where(k).alias("writes_on_known_files"), pct(rows_where(k), rows()).alias("pct_of_writes_on_known_files"),
         sum_where(k, "content_tokens").alias("output_tokens_rewritten")],
        {"median_json_overhead_ratio": med(_overhead())},
    ).withColumn("pct_of_all_output_usd", pct("usd_output_writes_to_files_already_in_context", ws.bill_total("output_usd"))
    ).withColumn("usd_old_string_quotes_over_1500_chars", quotes)


# ---------------------------------------------------------------- hot files

HOT_SESSIONS = 10
SHORT_PROMPT = 200


def edits(ws: Workspace) -> DataFrame:
    """Edits and writes with what followed: an error within 3 tool calls, a short prompt.

    Tool calls of one record share a position. The next prompt (at or after the edit) comes
    from a running value over edits and prompts, taken from the end of the session."""
    def build():
        t = ws.tool_facts.select("session_id", "tools_before", "is_error")
        risky = rows_in_reach(t, ["session_id"], "tools_before", 1, 3, "_errors", where=yes("is_error"))
        e = ws.tool_facts.where("in_catalog AND tool_kind IN ('edit', 'write') AND file_path IS NOT NULL").select(
            "session_id", F.col("s_agent").alias("agent"), F.col("s_repo").alias("repo"), "user_hash", "mode", "seq", "ts", "tool_kind",
            "file_path", "tools_before", "calls_before", F.coalesce("tool_use_id", F.lit("")).alias("_tie"), F.lit(0).alias("_side"))
        asked = ws.prompts.select("session_id", "seq", F.lit("").alias("_tie"), F.lit(1).alias("_side"), "human_chars")
        line = e.unionByName(asked, allowMissingColumns=True)
        line = running(
            line, ["session_id"], ["seq", "_side", "_tie"],
            [Carry("next_human_chars", F.col("human_chars"), "last", backwards=True)], ws.blocks())
        line = line.where("_side = 0").drop("_side", "_tie", "human_chars")
        return line.join(risky, ["session_id", "tools_before"], "left").withColumns({
            "error_within_3_tool_calls": F.col("_errors").isNotNull(),
            "short_correction_next": yes(F.col("next_human_chars") < SHORT_PROMPT),
        }).drop("_errors")
    return ws.table("edits", build)


def edited_files(ws: Workspace) -> DataFrame:
    def build():
        return edits(ws).groupBy("repo", "file_path").agg(
            F.max("agent").alias("agent"), rows().alias("edits"), F.count_distinct("session_id").alias("sessions"),
            F.count_distinct("user_hash").alias("users"),
            rows_where(F.col("error_within_3_tool_calls")).alias("edits_before_error"),
            rows_where(F.col("short_correction_next")).alias("edits_before_short_prompt"),
        ).withColumns({
            "pct_edits_followed_by_error": pct("edits_before_error", "edits"),
            "pct_edits_followed_by_short_correction": pct("edits_before_short_prompt", "edits"),
        })
    return ws.table("edited_files", build)


def _heat():
    return F.when(F.col("sessions") >= HOT_SESSIONS, "hot (>=10 sessions)").otherwise("cold (<10 sessions)").alias("heat")


def file_ranks(ws: Workspace) -> DataFrame:
    """Percent rank of a file by edits inside its repo: the share of other files edited more.

    Files are counted per (repo, edits) first, so equal files are one row and a repo with a
    third of all files is ordered over its distinct edit counts only."""
    steps = edited_files(ws).groupBy("repo", "edits").agg(rows().alias("_files"))
    whole = Window.partitionBy("repo")
    more = whole.orderBy(F.desc("edits")).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumns({"_above": zero(F.sum("_files").over(more)), "repo_files": F.sum("_files").over(whole)}).withColumn(
        "pr", F.when(F.col("repo_files") > 1, ratio("_above", F.col("repo_files") - 1)).otherwise(F.lit(0.0))
    ).withColumn("step_edits", F.col("edits") * F.col("_files"))


@result("t14_top30_hot_files")
def hottest_files(ws: Workspace, min_repo_sessions: int = 20, n: int = 30) -> DataFrame:
    busy = edited_files(ws).groupBy("repo").agg(F.sum("sessions").alias("_n")).where(F.col("_n") >= min_repo_sessions)
    return edited_files(ws).join(busy.select("repo"), "repo", "left_semi").select(
        "repo", lead_part("file_path", 70).alias("file_path_70"), "agent", "sessions", "users", "edits",
        "pct_edits_followed_by_error", "pct_edits_followed_by_short_correction",
    ).orderBy(F.desc("sessions"), F.desc("edits"), "repo", "file_path_70").limit(n)


@result("t14_concentration_by_repo")
def edit_concentration(ws: Workspace, min_files: int = 50, n: int | None = None) -> DataFrame:
    def top(share):
        return pct(sum_where(F.col("pr") < share, "step_edits"), F.sum("step_edits"))
    return at_most(file_ranks(ws).groupBy("repo").agg(
        F.sum("_files").alias("files"), F.sum("step_edits").alias("edits"),
        top(0.05).alias("pct_of_edits_in_top_5pct_of_files"), top(0.20).alias("pct_of_edits_in_top_20pct_of_files"),
    ).where(F.col("files") >= min_files).orderBy(F.desc("edits"), "repo"), n)


@result("t14_hot_vs_cold")
def hot_against_cold(ws: Workspace) -> DataFrame:
    n = edited_files(ws).agg(F.sum("edits")).scalar()
    return ws.grouped(
        edited_files(ws).withColumn("heat", _heat()), ["heat"],
        [rows().alias("files"), F.sum("edits").alias("_edits"),
         F.avg("pct_edits_followed_by_error").alias("avg_pct_edits_followed_by_error"),
         F.avg("pct_edits_followed_by_short_correction").alias("avg_pct_edits_followed_by_short_correction")],
        {"median_edits_per_file": med("edits")},
    ).withColumnRenamed("_edits", "edits").withColumn("pct_of_all_edits", pct("edits", n)).orderBy("heat")


@result("t14_hot_vs_cold_weighted")
def hot_against_cold_weighted(ws: Workspace) -> DataFrame:
    """Every edit counts once; the per-file counts already hold them."""
    return edited_files(ws).groupBy(_heat()).agg(
        F.sum("edits").alias("edits"), pct(F.sum("edits_before_error"), F.sum("edits")).alias("pct_edits_followed_by_error"),
        pct(F.sum("edits_before_short_prompt"), F.sum("edits")).alias("pct_edits_followed_by_short_correction")).orderBy("heat")


@result("t14_edits_by_agent")
def edits_by_agent(ws: Workspace) -> DataFrame:
    return edits(ws).groupBy("agent").agg(
        rows().alias("edits"), pct(rows_where(F.col("error_within_3_tool_calls")), rows()).alias("pct_edits_followed_by_error"),
        pct(rows_where(F.col("short_correction_next")), rows()).alias("pct_edits_followed_by_short_correction"),
    ).orderBy(F.desc("edits"), "agent")


@result("t14_headline")
def hot_headline(ws: Workspace, min_repo_edits: int = 100) -> DataFrame:
    hot = F.col("sessions") >= HOT_SESSIONS
    per_repo = file_ranks(ws).groupBy("repo").agg(
        F.sum("step_edits").alias("_edits"), pct(sum_where(F.col("pr") < 0.05, "step_edits"), F.sum("step_edits")).alias("_share"))
    middle = ws.grouped(per_repo.where(F.col("_edits") >= min_repo_edits), [], [rows().alias("_n")], {"m": med("_share")})
    return edited_files(ws).agg(
        rows_where(hot).alias("hot_files"), pct(sum_where(hot, "edits"), F.sum("edits")).alias("pct_of_edits_on_hot_files"),
        pct(sum_where(hot, "edits_before_error"), sum_where(hot, "edits")).alias("pct_hot_file_edits_followed_by_error"),
        pct(sum_where(~hot, "edits_before_error"), sum_where(~hot, "edits")).alias("pct_cold_file_edits_followed_by_error"),
        zero(F.sum("edits")).alias("edits_total"),
    ).withColumn("median_repo_share_of_edits_in_top_5pct_of_files", middle.select("m").scalar())


# ---------------------------------------------------------------- subagents


def task_counts(ws: Workspace) -> DataFrame:
    return ws.tool_calls.where("tool_kind = 'task'").groupBy("session_id").agg(
        rows().alias("task_calls"), total("result_chars").alias("task_result_chars"))


@result("t16_sidechain_share")
def sidechain_share(ws: Workspace) -> DataFrame:
    side = F.col("is_sidechain")
    return ws.calls_priced.groupBy("agent").agg(
        rows().alias("calls"), rows_where(side).alias("sidechain_calls"), pct(rows_where(side), rows()).alias("pct_calls_sidechain"),
        total("cost_usd").alias("usd"), sum_where(side, zero("cost_usd")).alias("sidechain_usd"),
        pct(sum_where(side, zero("cost_usd")), total("cost_usd")).alias("pct_usd_sidechain"),
    ).orderBy(F.desc("usd"), "agent")


@result("t16_sessions_with_vs_without")
def subagent_sessions(ws: Workspace) -> DataFrame:
    s = ws.sessions_x.where("agent = 'claude_code' AND n_calls > 0").join(task_counts(ws), "session_id", "left")
    kind = (F.when(F.col("n_sidechain_calls") > 0, "has sidechain calls").when(F.col("task_calls") > 0, "uses the task tool")
            .otherwise("no subagents"))
    return ws.grouped(
        s.withColumn("kind", kind), ["kind", "mode"],
        [rows().alias("sessions"), F.sum("session_cost_usd").alias("usd"),
         pct(rows_where(F.col("committed_lines") > 0), rows()).alias("pct_sessions_with_commits"),
         F.sum("committed_lines").alias("_lines"), per_line().alias("usd_per_committed_line")],
        {"median_session_usd": med("session_cost_usd")},
    ).withColumnRenamed("_lines", "committed_lines").orderBy("kind", F.desc("usd"), "mode")


@result("t16_task_tool_usage")
def task_usage(ws: Workspace) -> DataFrame:
    return ws.grouped(
        ws.tool_facts.where("in_catalog AND tool_kind = 'task'").withColumn("agent", F.col("s_agent")), ["agent"],
        [rows().alias("task_calls"), Distinct("sessions", "session_id"), total("result_chars").alias("_chars"),
         F.sum(usd(chars_as_tokens(zero("input_chars")), "p_output")).alias("usd_of_the_task_prompts")],
        {"median_result_chars": med("result_chars")},
    ).withColumnRenamed("_chars", "result_chars").orderBy(F.desc("task_calls"), "agent")


@result("t16_headline")
def subagent_headline(ws: Workspace) -> DataFrame:
    side, claude = F.col("is_sidechain"), F.col("agent") == "claude_code"
    cost = zero("cost_usd")
    task = task_counts(ws).agg(zero(F.sum("task_calls")).alias("n"), F.sum("task_result_chars").alias("chars"), rows().alias("s"))
    return ws.calls_priced.agg(
        rows_where(side).alias("sidechain_calls"), sum_where(side, cost).alias("sidechain_usd"),
        pct(sum_where(side & claude, cost), sum_where(claude, cost)).alias("pct_of_claude_code_usd"),
    ).withColumn("task_tool_calls", task.select("n").scalar()).withColumn(
        "task_result_chars", task.select("chars").scalar()).withColumn("sessions_using_task", task.select("s").scalar())


# ---------------------------------------------------------------- permission modes

NO_MODE = "no permission-mode events"


def by_permission(ws: Workspace) -> DataFrame:
    picked = most_frequent(ws.events.where("event_type = 'permission-mode'"), "session_id", {"permission_mode": "value"})
    return ws.sessions_x.where("agent = 'claude_code' AND n_calls > 0").join(picked, "session_id", "left").withColumn(
        "permission_mode", F.coalesce("permission_mode", F.lit(NO_MODE)))


def _error_rate():
    return pct(F.sum("n_tool_errors"), F.sum("n_tool_calls")).alias("tool_error_rate_pct")


@result("t17_by_permission_mode")
def permission_modes(ws: Workspace) -> DataFrame:
    return ws.grouped(
        by_permission(ws), ["permission_mode"],
        [rows().alias("sessions"), F.sum("session_cost_usd").alias("usd"), F.sum("committed_lines").alias("_lines"),
         per_line().alias("usd_per_committed_line"), _error_rate(), per_line("n_tool_calls").alias("tool_calls_per_committed_line"),
         pct(rows_where(F.col("committed_lines") > 0), rows()).alias("pct_sessions_with_commits")],
        {"median_session_usd": med("session_cost_usd")},
    ).withColumnRenamed("_lines", "committed_lines").orderBy(F.desc("usd"), "permission_mode")


@result("t17_by_permission_mode_and_mode")
def permission_and_mode(ws: Workspace, min_sessions: int = 20) -> DataFrame:
    return by_permission(ws).groupBy("permission_mode", "mode").agg(
        rows().alias("sessions"), F.sum("session_cost_usd").alias("usd"), per_line().alias("usd_per_committed_line"), _error_rate(),
    ).where(F.col("sessions") >= min_sessions).orderBy("permission_mode", F.desc("usd"), "mode")


@result("t17_headline")
def permission_headline(ws: Workspace, min_sessions: int = 50) -> DataFrame:
    a = by_permission(ws).groupBy("permission_mode").agg(
        rows().alias("sessions"), F.sum("session_cost_usd").alias("usd"), per_line().alias("upl"), _error_rate(),
    ).where(F.col("sessions") >= min_sessions)
    def at(mode, col):
        return F.max(F.when(F.col("permission_mode") == mode, F.col(col)))
    bypass, default = "bypassPermissions", "default"
    return a.agg(
        at(bypass, "sessions").alias("sessions_on_bypass"), at(bypass, "usd").alias("usd_on_bypass"),
        at(bypass, "upl").alias("usd_per_committed_line_bypass"), at(default, "upl").alias("usd_per_committed_line_default"),
        at(bypass, "tool_error_rate_pct").alias("tool_error_rate_pct_bypass"),
        at(default, "tool_error_rate_pct").alias("tool_error_rate_pct_default"))


# ---------------------------------------------------------------- interrupts


def interrupts(ws: Workspace) -> DataFrame:
    """Interrupts with the calls and USD spent since the last prompt a human wrote before."""
    def build():
        human = ~yes("is_meta") & (F.col("human_chars") > 0)
        u = ws.user_turns.select("session_id", "agent", "seq", yes("is_interrupt").alias("is_interrupt"),
                                 F.coalesce("prompt_id", F.lit("")).alias("_tie"), F.when(human, F.col("seq")).alias("_human"))
        u = running(u, ["session_id"], ["seq", "_tie"],
                    [Carry("prev_user_seq", F.col("_human"), "max", inclusive=False)], ws.blocks())
        hit = u.where("is_interrupt").drop("_tie", "_human", "is_interrupt")
        now = ws.seq_pos.select("session_id", "seq", F.col("cum_cost_usd").alias("cum_usd_at_interrupt"), F.col("calls_before").alias("_now"))
        then = ws.seq_pos.select("session_id", F.col("seq").alias("prev_user_seq"),
                                 F.col("cum_cost_usd").alias("cum_usd_at_prev_prompt"), F.col("calls_before").alias("_then"))
        return hit.join(now, ["session_id", "seq"]).join(then, ["session_id", "prev_user_seq"], "left").withColumns({
            "sunk_usd": F.greatest(zero("cum_usd_at_interrupt") - zero("cum_usd_at_prev_prompt"), F.lit(0.0)),
            "sunk_calls": F.col("_now") - zero("_then"),
        }).drop("_now", "_then")
    return ws.table("interrupts", build)


@result("t18_interrupts_by_agent")
def interrupts_by_agent(ws: Workspace) -> DataFrame:
    return ws.grouped(
        interrupts(ws), ["agent"],
        [rows().alias("interrupts"), Distinct("sessions_with_interrupts", "session_id"), F.sum("sunk_usd").alias("_usd")],
        {"median_sunk_usd": med("sunk_usd"), "median_sunk_calls": med("sunk_calls")},
    ).withColumnRenamed("_usd", "sunk_usd").withColumn("pct_of_total_usd", pct("sunk_usd", ws.bill_total())).orderBy(
        F.desc("interrupts"), "agent")


@result("t18_queue_operations")
def queue_operations(ws: Workspace) -> DataFrame:
    """The median weighs every event by the number of events of its session."""
    q = ws.events.where("event_type = 'queue-operation'").groupBy("session_id").agg(rows().alias("n"))
    s = q.join(ws.sessions_x.select("session_id", "agent"), "session_id")
    each = ws.events.where("event_type = 'queue-operation'").select("session_id").join(s, "session_id")
    return ws.grouped(
        each, ["agent"], [Distinct("sessions_with_queue_events", "session_id"), rows().alias("queue_events")],
        {"median_queue_events_per_session": med("n")},
    ).orderBy(F.desc("queue_events"), "agent")


@result("t18_sessions_with_vs_without_interrupts")
def interrupted_sessions(ws: Workspace) -> DataFrame:
    kind = F.when(F.col("n_interrupts") > 0, "interrupted").otherwise("never interrupted")
    return ws.grouped(
        ws.sessions_x.where("n_calls > 0 AND agent = 'claude_code'").withColumn("kind", kind), ["kind", "mode"],
        [rows().alias("sessions"), F.sum("session_cost_usd").alias("usd"), F.sum("committed_lines").alias("_lines"),
         per_line().alias("usd_per_committed_line"),
         pct(rows_where(F.col("committed_lines") > 0), rows()).alias("pct_sessions_with_commits")],
        {"median_calls": med("n_calls")},
    ).withColumnRenamed("_lines", "committed_lines").orderBy("kind", F.desc("usd"), "mode")


@result("t18_headline")
def interrupt_headline(ws: Workspace) -> DataFrame:
    hit, calm = F.col("n_interrupts") > 0, (F.col("n_interrupts") == 0) & (F.col("n_calls") > 0)
    def upl(p):
        return ratio(sum_where(p, "session_cost_usd"), sum_where(p, "committed_lines"))
    s = ws.sessions_x.where("agent = 'claude_code'").agg(upl(hit).alias("hit"), upl(calm).alias("calm"))
    queued = ws.events.where("event_type = 'queue-operation'").agg(rows()).scalar()
    return interrupts(ws).agg(
        rows().alias("interrupts"), F.count_distinct("session_id").alias("sessions_with_at_least_one_interrupt"),
        F.sum("sunk_usd").alias("usd_sunk_before_interrupts"),
    ).withColumn("pct_of_total_usd", pct("usd_sunk_before_interrupts", ws.bill_total())).withColumn(
        "usd_per_committed_line_interrupted_sessions", s.select("hit").scalar()).withColumn(
        "usd_per_committed_line_calm_sessions", s.select("calm").scalar()).withColumn("queue_operation_events", queued)
