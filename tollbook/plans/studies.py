"""Studies built on top of the analyses: code survival, labels against cost, task use,
sleeping, concurrent edits, the closing bill."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tollbook.functions.metrics import bands, pct, ratio, rows, rows_where, sum_where, total, yes, zero
from tollbook.operators.quantiles import med
from tollbook.operators.running import Carry, running
from tollbook.plans.catalog_of_results import result
from tollbook.plans.context import call_gaps, rents
from tollbook.plans.people import final_replies
from tollbook.plans.spending import per_line
from tollbook.plans.tooling import edits, polls, task_counts
from tollbook.plans.workspace import Workspace

CHARS_PER_LINE = 40.0

# ---------------------------------------------------------------- code survival


def generated(ws: Workspace) -> DataFrame:
    """Sessions with committed lines and the characters of code they wrote."""
    wrote = ws.tool_calls.where("tool_kind IN ('write', 'edit')").groupBy("session_id").agg(
        F.sum(zero("content_chars") + zero("new_string_chars")).alias("gen_chars"))
    s = ws.sessions_x.where("committed_lines > 0").select("session_id", "agent", "mode", "committed_lines", "session_cost_usd")
    return s.join(wrote, "session_id", "left").withColumn("gen_chars", zero("gen_chars")).withColumn(
        "gen_lines", F.col("gen_chars") / CHARS_PER_LINE)


@result("code_survival")
def code_survival(ws: Workspace) -> DataFrame:
    return generated(ws).groupBy("agent", "mode").agg(
        rows().alias("sessions"), F.sum("gen_lines").alias("gen_lines_est"), F.sum("committed_lines").alias("_lines"),
        pct(F.sum("committed_lines"), F.sum("gen_lines")).alias("pct_survive_est"), F.sum("session_cost_usd").alias("usd"),
        per_line().alias("usd_per_committed_line"),
    ).withColumnRenamed("_lines", "committed_lines").orderBy("agent", "mode")


@result("survival_distribution_vibe")
def survival_distribution(ws: Workspace, min_chars: int = 400) -> DataFrame:
    p = pct("committed_lines", "gen_lines")
    bucket = (F.when(p < 10, "1. <10%").when(p < 25, "2. 10-25%").when(p < 50, "3. 25-50%").when(p < 75, "4. 50-75%")
              .when(p <= 100, "5. 75-100%").otherwise("6. >100%"))
    return generated(ws).where((F.col("mode") == "vibe") & (F.col("gen_chars") >= min_chars)).groupBy(
        bucket.alias("bucket")).agg(rows().alias("sessions")).orderBy("bucket")


# ---------------------------------------------------------------- labels

LONG_REPLY = 3000


def unread_by_next_label(ws: Workspace, labels: DataFrame) -> DataFrame:
    """Final replies grouped by the label of the prompt that followed them."""
    tag = labels.select("session_id", F.col("seq").alias("next_user_seq"), "label")
    r = final_replies(ws).join(tag, ["session_id", "next_user_seq"])
    u = F.col("unread")
    return ws.grouped(
        r, ["label"],
        [rows().alias("replies"), rows_where(u).alias("unread"), pct(rows_where(u), rows()).alias("pct_unread"),
         rows_where(u & (F.col("n_text_chars") > LONG_REPLY)).alias("unread_long_over_3000_chars")],
        {"median_reply_chars": med("n_text_chars"), "median_delta_s": med("delta_s")},
    ).orderBy(F.desc("replies"), "label")


def labelled_turns(ws: Workspace, labels: DataFrame) -> DataFrame:
    tag = labels.select("session_id", F.col("seq").alias("user_seq"), "label", "pushback", "sentiment")
    return ws.turns.select("session_id", "user_seq", "n_calls", "turn_cost_usd").join(tag, ["session_id", "user_seq"])


def cost_by_label(ws: Workspace, labels: DataFrame) -> DataFrame:
    """What the calls after a prompt cost, by the label of that prompt."""
    t = labelled_turns(ws, labels)
    whole = t.agg(F.sum("turn_cost_usd")).scalar()
    return ws.grouped(
        t, ["label"], [rows().alias("turns"), F.sum("turn_cost_usd").alias("usd")],
        {"median_turn_usd": med("turn_cost_usd"), "median_calls": med("n_calls")},
    ).withColumn("pct_of_bill", pct("usd", whole)).orderBy(F.desc("usd"), "label")


def pushback_cost(ws: Workspace, labels: DataFrame) -> DataFrame:
    """Cost of the turns after a correction or failure report, and after any pushback."""
    p, fix = yes("pushback"), F.col("label").isin("correction", "failure_report")
    cost = F.col("turn_cost_usd")
    return labelled_turns(ws, labels).agg(
        rows().alias("turns"), sum_where(fix, cost).alias("usd_after_fix_requests"),
        pct(sum_where(fix, cost), F.sum(cost)).alias("pct_after_fix_requests"), sum_where(p, cost).alias("usd_after_pushback"),
        pct(sum_where(p, cost), F.sum(cost)).alias("pct_after_pushback"))


# ---------------------------------------------------------------- task tool


@result("task_per_session")
def task_per_session(ws: Workspace) -> DataFrame:
    n = F.col("task_calls")
    bucket = F.when(n == 1, "1").when(n <= 3, "2-3").when(n <= 10, "4-10").when(n <= 30, "11-30").otherwise(">30")
    s = task_counts(ws).join(ws.sessions_x.where("agent = 'claude_code'").select("session_id"), "session_id", "left_semi")
    return s.groupBy(bucket.alias("task_calls_bucket")).agg(
        rows().alias("sessions"), F.sum("task_calls").alias("_n"), (F.sum("task_result_chars") / 1e6).alias("result_Mchars"),
    ).withColumnRenamed("_n", "task_calls").orderBy("task_calls")


@result("task_vs_no_task")
def task_against_none(ws: Workspace) -> DataFrame:
    s = ws.sessions_x.where("agent = 'claude_code' AND n_calls > 0 AND mode <> 'unknown'").join(
        task_counts(ws), "session_id", "left")
    kind = F.when(F.col("task_calls") > 0, "z Task").otherwise("bez Task")
    return ws.grouped(
        s.withColumn("kind", kind), ["mode", "kind"],
        [rows().alias("sessions"), per_line().alias("usd_per_committed_line"),
         pct(rows_where(F.col("committed_lines") > 0), rows()).alias("pct_with_commit")],
        {"median_usd": med("session_cost_usd")},
    ).orderBy("mode", "kind")


# ---------------------------------------------------------------- sleeping


@result("sleep_durations")
def sleep_durations(ws: Workspace) -> DataFrame:
    secs = F.nullif(F.regexp_extract("command_head", "sleep ([0-9]+)", 1), F.lit("")).try_cast("long")
    bucket = bands("secs", [(10, "1. <10 s"), (30, "2. 10-29 s"), (60, "3. 30-59 s"), (300, "4. 60-299 s")], "5. >=300 s")
    return polls(ws).withColumn("secs", secs).where("secs IS NOT NULL").groupBy(bucket.alias("sleep_bucket")).agg(
        rows().alias("calls"), F.sum("call_usd").alias("usd_context"), (F.sum("secs") / 3600.0).alias("hours_slept"),
    ).orderBy("sleep_bucket")


# ---------------------------------------------------------------- concurrent edits


def edit_windows(ws: Workspace) -> DataFrame:
    """First and last edit of a file by a session. What followed an edit is not asked, so it is not looked up."""
    e = ws.tool_calls.where("file_path IS NOT NULL AND tool_kind IN ('edit', 'write') AND seq IS NOT NULL AND ts IS NOT NULL").select("session_id", "file_path", "ts")
    return e.join(ws.sessions.where("repo IS NOT NULL").select("session_id", "repo"), "session_id").groupBy("repo", "file_path", "session_id").agg(
        F.min("ts").alias("opened"), F.max("ts").alias("closed"))


def overlap_degrees(ws: Workspace) -> DataFrame:
    """For every edit window: how many other windows of the same file it overlaps.

    No pair is formed. Every window is two marks on the file's time line; running counts of
    opened and closed windows give, at its opening mark, the windows still open, and at its
    closing mark, the windows opened in between. A file edited by a third of all sessions
    costs two rows per session, spread over blocks of time."""
    def build():
        w = edit_windows(ws)
        one, nil = F.lit(1).cast("long"), F.lit(0).cast("long")
        # windows that touch at one instant overlap: openings come before closings
        marks = w.select("repo", "file_path", "session_id", F.col("opened").alias("at"), F.lit(0).alias("side"),
                         one.alias("o"), nil.alias("c")).unionByName(
            w.select("repo", "file_path", "session_id", F.col("closed").alias("at"), F.lit(1).alias("side"),
                     nil.alias("o"), one.alias("c")))
        marks = running(marks, ["repo", "file_path"], ["at", "side", "session_id"],
                        [Carry("opened", F.col("o")), Carry("closed", F.col("c"))], ws.time_blocks("at", minutes=60))
        start = F.col("side") == 0
        still_open = F.col("opened") - 1 - F.col("closed")
        joined_later = F.sum(F.when(start, -F.col("opened")).otherwise(F.col("opened")))
        return marks.groupBy("repo", "file_path", "session_id").agg(
            (F.sum(F.when(start, still_open)) + joined_later).alias("overlaps"))
    return ws.table("overlap_degrees", build)


@result("concurrent_summary")
def concurrent_summary(ws: Workspace) -> DataFrame:
    d = overlap_degrees(ws)
    hit = F.col("overlaps") > 0
    per_file = d.groupBy("repo", "file_path").agg(F.sum("overlaps").alias("n")).agg(
        rows().alias("files"), rows_where(F.col("n") > 0).alias("hit"))
    return d.agg(
        F.floor(zero(F.sum("overlaps")) / 2).cast("long").alias("overlapping_pairs"),
        F.count_distinct(F.when(hit, F.col("session_id"))).alias("sessions_involved"),
    ).withColumn("files_with_overlap", per_file.select("hit").scalar()).withColumn(
        "files_edited_total", per_file.select("files").scalar())


@result("concurrent_files")
def concurrent_files(ws: Workspace, n: int = 20) -> DataFrame:
    return overlap_degrees(ws).groupBy("repo", "file_path").agg(
        F.floor(F.sum("overlaps") / 2).cast("long").alias("overlapping_session_pairs"),
    ).where("overlapping_session_pairs > 0").orderBy(F.desc("overlapping_session_pairs"), "repo", "file_path").limit(n)


# ---------------------------------------------------------------- verdict causes


def cause_shares(verdicts: DataFrame, field: str = "cause") -> DataFrame:
    n = verdicts.agg(rows()).scalar()
    return verdicts.groupBy(field).agg(rows().alias("n")).withColumn("pct", pct("n", n)).orderBy(F.desc("n"), field)


# ---------------------------------------------------------------- the closing bill


def bill_summary(ws: Workspace, labels: DataFrame) -> DataFrame:
    """The line items side by side, each with its share of the bill and the sum so far."""
    bill = ws.calls_priced.agg(total("cache_read_usd").alias("r"), total("cache_write_usd").alias("w"), total("cost_usd").alias("t"))
    claude_rent = rents(ws).where("agent = 'claude_code'").agg(F.sum("rent_usd")).scalar()
    pushback = pushback_cost(ws, labels).select("usd_after_pushback").scalar()
    coffee = call_gaps(ws).where("gap_min > 5").agg(total("cache_write_usd")).scalar()
    items = [("cache reads", F.col("r")), ("tool results held in context", claude_rent), ("cache writes", F.col("w")),
             ("turns after pushback", pushback), ("cache writes after a break", coffee)]
    listed = bill.select(F.col("t"), F.posexplode(F.array(*[
        F.struct(F.lit(name).alias("item"), zero(value).alias("usd")) for name, value in items])))
    # five rows
    upto = Window.partitionBy("t").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return listed.select(
        (F.col("pos") + 1).cast("long").alias("line_no"), "col.item", "col.usd", pct("col.usd", "t").alias("pct_of_total_usd"),
        F.sum("col.usd").over(upto).alias("running_usd"), F.col("t").alias("total_usd")).orderBy("line_no")
