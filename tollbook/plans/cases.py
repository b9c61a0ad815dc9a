"""Case samples: the largest and a repeatable random draw per stratum.

Random order is the md5 of the row's identity, so a sample is the same on every engine and
every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tollbook.functions.metrics import chars_as_tokens, lead_part, ratio, rows, rows_where, usd
from tollbook.operators.quantiles import Distinct, attach, med
from tollbook.operators.ranking import hash_order, top_per
from tollbook.plans.catalog_of_results import result
from tollbook.plans.context import file_visits, rents
from tollbook.plans.tooling import edited_files
from tollbook.plans.workspace import Workspace

LARGEST, RANDOM = 300, 300


def largest_and_random(pool: DataFrame, size: str, by: list[str], per_stratum: int, names: tuple[str, str],
                       random_from=None, largest: int = LARGEST, random: int = RANDOM) -> DataFrame:
    """The ``largest`` rows by ``size`` and, apart from those, up to ``per_stratum`` rows of
    each stratum in hash order, ``random`` in all."""
    top = pool.orderBy(F.desc_nulls_last(size), "session_id", "seq").limit(largest)
    rest = pool if random_from is None else pool.where(random_from)
    rest = rest.join(top.select("session_id", "seq"), ["session_id", "seq"], "left_anti")
    order = [hash_order("session_id", "seq"), F.col("session_id"), F.col("seq")]
    drawn = top_per(rest, by, order, per_stratum).orderBy(*order).limit(random)
    return top.withColumn("stratum_pick", F.lit(names[0])).unionByName(drawn.withColumn("stratum_pick", F.lit(names[1])))


# ---------------------------------------------------------------- rewrites


def rewrite_pool(ws: Workspace) -> DataFrame:
    v = file_visits(ws).where("tool_kind = 'write' AND earlier_touches > 0 AND coalesce(content_chars, 0) > 0")
    return v.select(
        "session_id", "agent", "mode", F.col("s_repo").alias("repo"), "seq", "file_path", "content_chars", "input_chars",
        "max_earlier_read_chars", ratio("content_chars", "max_earlier_read_chars").alias("rewrite_ratio"),
        usd(chars_as_tokens("content_chars"), "p_output").alias("output_usd_estimate"))


@result("c01_rewrite_necessary")
def rewrite_cases(ws: Workspace, largest: int = LARGEST, random: int = RANDOM) -> DataFrame:
    picked = largest_and_random(rewrite_pool(ws), "content_chars", ["agent", "mode"], 40, ("top_by_size", "random"), largest=largest, random=random)
    return picked.select(
        "session_id", "seq", F.lit(10).alias("k_before"), F.lit(5).alias("k_after"), "agent", "mode", "repo", "file_path",
        "content_chars", "input_chars", "max_earlier_read_chars", "rewrite_ratio", "output_usd_estimate", "stratum_pick",
        F.concat_ws("|", "agent", "mode").alias("stratum"),
    ).orderBy("stratum_pick", F.desc("content_chars"), "session_id", "seq")


@result("c01_headline")
def rewrite_pool_headline(ws: Workspace) -> DataFrame:
    return ws.grouped(
        rewrite_pool(ws), [],
        [rows().alias("pool_of_writes_on_known_files"), F.sum("content_chars").alias("content_chars_in_pool"),
         F.sum("output_usd_estimate").alias("output_usd_in_pool"), Distinct("sessions_in_pool", "session_id")],
        {"median_content_chars": med("content_chars")})


# ---------------------------------------------------------------- big results


def result_pool(ws: Workspace) -> DataFrame:
    return rents(ws).select(
        "session_id", "agent", "mode", F.col("s_repo").alias("repo"), "seq", "tool_kind", "tool_name",
        lead_part(F.coalesce("command_head", "file_path"), 200).alias("what"), "result_chars", "later_calls", "rent_tokens", "rent_usd")


@result("c02_tool_result_used")
def result_cases(ws: Workspace, big: int = 5000) -> DataFrame:
    picked = largest_and_random(result_pool(ws), "rent_usd", ["agent", "tool_kind"], 25, ("top_by_rent", "random_over_5k"),
                                F.col("result_chars") > big)
    return picked.select(
        "session_id", "seq", F.lit(3).alias("k_before"), F.lit(12).alias("k_after"), "agent", "mode", "repo", "tool_kind",
        "tool_name", "what", "result_chars", "later_calls", "rent_tokens", "rent_usd", "stratum_pick",
        F.concat_ws("|", "agent", "tool_kind").alias("stratum"),
    ).orderBy("stratum_pick", F.desc_nulls_last("rent_usd"), "session_id", "seq")


@result("c02_headline")
def result_pool_headline(ws: Workspace, big: int = 5000) -> DataFrame:
    return ws.grouped(
        result_pool(ws), [],
        [rows().alias("pool_of_tool_results"), rows_where(F.col("result_chars") > big).alias("results_over_5k_chars"),
         F.sum("rent_usd").alias("rent_usd_in_pool"), Distinct("sessions_in_pool", "session_id")],
        {"median_result_chars": med("result_chars")})


# ---------------------------------------------------------------- hottest files


def hottest(ws: Workspace, n: int = 40) -> DataFrame:
    return edited_files(ws).select("repo", "file_path", "edits", "sessions", "users").orderBy(
        F.desc("sessions"), F.desc("edits"), F.asc_nulls_last("repo"), "file_path").limit(n)


@result("c03_hot_file_cause")
def hot_file_cases(ws: Workspace, per_file: int = 5) -> DataFrame:
    e = ws.tool_facts.where("in_catalog AND tool_kind IN ('edit', 'write') AND file_path IS NOT NULL").select(
        "session_id", "agent", "mode", F.col("s_repo").alias("repo"), "seq", "tool_kind", "file_path")
    hot = hottest(ws).select("repo", "file_path", F.col("sessions").alias("file_sessions"), F.col("edits").alias("file_edits"),
                             F.col("users").alias("file_users"))
    # the hot list is limited to 40 rows
    near = attach(e, F.broadcast(hot), ["repo", "file_path"], "inner")
    order = [hash_order("session_id", "seq"), F.col("session_id"), F.col("seq")]
    return top_per(near, ["repo", "file_path"], order, per_file).select(
        "session_id", "seq", F.lit(10).alias("k_before"), F.lit(10).alias("k_after"), "agent", "mode", "repo", "file_path", "tool_kind",
        "file_sessions", "file_edits", "file_users",
        F.concat(F.col("repo"), F.lit("|"), F.col("file_path")).alias("stratum"),
    ).orderBy(F.desc("file_sessions"), "file_path", "seq", "session_id")


@result("c03_headline")
def hot_file_headline(ws: Workspace) -> DataFrame:
    return hottest(ws).agg(
        rows().alias("hot_files_selected"), F.sum("sessions").alias("sessions_covered"), F.sum("edits").alias("edits_covered"),
        F.max("sessions").alias("max_sessions_on_one_file"), F.min("sessions").alias("min_sessions_on_one_file"))
