"""Probes of raw text: what a sample (or everything) is made of, scaled to the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from tollbook.functions.measures import (
    count_of, deflated_bytes, file_ending, indent_chars, leaf_chars, numbered_listing, ratio_bucket, reply_columns, reply_structure,
    share, written_content,
)
from tollbook.functions.metrics import call_tie, pct, ratio, rows, yes, zero
from tollbook.functions.variants import size_of
from tollbook.operators.quantiles import attach, med
from tollbook.operators.ranking import hash_order, most_frequent
from tollbook.operators.running import Carry, running
from tollbook.operators.sampling import first_by_hash
from tollbook.plans.workspace import Workspace

# Harnesses a probe covers.
RESULT_AGENTS = ["claude_code", "codex", "opencode"]
READ_AGENTS = ["claude_code", "opencode"]
TEXT_AGENTS = ["claude_code", "codex", "opencode", "cursor"]
PROBES = ["read", "bash", "write", "final"]


def final_replies(ws: Workspace) -> DataFrame:
    """Main-line calls with text whose successor in the session is a human prompt."""
    c = ws.calls.where(~yes("is_sidechain")).select(
        "session_id", "agent", "seq", "msg_id", "n_text_chars", F.lit(0).alias("side"), call_tie().alias("_tie"))
    asked = ws.user_turns.where("is_meta = false AND human_chars > 0").select(
        "session_id", "agent", "seq", F.lit(None).cast("string").alias("msg_id"), F.lit(0).cast("long").alias("n_text_chars"),
        F.lit(1).alias("side"), F.lit("").alias("_tie"))
    line = running(c.unionByName(asked), ["session_id"], ["seq", "side", "_tie"],
                   [Carry("_next", F.col("side"), "last", inclusive=False, backwards=True)], ws.blocks())
    ends = line.where((F.col("side") == 0) & (F.col("_next") == 1) & (F.col("n_text_chars") > 0) & F.col("agent").isin(*TEXT_AGENTS))
    return ends.groupBy("session_id", "agent", "seq").agg(F.max("msg_id").alias("msg_id"), F.max("n_text_chars").alias("ledger_chars"))


def population(ws: Workspace, probe: str) -> DataFrame:
    """Everything a probe speaks about, with its size in the ledger and the session's model."""
    if probe == "final":
        items = final_replies(ws)
    else:
        kinds, agents, size = {
            "read": (["read"], READ_AGENTS, "result_chars"), "bash": (["bash"], RESULT_AGENTS, "result_chars"),
            "write": (["write", "edit"], RESULT_AGENTS, "input_chars")}[probe]
        items = ws.tool_calls.where(
            F.col("tool_kind").isin(*kinds) & (F.col(size) > 0) & F.col("tool_use_id").isNotNull() & F.col("agent").isin(*agents)
        ).select("session_id", "agent", "seq", "msg_id", "tool_use_id", "tool_kind", "file_path_raw", F.col(size).alias("ledger_chars"))
    models = most_frequent(ws.calls, "session_id", {"model": "model"})
    return items.join(models, "session_id", "left")


def seeded_sample(items: DataFrame, n: int | None, seed: int, key: list[str]) -> DataFrame:
    """``n`` rows in seeded hash order; all of them where ``n`` is not given."""
    if n is None:
        return items
    return first_by_hash(items, hash_order(*key, seed=str(seed)), n, key)


# ---------------------------------------------------------------- measures


def measure_read(texts: DataFrame) -> DataFrame:
    return texts.withColumns(numbered_listing(F.col("text")))


def measure_bash(texts: DataFrame) -> DataFrame:
    t = texts.where(F.octet_length("text") > 0).withColumns({
        "result_chars": F.length("text").cast("long"), "result_bytes": F.octet_length("text").cast("long"), "gzip_bytes": deflated_bytes("text")})
    t = t.withColumn("gzip_ratio", ratio("result_bytes", "gzip_bytes"))
    return t.withColumn("bucket", ratio_bucket(F.col("gzip_ratio")))


def measure_write(inputs: DataFrame) -> DataFrame:
    """``inputs``: ``inp`` (VARIANT) and ``file_path``."""
    w = inputs.withColumns({
        "ext": file_ending(F.col("file_path")), "_dump": F.to_json("inp"), "_content": written_content(F.col("inp"))})
    w = w.withColumns({
        "json_bytes": F.octet_length("_dump").cast("long"), "string_leaf_chars": leaf_chars(F.col("_dump")), "content_chars": F.length("_content").cast("long"),
        "n_newlines": count_of(F.col("_content"), "\n").cast("long"), "n_quotes": count_of(F.col("_content"), '"').cast("long"),
        "indent_chars": indent_chars(F.col("_content")).cast("long")})
    w = w.withColumn("json_overhead_bytes", F.col("json_bytes") - F.col("string_leaf_chars"))
    content = F.col("content_chars")
    return w.withColumns({
        "json_overhead_share": share(F.col("json_overhead_bytes"), F.col("json_bytes")), "newline_share": share(F.col("n_newlines"), content),
        "quote_share": share(F.col("n_quotes"), content), "indent_share": share(F.col("indent_chars"), content)}).drop("_dump", "_content")


def measure_final(texts: DataFrame) -> DataFrame:
    folded = texts.withColumn("_fold", reply_structure(F.col("text")))
    return folded.withColumns(reply_columns(F.col("text"), F.col("_fold"))).drop("_fold")


# ---------------------------------------------------------------- summaries


def _weighted(part, whole):
    return ratio(F.sum(part), F.sum(whole))


def summarize_read_by_agent(ws: Workspace, measured: DataFrame) -> DataFrame:
    return ws.grouped(
        measured, ["agent"],
        [rows().alias("sampled"), F.avg("prefix_share").alias("mean_share"), _weighted("prefix_chars", "result_chars").alias("char_weighted_share"),
         F.avg("prefixed_line_share").alias("mean_prefixed_line_share")],
        {"median_share": med("prefix_share"), "median_lines": med("n_lines")}).orderBy("agent")


def summarize_read_by_style(measured: DataFrame) -> DataFrame:
    n = measured.agg(rows()).scalar()
    return measured.groupBy("style").agg(
        rows().alias("sampled"), F.sum("result_chars").alias("_c"), _weighted("prefix_chars", "result_chars").alias("char_weighted_prefix_share"),
    ).withColumnRenamed("_c", "result_chars").withColumn("share_of_results", ratio("sampled", n)).orderBy(F.desc("sampled"), "style")


def summarize_write(ws: Workspace, measured: DataFrame, by: list[str]) -> DataFrame:
    """``by``: ["ext"] or ["agent", "tool_kind"]."""
    return ws.grouped(
        measured, by,
        [rows().alias("sampled"), _weighted("json_overhead_bytes", "json_bytes").alias("char_weighted_overhead_share"),
         _weighted("n_newlines", "content_chars").alias("newline_share"), _weighted("n_quotes", "content_chars").alias("quote_share"),
         _weighted("indent_chars", "content_chars").alias("indent_share")],
        {"median_overhead_share": med("json_overhead_share"), "median_content_chars": med("content_chars"), "median_input_bytes": med("json_bytes")},
    ).orderBy(F.desc("sampled"), *by)


def summarize_bash_by_bucket(ws: Workspace, measured: DataFrame) -> DataFrame:
    whole = measured.agg(rows().alias("n"), F.sum("result_chars").alias("c"))
    return ws.grouped(
        measured.withColumnRenamed("result_chars", "_c"), ["bucket"], [rows().alias("sampled"), F.sum("_c").alias("result_chars")],
        {"median_ratio": med("gzip_ratio"), "median_chars": med("_c")},
    ).withColumn("share_of_results", ratio("sampled", whole.select("n").scalar())).withColumn(
        "share_of_result_chars", ratio("result_chars", whole.select("c").scalar())).orderBy("bucket")


def summarize_bash_by_agent(ws: Workspace, measured: DataFrame) -> DataFrame:
    big = F.sum(F.when(F.col("gzip_ratio") > 10, F.col("result_chars")).otherwise(0))
    return ws.grouped(
        measured, ["agent"],
        [rows().alias("sampled"), F.avg("gzip_ratio").alias("mean_ratio"), ratio(big, F.sum("result_chars")).alias("share_of_chars_over_10")],
        {"median_ratio": med("gzip_ratio")}).orderBy("agent")


def summarize_final(ws: Workspace, measured: DataFrame, by: str = "agent") -> DataFrame:
    shaped = (F.col("n_headers") > 0) | (F.col("n_bullets") >= 3)
    return ws.grouped(
        measured, [by],
        [rows().alias("sampled"), F.avg("n_headers").alias("mean_headers"), F.avg("n_bullets").alias("mean_bullets"), F.avg("n_fences").alias("mean_fences"),
         _weighted("bullet_chars", "text_chars").alias("bullet_char_share"), _weighted("summary_chars", "text_chars").alias("summary_char_share"),
         F.count(F.when(shaped, 1)).alias("structured")],
        {"median_chars": med("text_chars"), "median_headers": med("n_headers"), "median_bullets": med("n_bullets")}).orderBy(by)


# ---------------------------------------------------------------- extrapolation


def _measures() -> dict[str, tuple[str, Column, str, str]]:
    """name -> (probe, what is wasted, out of what, price side)."""
    chars, r = F.col("result_chars"), F.col("gzip_ratio")
    return {
        "lineno_prefixes": ("read", F.col("prefix_chars"), "result_chars", "p_input"),
        "image_base64": ("read", F.when(F.col("style") == "image_base64", chars).otherwise(0), "result_chars", "p_input"),
        "json_overhead": ("write", F.col("json_overhead_bytes"), "json_bytes", "p_output"),
        "newlines_and_indent": ("write", F.col("n_newlines") + F.col("indent_chars"), "json_bytes", "p_output"),
        "high_ratio_results": ("bash", F.when(r > 10, chars).otherwise(0), "result_chars", "p_input"),
        "compressible_redundancy": ("bash", chars * (1.0 - 1.0 / r), "result_chars", "p_input"),
        "summary_sections": ("final", F.col("summary_chars"), "text_chars", "p_output"),
        "bullets": ("final", F.col("bullet_chars"), "text_chars", "p_output"),
    }


MEASURES = {"lineno_prefixes": "read", "image_base64": "read", "json_overhead": "write", "newlines_and_indent": "write",
            "high_ratio_results": "bash", "compressible_redundancy": "bash", "summary_sections": "final", "bullets": "final"}


def extrapolate(ws: Workspace, measure: str, measured: DataFrame) -> DataFrame:
    """The sample's share, weighted by characters and taken per agent, times the exact size
    of every (agent, model) of the population, as tokens and USD."""
    probe, part, whole, side = _measures()[measure]
    found = measured.groupBy("agent").agg(ratio(F.sum(part), F.sum(whole)).alias("sample_share"))
    sizes = population(ws, probe).groupBy("agent", "model").agg(rows().alias("n_items"), F.sum("ledger_chars").alias("population_chars"))
    card = ws.model_prices.select("model", F.col(side).alias("price_usd_per_mtok"))
    out = sizes.join(found, "agent", "left").join(card, "model", "left").withColumn("wasted_chars", F.col("population_chars") * F.col("sample_share"))
    return out.withColumn("wasted_tokens", F.col("wasted_chars") / 4.0).select(
        F.lit(measure).alias("measure"), "agent", F.coalesce("model", F.lit("(unknown)")).alias("model"), "n_items", "population_chars", "sample_share",
        "wasted_chars", "wasted_tokens", "price_usd_per_mtok", (F.col("wasted_tokens") / 1e6 * F.col("price_usd_per_mtok")).alias("usd"),
        F.col("price_usd_per_mtok").isNotNull().alias("priced")).orderBy("agent", "model")


def coverage(sampled: DataFrame, measured: DataFrame, key: list[str]) -> DataFrame:
    """Sampled and measured items per probe; both carry ``probe``."""
    hit = measured.select("probe", *key).distinct().withColumn("_hit", F.lit(1))
    both = attach(sampled.select("probe", *key), hit, ["probe", *key])
    return both.groupBy("probe").agg(rows().alias("sampled"), zero(F.sum("_hit")).alias("measured")).withColumn(
        "hit_rate", ratio("measured", "sampled")).orderBy("probe")


# Why a sampled item is not measured, in the order in which it is looked at.
DROPS = {"no_text": "text IS NULL", "empty_text": "text = ''", "too_short": "length(text) < least", "measured": "true"}


def measured_with_drops(sampled: DataFrame, measure, probe: str, write, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """(measured items, counts by reason) of a sample whose ``text`` was looked for. The reasons are counted by the
    very pass that measures the items (``observe``), which ``write`` carries out (it writes a frame and reads it back)."""
    reason = F.coalesce(*[F.when(F.expr(test), name) for name, test in DROPS.items()])
    seen = Observation(f"drops_{probe}")
    told = sampled.withColumn("least", F.lit(least)).withColumn("_reason", reason)
    told = told.observe(seen, F.count(F.lit(1)).alias("sampled"), *[F.count_if(F.col("_reason") == name).alias(name) for name in DROPS])
    found = write(measure(told.where("_reason = 'measured'").drop("_reason", "least")))
    counts = seen.get
    rows_of = [(probe, name, counts[name], counts["sampled"]) for name in DROPS]
    return found, sampled.sparkSession.createDataFrame(rows_of, "probe string, reason string, items long, sampled long")
