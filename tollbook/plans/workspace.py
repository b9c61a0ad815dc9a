"""Derived tables shared by the analyses, built once per ledger.

The heavy work (pricing, positions, turn boundaries, session attributes) happens here, one
time. Each derived table is written to the shared folder as Parquet and read back, which
cuts its lineage, survives the loss of executors, and lets every analysis read only the
columns it names.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tollbook.functions.metrics import call_tie, month_of, rows, rows_where, total, yes, zero
from tollbook.functions.models import norm_model
from tollbook.operators.quantiles import grouped
from tollbook.operators.ranking import most_frequent, top_per
from tollbook.operators.running import Carry, lookback, running, span_blocks
from tollbook.session import configure, discard, fresh_folder
from tollbook.sources.ledger import Ledger
from tollbook.sources.prices import builtin_prices


class Workspace:
    """Lazily built derived tables over one ledger."""

    def __init__(self, ledger: Ledger, prices: DataFrame | None = None, *, store: bool = True,
                 block_span: int | None = None):
        self.spark: SparkSession = configure(ledger.calls.sparkSession)
        self.prices = prices if prices is not None else builtin_prices(self.spark)
        self._store = fresh_folder(self.spark, "tables") if store else None
        self._built: dict[str, DataFrame] = {}
        self._source = ledger
        self._block_span = block_span
        self.notes: dict = {}
        self._guard = threading.Lock()
        self._locks: dict[str, threading.RLock] = {}

    # -- plumbing ---------------------------------------------------------------

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived table, built at its first use. Results may be run from several threads;
        each table is then built by one of them while the others wait for it."""
        with self._guard:
            lock = self._locks.setdefault(name, threading.RLock())
        with lock:
            if name not in self._built:
                df = build()
                if self._store:
                    path = f"{self._store}/{name}"
                    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
                    df = self.spark.read.schema(df.schema).parquet(path)
                self._built[name] = df
            return self._built[name]

    def prepare(self) -> "Workspace":
        """Build the shared tables in one go, independent ones side by side."""
        for wave in (["calls", "tool_calls", "user_turns", "events", "sessions"], ["model_prices"], ["calls_priced"],
                     ["calls_idx", "seq_pos", "session_price", "turn_rows"], ["sessions_x", "turns"], ["tool_facts"]):
            with ThreadPoolExecutor(len(wave)) as pool:
                list(pool.map(lambda n: getattr(self, n), wave))
        return self

    def discard(self) -> None:
        """Remove the written tables from the shared folder; the workspace cannot be used after."""
        self._built.clear()
        if self._store:
            discard(self.spark, self._store)

    def blocks(self, col: str = "seq", span: int | None = None) -> Column:
        """Blocks for ``running``."""
        width = self._block_span or span
        return span_blocks(col, width) if width else span_blocks(col)

    def time_blocks(self, col: str = "ts", minutes: int = 10) -> Column:
        return F.floor(F.unix_micros(F.col(col).cast("timestamp")) / F.lit(minutes * 60_000_000)).cast("long")

    def grouped(self, df: DataFrame, keys: list[str], aggs: list[Column], wanted=None) -> DataFrame:
        if not wanted:
            return df.groupBy(*keys).agg(*aggs)
        return grouped(df, keys, aggs, wanted)

    # -- ledger -----------------------------------------------------------------

    @property
    def calls(self) -> DataFrame:
        return self.table("calls", lambda: self._source.calls)

    @property
    def tool_calls(self) -> DataFrame:
        return self.table("tool_calls", lambda: self._source.tool_calls)

    @property
    def user_turns(self) -> DataFrame:
        return self.table("user_turns", lambda: self._source.user_turns)

    @property
    def events(self) -> DataFrame:
        return self.table("events", lambda: self._source.events)

    @property
    def sessions(self) -> DataFrame:
        return self.table("sessions", lambda: self._source.sessions)

    @property
    def prompts(self) -> DataFrame:
        """Prompts a human wrote."""
        return self.user_turns.where(~yes("is_meta") & (F.col("human_chars") > 0))

    # -- pricing ----------------------------------------------------------------

    @property
    def model_prices(self) -> DataFrame:
        """One price row per raw model name; the longest matching pattern wins. Only the
        distinct names meet the rate card, so the LIKE match never touches a call."""
        def build():
            names = self.calls.where("model IS NOT NULL").select("model").distinct()
            names = names.withColumn("model_norm", norm_model(F.col("model")))
            # the rate card is a constant list of a few rows
            hit = names.join(F.broadcast(self.prices), F.expr("model_norm LIKE model_pattern"))
            longest = [F.length("model_pattern").desc(), F.col("model_pattern").asc()]
            return top_per(hit, ["model"], longest, 1).drop("model_pattern")
        return self.table("model_prices", build)

    @property
    def calls_priced(self) -> DataFrame:
        def build():
            c = self.calls.join(self.model_prices, "model", "left")
            openai = F.col("provider") == "openai"
            anthropic = F.col("provider") == "anthropic"
            priced = F.col("provider").isNotNull()
            no_split = F.col("cache_create_5m").isNull() & F.col("cache_create_1h").isNull()
            c = c.withColumns({
                "is_sidechain": yes("is_sidechain"),
                "is_priced": priced,
                "month": month_of("ts"),
                "c5m_tokens": F.when(no_split, zero("cache_create_tokens")).otherwise(zero("cache_create_5m")),
                "c1h_tokens": zero("cache_create_1h"),
            })
            fresh = F.when(openai, F.greatest(zero("input_tokens") - zero("cache_read_tokens"), F.lit(0))).otherwise(
                zero("input_tokens"))
            prompt_side = zero("input_tokens") + zero("cache_read_tokens") + zero("cache_create_tokens")
            write = F.col("c5m_tokens") * F.col("p_cache_write_5m") / 1e6 + F.col("c1h_tokens") * F.col("p_cache_write_1h") / 1e6
            c = c.withColumns({
                "ctx_tokens": F.when(openai, zero("input_tokens")).otherwise(prompt_side),
                "input_usd": F.when(priced, fresh * F.col("p_input") / 1e6),
                "cache_read_usd": zero("cache_read_tokens") * F.col("p_cache_read") / 1e6,
                "cache_write_usd": F.when(anthropic, write).when(priced, F.lit(0.0)),
                "output_usd": zero("output_tokens") * F.col("p_output") / 1e6,
            })
            cost = F.col("input_usd") + F.col("cache_read_usd") + F.col("cache_write_usd") + F.col("output_usd")
            return c.withColumn("cost_usd", F.when(priced, cost))
        return self.table("calls_priced", build)

    @property
    def session_price(self) -> DataFrame:
        def build():
            modal = most_frequent(self.calls_priced, "session_id", {"session_model": "model"})
            card = self.model_prices.select(
                F.col("model").alias("session_model"), F.col("provider").alias("session_provider"),
                "p_input", "p_cache_read", "p_cache_write_5m", "p_output")
            return modal.where("session_model IS NOT NULL").join(card, "session_model", "left")
        return self.table("session_price", build)

    # -- positions --------------------------------------------------------------

    @property
    def calls_idx(self) -> DataFrame:
        """Main-line calls numbered inside their session, with the bill so far."""
        def build():
            main = self.calls_priced.where(~F.col("is_sidechain")).withColumn("_tie", call_tie())
            numbered = running(
                main, ["session_id"], ["seq", "_tie"],
                [Carry("call_idx", F.lit(1).cast("long")), Carry("cum_cost_usd", zero("cost_usd"))],
                self.blocks())
            return numbered.select("session_id", "seq", "ts", "agent", "model", "cost_usd", "ctx_tokens", "output_tokens",
                                   "cache_read_tokens", "output_usd", "call_idx", "cum_cost_usd")
        return self.table("calls_idx", build)

    @property
    def seq_pos(self) -> DataFrame:
        """For every record number in the ledger: calls, tool calls and USD up to it.

        An as-of lookup of two running counts is the same as one running total over the
        union of all record numbers, so the four tables are first reduced to one row per
        (session, seq) and then summed along the session."""
        def build():
            nothing = {"n_call": F.lit(0).cast("long"), "usd": F.lit(0.0), "n_tool": F.lit(0).cast("long")}
            def points(df, **own):
                return df.select("session_id", "seq", *[own.get(n, v).alias(n) for n, v in nothing.items()])
            one = F.lit(1).cast("long")
            main = ~F.col("is_sidechain")
            marks = (
                points(self.tool_calls, n_tool=one)
                .unionByName(points(self.user_turns))
                .unionByName(points(self.events))
                .unionByName(points(self.calls_priced, n_call=F.when(main, one).otherwise(0 * one),
                                    usd=F.when(main, zero("cost_usd")).otherwise(F.lit(0.0))))
            )
            dense = marks.groupBy("session_id", "seq").agg(*[F.sum(n).alias(n) for n in nothing])
            return running(
                dense, ["session_id"], ["seq"],
                [Carry("calls_before", F.col("n_call")), Carry("cum_cost_usd", F.col("usd")),
                 Carry("tools_before", F.col("n_tool"))],
                self.blocks()).select("session_id", "seq", "calls_before", "cum_cost_usd", "tools_before")
        return self.table("seq_pos", build)

    # -- sessions ---------------------------------------------------------------

    @property
    def session_bills(self) -> DataFrame:
        """Sums over the model calls of a session."""
        def build():
            return self.calls_priced.groupBy("session_id").agg(
                F.max("agent").alias("calls_agent"),
                rows().alias("n_calls"),
                rows_where(F.col("is_sidechain")).alias("n_sidechain_calls"),
                rows_where(~F.col("is_priced")).alias("n_unpriced_calls"),
                total("cost_usd").alias("session_cost_usd"),
                total("output_usd").alias("session_output_usd"),
                total("input_tokens").alias("input_tokens"),
                total("cache_read_tokens").alias("cache_read_tokens"),
                F.sum(F.col("c5m_tokens") + F.col("c1h_tokens")).alias("cache_write_tokens"),
                total("output_tokens").alias("output_tokens"),
                F.sum("ctx_tokens").alias("ctx_tokens"),
                F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                rows_where(F.col("speed") == "fast").alias("n_fast_calls"))
        return self.table("session_bills", build)

    @property
    def session_tools(self) -> DataFrame:
        """Sums over the tool calls of a session."""
        def build():
            return self.tool_calls.groupBy("session_id").agg(
                rows().alias("n_tool_calls"), rows_where(F.col("is_error")).alias("n_tool_errors"),
                total("result_chars").alias("tool_result_chars"))
        return self.table("session_tools", build)

    @property
    def sessions_x(self) -> DataFrame:
        def build():
            p = self.calls_priced
            usual = most_frequent(p, "session_id", {"harness_version": "harness_version", "cwd": "cwd"})
            typed = self.user_turns.groupBy("session_id").agg(
                rows_where(~yes("is_meta") & (F.col("human_chars") > 0)).alias("n_human_turns"),
                total("human_chars").alias("human_chars"),
                rows_where(F.col("is_interrupt")).alias("n_interrupts"))
            share = F.col("attr_agent_percentage")
            home = F.regexp_extract("cwd", "^/(Users|home)/([^/]+)", 2)
            s = self.sessions.select(
                "session_id", F.col("agent").alias("_agent"), "repo", "created_at", "bytes", "models", "detected_format",
                "attr_agent_percentage", F.col("attr_total_committed").alias("committed_lines"))
            for side in (self.session_bills, usual, self.session_tools, typed, self.session_price):
                s = s.join(side, "session_id", "left")
            counters = ["n_calls", "n_sidechain_calls", "n_unpriced_calls", "n_fast_calls", "n_tool_calls",
                        "n_tool_errors", "tool_result_chars", "n_human_turns", "human_chars", "n_interrupts"]
            return s.withColumns({
                "agent": F.coalesce("_agent", "calls_agent"),
                "mode": F.when(share.isNull(), "unknown").when(share >= 95, "vibe").when(share <= 5, "human").otherwise("collab"),
                "user_hash": F.substring(F.md5(F.coalesce(home, F.lit("unknown"))), 1, 10),
                **{c: zero(c) for c in counters},
            }).drop("_agent", "calls_agent")
        return self.table("sessions_x", build)

    # -- enriched tool calls ----------------------------------------------------

    @property
    def tool_facts(self) -> DataFrame:
        """Every tool call with its position and its session's attributes. The analyses of
        tool traffic all start here, so these joins are paid once."""
        def build():
            attrs = self.sessions_x.select(
                "session_id", F.lit(True).alias("in_catalog"), F.col("agent").alias("s_agent"), F.col("repo").alias("s_repo"),
                "mode", "committed_lines", "user_hash", "session_model", "n_calls", "session_cost_usd",
                "p_input", "p_cache_read", "p_cache_write_5m", "p_output")
            return (self.tool_calls.join(self.seq_pos, ["session_id", "seq"], "inner")
                    .join(attrs, "session_id", "left")
                    .withColumn("in_catalog", yes("in_catalog")))
        return self.table("tool_facts", build)

    # -- turns ------------------------------------------------------------------

    @property
    def turn_rows(self) -> DataFrame:
        """Prompts and main-line calls in session order, each with its turn number and the
        prompt that ends its turn."""
        def build():
            none = F.lit(None)
            asked = self.prompts.select(
                "session_id", "agent", "seq", "ts", F.lit(1).alias("is_user"), "human_chars",
                yes("is_interrupt").alias("is_interrupt"), F.lit(0.0).alias("cost_usd"), F.lit(0.0).alias("output_usd"),
                F.lit("").alias("tie"))
            done = self.calls_priced.where(~F.col("is_sidechain")).select(
                "session_id", "agent", "seq", "ts", F.lit(0).alias("is_user"), none.cast("long").alias("human_chars"),
                F.lit(False).alias("is_interrupt"), zero("cost_usd").alias("cost_usd"), zero("output_usd").alias("output_usd"),
                call_tie().alias("tie"))
            both = asked.unionByName(done).withColumn("side", 1 - F.col("is_user"))
            prompt = F.when(F.col("is_user") == 1, F.struct("seq", "ts", "is_interrupt", "human_chars"))
            return running(
                both, ["session_id"], ["seq", "side", "tie"],
                [Carry("turn_idx", F.col("is_user").cast("long")),
                 Carry("next_prompt", prompt, "last", inclusive=False, backwards=True)],
                self.blocks()).drop("side", "tie")
        return self.table("turn_rows", build)

    @property
    def turns(self) -> DataFrame:
        def build():
            user = F.col("is_user") == 1
            call = F.col("is_user") == 0
            next_ts = F.col("next_prompt.ts")
            in_time = call & (next_ts.isNull() | F.coalesce(F.col("ts") <= next_ts, F.lit(False)))
            t = self.turn_rows.groupBy("session_id", "turn_idx").agg(
                F.max("agent").alias("agent"),
                F.max(F.when(user, F.col("seq"))).alias("user_seq"),
                F.max(F.when(user, F.col("ts"))).alias("user_ts"),
                F.max(F.when(user, F.col("human_chars"))).alias("human_chars"),
                F.bool_or(F.when(user, F.col("is_interrupt"))).alias("is_interrupt"),
                rows_where(call).alias("n_calls"),
                F.min(F.when(call, F.col("ts"))).alias("first_call_ts"),
                F.max(F.when(call, F.col("ts"))).alias("last_call_ts"),
                F.max(F.when(call, F.col("seq"))).alias("last_call_seq"),
                F.sum("cost_usd").alias("turn_cost_usd"),
                F.sum("output_usd").alias("turn_output_usd"),
                F.max("next_prompt").alias("_next"),
                F.max(F.when(in_time, F.col("seq"))).alias("last_call_seq_adj"),
                F.max_by("ts", F.when(in_time & F.col("ts").isNotNull(), F.col("seq"))).alias("last_call_ts_adj"),
                rows_where(in_time).alias("n_calls_adj"))
            t = t.withColumns({
                "next_user_ts": F.col("_next.ts"), "next_user_seq": F.col("_next.seq"),
                "next_is_interrupt": F.col("_next.is_interrupt"), "next_human_chars": F.col("_next.human_chars"),
            }).drop("_next")
            t = running(t, ["session_id"], ["turn_idx"], [lookback("_prev", "last_call_ts_adj", "last_call_ts")],
                        self.blocks("turn_idx"))
            return t.withColumns({
                "prev_last_call_ts_adj": F.col("_prev.last_call_ts_adj"), "prev_last_call_ts": F.col("_prev.last_call_ts"),
            }).drop("_prev")
        return self.table("turns", build)

    # -- one-row totals ---------------------------------------------------------

    def bill_total(self, col: str = "cost_usd") -> Column:
        """Sum over all priced calls, as a scalar subquery."""
        return self.calls_priced.agg(total(col)).scalar()
