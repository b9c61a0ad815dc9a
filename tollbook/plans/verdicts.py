"""Judging sampled cases: transcript slices around them, answers, rates with intervals."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tollbook.functions.coercion import coerce_enum, coerce_flag, coerce_integer, coerce_text
from tollbook.functions.metrics import pct, rows
from tollbook.functions.prompts import stripped
from tollbook.functions.tools import result_text
from tollbook.functions.variants import as_text, dump, filled, flag, is_list, is_object, is_text, items, node, text
from tollbook.ingest.codex import CALL_ITEMS
from tollbook.operators.ranking import hash_order
from tollbook.operators.sampling import first_by_hash
from tollbook.plans.labels import coerced
from tollbook.schemas import CASES

@dataclass(frozen=True)
class Limits:
    """Characters shown of each kind of text in a slice, and of the slice; without a number all of them."""

    text: int | None = None
    args: int | None = None
    result: tuple[int, int] | None = None  # from the start and from the end
    system: int | None = None
    slice: int | None = None


WHOLE = Limits()
# What a request to a judging model holds.
REQUEST_LIMITS = Limits(text=3000, args=1500, result=(2000, 500), system=300, slice=60_000)
OPENCODE_DIVISOR = 4
DEFAULT_REACH = {"rewrite_necessary": (12, 6), "tool_result_used": (2, 14), "hot_file_cause": (10, 10)}
# Fields of each rubric, their rule, and which value counts as a hit.
FRACTIONS = ["none", "small", "most", "all"]
CAUSES = ["architecture_hub", "agent_regression", "user_iteration", "config_churn", "test_file", "unclear"]
RUBRICS = {
    "rewrite_necessary": {
        "was_full_rewrite_needed": coerce_flag, "estimated_lines_actually_changed": coerce_integer, "reason": lambda v: coerce_text(v, "")},
    "tool_result_used": {
        "was_result_referenced_later": coerce_flag, "fraction_of_result_needed": lambda v: coerce_enum(v, FRACTIONS, "none"), "reason": lambda v: coerce_text(v, "")},
    "hot_file_cause": {"cause": lambda v: coerce_enum(v, CAUSES, "unclear"), "reason": lambda v: coerce_text(v, "")},
}
HITS = {"rewrite_necessary": ("was_full_rewrite_needed", False), "tool_result_used": ("was_result_referenced_later", False),
        "hot_file_cause": ("cause", "agent_regression")}
CODEX_OUTPUTS = ["function_call_output", "custom_tool_call_output", "local_shell_call_output", "web_search_call_output"]


# ---------------------------------------------------------------- cases


def read_cases(spark: SparkSession, path: str, case_type: str) -> DataFrame:
    """Cases from a headed CSV: the core columns, and all others as facts."""
    raw = spark.read.csv(path, header=True)
    core = {f.name for f in CASES.fields}
    facts = [x for c in raw.columns if c not in core for x in (F.lit(c), F.col(f"`{c}`"))]
    given = F.create_map(*facts) if facts else F.create_map().cast("map<string,string>")
    before, after = DEFAULT_REACH.get(case_type, (10, 10))
    def number(name, default):
        if name not in raw.columns:
            return F.lit(default)
        return F.coalesce(F.col(name).try_cast("double").cast("int"), F.lit(default))
    out = raw.withColumn("facts", F.map_filter(given, lambda k, v: v.isNotNull() & (v != "")))
    return out.select(
        "session_id", F.col("seq").try_cast("double").cast("int").alias("seq"), number("k_before", before).alias("k_before"),
        number("k_after", after).alias("k_after"), (F.nullif(F.col("stratum"), F.lit("")) if "stratum" in raw.columns else F.lit(None).cast("string")).alias("stratum"),
        number("population_n", 0).cast("long").alias("population_n"), "facts").where("seq IS NOT NULL")


def synthetic_cases(tool_calls: DataFrame, case_type: str, n: int, seed: int, agent: str | None = None) -> DataFrame:
    """A seeded draw of tool calls that fit the case type."""
    fits = {"rewrite_necessary": (F.col("tool_kind") == "write") & (F.col("content_chars") > 200),
            "tool_result_used": F.col("result_chars") > 5000}[case_type]
    pool = tool_calls.where(fits)
    if agent:
        pool = pool.where(F.col("agent") == agent)
    before, after = DEFAULT_REACH[case_type]
    return first_by_hash(pool, hash_order("session_id", "seq", seed=str(seed)), n, ["session_id", "seq"]).select(
        "session_id", "seq", F.lit(before).alias("k_before"), F.lit(after).alias("k_after"), F.col("agent").alias("stratum"), F.lit(0).cast("long").alias("population_n"))


# ---------------------------------------------------------------- slices


def case_windows(cases: DataFrame, sessions: DataFrame) -> DataFrame:
    """Cases with their format and the record range to show; a message of opencode holds many
    records of the others, so fewer are taken."""
    s = sessions.select("session_id", "fmt", F.col("repo").alias("s_repo"), F.lit(True).alias("known"))
    doc = F.col("fmt") == "opencode"
    before = F.when(doc, F.greatest(F.floor(F.col("k_before") / OPENCODE_DIVISOR), F.lit(2))).otherwise(F.col("k_before"))
    after = F.when(doc, F.greatest(F.floor(F.col("k_after") / OPENCODE_DIVISOR), F.lit(1))).otherwise(F.col("k_after"))
    return cases.withColumn("focus", F.col("seq")).join(s, "session_id", "left").withColumns({
        "lo": F.greatest(F.col("seq") - before, F.lit(0)).cast("int"), "hi": (F.col("seq") + after).cast("int")})


def slice_records(windows: DataFrame, records: DataFrame) -> DataFrame:
    """Records of every case. A case lists the few record numbers it covers; they are met by
    equality, so no session is ever gathered."""
    wanted = windows.where("fmt IS NOT NULL").select("session_id", "focus", F.explode(F.sequence("lo", "hi")).alias("seq"))
    return wanted.join(records.select("session_id", "seq", "fmt", "v"), ["session_id", "seq"])


def _whole_text(v: Column) -> Column:
    """A string, the texts of a list, or JSON."""
    pieces = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda b: F.coalesce(F.when(is_object(b), text(b, "text")), as_text(b), F.lit("")))
    return F.when(v.isNull(), "").when(is_list(v), F.array_join(pieces, "")).otherwise(F.coalesce(as_text(v), dump(v)))


def _block(kind, name, body) -> Column:
    def col(x):
        return (x if isinstance(x, Column) else F.lit(x)).cast("string")
    return F.struct(col(kind).alias("kind"), col(name).alias("name"), body.alias("body"))


def _start(text: Column, n: int | None) -> Column:
    return text if n is None else F.substring(text, 1, n)


def blocks(recs: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    """Readable blocks of the records of all formats: (kind, name, body) in their order.
    Thoughts, attachments and counters are left out."""
    v, b = F.col("v"), F.col("b")
    keep = ["session_id", "focus", "seq", "fmt"]
    content = node(v, "message.content")
    typ, role = text(v, "type"), text(v, "role")
    none = F.lit(None)

    chat = recs.where(F.col("fmt").isin("claude_code", "cursor")).withColumn(
        "who", F.when(F.col("fmt") == "cursor", F.when(role == "user", "user").when(role.isNotNull(), "assistant")).when(typ.isin("user", "assistant"), typ))
    plain = chat.where(F.col("who").isNotNull() & is_text(content)).select(*keep, F.lit(0).alias("pos"), _block(F.col("who"), none, as_text(content)).alias("x"))
    each = chat.where("who IS NOT NULL").select(*keep, "who", F.posexplode(items(v, "message.content")).alias("pos", "b")).where(is_object(b))
    bt, claude = text(b, "type"), F.col("fmt") == "claude_code"
    shown = (F.when(bt == "text", _block(F.col("who"), none, F.coalesce(text(b, "text"), F.lit(""))))
             .when((bt == "tool_use") & ((F.col("who") == "assistant") | ~claude), _block("tool_use", text(b, "name"), dump(node(b, "input"))))
             .when(claude & (F.col("who") == "assistant") & (bt == "server_tool_use"), _block("tool_use", text(b, "name"), dump(node(b, "input"))))
             .when(claude & (F.col("who") == "user") & bt.isin("tool_result", "advisor_tool_result"),
                   _block(F.when(flag(b, "is_error"), "tool_error").otherwise("tool_result"), none, result_text(node(b, "content")))))
    listed = each.select(*keep, "pos", shown.alias("x"))
    system = recs.where((F.col("fmt") == "claude_code") & (typ == "system")).select(
        *keep, F.lit(0).alias("pos"), _block("system", F.coalesce(filled(v, "subtype"), F.lit("system")), _start(_whole_text(node(v, "content")), limits.system)).alias("x"))

    p = node(v, "payload")
    pt = text(p, "type")
    args = F.coalesce(node(p, "arguments"), node(p, "input"), node(p, "action"), node(p, "query"))
    body, item, event = _whole_text(node(p, "content")), typ == "response_item", typ == "event_msg"
    prole = text(p, "role")
    coded = (F.when(item & (pt == "message") & prole.isin("user", "assistant"), _block(prole, none, body))
             .when(item & (pt == "message"), _block("system", prole, _start(body, limits.system)))
             .when(item & pt.isin(*CALL_ITEMS), _block("tool_use", F.coalesce(filled(p, "name"), pt), F.coalesce(as_text(args), dump(args))))
             .when(item & pt.isin(*CODEX_OUTPUTS), _block("tool_result", none, result_text(node(p, "output"))))
             .when(event & (pt == "user_message"), _block("user", none, _whole_text(node(p, "message"))))
             .when(event & (pt == "agent_message"), _block("assistant", none, _whole_text(node(p, "message"))))
             .when(typ == "compacted", _block("system", "compacted", F.lit("[context compacted here]"))))
    codex = recs.where("fmt = 'codex'").select(*keep, F.lit(0).alias("pos"), coded.alias("x"))

    parts = recs.where("fmt = 'opencode'").select(*keep, text(v, "info.role").alias("who"), F.posexplode(items(v, "parts")).alias("pos", "b")).where(is_object(b))
    state = node(b, "state")
    given = node(state, "input")
    err = node(state, "error")
    spoken = parts.where(bt == "text").select(
        *keep, (F.col("pos") * 2).alias("pos"), _block(F.when(F.col("who") == "user", "user").otherwise("assistant"), none, F.coalesce(text(b, "text"), F.lit(""))).alias("x"))
    used = parts.where(bt == "tool").select(*keep, (F.col("pos") * 2).alias("pos"), _block("tool_use", text(b, "tool"), F.coalesce(as_text(given), dump(given))).alias("x"))
    got = parts.where(bt == "tool").select(
        *keep, (F.col("pos") * 2 + 1).alias("pos"),
        F.when(flag(state, "error"), _block("tool_error", none, _whole_text(err))).when(
            node(state, "output").isNotNull(), _block("tool_result", none, result_text(node(state, "output")))).alias("x"))
    every = reduce(DataFrame.unionByName, [plain, listed, system, codex, spoken, used, got])
    return every.where("x IS NOT NULL").select(*keep, "pos", "x.*").withColumn("body", stripped(F.coalesce("body", F.lit("")))).where("body <> ''")


def clip(body: Column, head: int | None = None, tail: int = 0) -> Column:
    """Start (and end) of a long text with the number of characters left out; all of it where no number is given."""
    if head is None:
        return body
    n = F.length(body)
    gone = F.concat(F.lit("\n... "), (n - head - tail).cast("string"), F.lit(" chars omitted ..."))
    cut = F.concat(F.substring(body, 1, head), gone)
    if tail:
        cut = F.concat(cut, F.lit("\n"), F.substr(body, n - tail + 1))
    return F.when(n <= head + tail, body).otherwise(cut)


def render_slices(shown: DataFrame, limits: Limits = WHOLE) -> DataFrame:
    """One transcript per case. codex writes prompts and replies twice; the later copy goes."""
    same = F.struct("kind", "name", F.sha1("body").alias("body"))
    keyed = shown.withColumn("_same", F.when(F.col("fmt") == "codex", F.to_json(same)).otherwise(F.concat_ws(":", "seq", "pos")))
    first = keyed.groupBy("session_id", "focus", "_same").agg(F.min_by(F.struct("seq", "pos", "kind", "name", "body"), F.struct("seq", "pos")).alias("b"))
    first = first.select("session_id", "focus", "b.*")
    at = F.concat(F.lit("["), F.col("seq").cast("string"), F.lit("] "))
    mark = F.when(F.col("seq") == F.col("focus"), "  <<< CASE FOCUS").otherwise("")
    body = F.col("body")
    n = F.length(body).cast("string")
    line = (F.when(F.col("kind") == "user", F.concat(at, F.lit("USER:"), mark, F.lit("\n"), clip(body, limits.text)))
            .when(F.col("kind") == "assistant", F.concat(at, F.lit("ASSISTANT:"), mark, F.lit("\n"), clip(body, limits.text)))
            .when(F.col("kind") == "tool_use", F.concat(at, F.lit("TOOL_USE "), F.coalesce(F.nullif("name", F.lit("")), F.lit("?")), F.lit(":"), mark, F.lit("\n"), clip(body, limits.args)))
            .when(F.col("kind") == "system", F.concat(at, F.lit("SYSTEM "), F.coalesce("name", F.lit("")), F.lit(": "), clip(body, limits.system)))
            .otherwise(F.concat(at, F.lit("TOOL_RESULT ("), F.when(F.col("kind") == "tool_error", "ERROR").otherwise("ok"), F.lit(", "), n, F.lit(" chars):"), mark, F.lit("\n"),
                                clip(body, *(limits.result or ())))))
    # a slice is a few records wide
    whole = first.select("session_id", "focus", "seq", F.struct("seq", "pos", line.alias("line")).alias("_l")).groupBy("session_id", "focus").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_l")), lambda x: x["line"]), "\n\n").alias("slice"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    if limits.slice is None:
        return whole
    max_chars = limits.slice
    capped = F.when(F.length("slice") > max_chars, F.concat(F.substring("slice", 1, max_chars), F.lit("\n\n[... transcript truncated ...]"))).otherwise(F.col("slice"))
    return whole.withColumn("slice", capped)


def skip_reasons(windows: DataFrame, recs: DataFrame, slices: DataFrame) -> DataFrame:
    """Cases that cannot be judged, by reason."""
    has = recs.select("session_id", "focus").distinct().withColumn("_recs", F.lit(True))
    ok = slices.select("session_id", "focus").withColumn("_slice", F.lit(True))
    reason = (F.when(F.col("known").isNull(), "session not in ledger").when(F.col("fmt").isNull(), "unknown harness format")
              .when(F.col("_recs").isNull(), "no records in range").when(F.col("_slice").isNull(), "slice compacted to nothing"))
    return windows.join(has, ["session_id", "focus"], "left").join(ok, ["session_id", "focus"], "left").withColumn("reason", reason).where(
        "reason IS NOT NULL").groupBy("reason").agg(rows().alias("cases")).orderBy("reason")


# ---------------------------------------------------------------- verdicts


def verdict_rows(cases: DataFrame, answers: DataFrame, case_type: str, model: str) -> DataFrame:
    """``answers``: session_id, seq, ``rec`` (VARIANT), cost_usd. Keeps the repair structs."""
    return coerced(cases.join(answers, ["session_id", "seq"]), "rec", RUBRICS[case_type]).withColumns({
        "case_type": F.lit(case_type), "stratum": F.coalesce("stratum", F.lit("unknown")), "model": F.lit(model)})


def finished(judged: DataFrame, case_type: str) -> DataFrame:
    return judged.select("session_id", "seq", "case_type", "stratum", *[F.col(f"_f_{f}.value").alias(f) for f in RUBRICS[case_type]], "model",
                         F.col("cost_usd").cast("double").alias("cost_usd"))


Z = 1.96


def wilson(hits: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """95% interval of a rate."""
    n, p = n.cast("double"), hits.cast("double") / F.nullif(n.cast("double"), F.lit(0.0))
    d = 1.0 + z * z / n
    centre = (p + z * z / (2.0 * n)) / d
    half = z * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n)) / d
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def rate_summary(judged: DataFrame, hit: Column, population: DataFrame | None = None, stratum: str = "stratum") -> DataFrame:
    """Cases, hits, rate and interval per stratum and overall; rates are scaled to
    ``population`` (stratum, population_n) where given."""
    counted = judged.groupBy(F.col(stratum).alias("stratum")).agg(rows().alias("cases"), F.count(F.when(hit, 1)).alias("hits"))
    if population is None:
        counted = counted.withColumn("population", F.lit(None).cast("long"))
        everyone = F.lit(None).cast("long")
    else:
        sizes = population.groupBy(F.col(stratum).alias("stratum")).agg(F.max("population_n").alias("population"))
        counted = counted.join(sizes, "stratum", "left")
        everyone = sizes.agg(F.sum("population")).scalar()
    whole = counted.agg(F.sum("cases").alias("cases"), F.sum("hits").alias("hits")).select(
        F.lit("all").alias("stratum"), "cases", "hits").withColumn("population", everyone)
    low, high = wilson(F.col("hits"), F.col("cases"))
    scaled = F.when(F.col("population") > 0, F.col("population") * F.col("hits") / F.col("cases"))
    return counted.select("stratum", "cases", "hits", "population").unionByName(whole).withColumns({
        "rate": pct("hits", "cases"), "low": 100.0 * low, "high": 100.0 * high, "extrapolated": scaled.cast("double")}).orderBy("stratum")


def verdict_summary(judged: DataFrame, case_type: str, population: DataFrame | None = None) -> DataFrame:
    field, good = HITS[case_type]
    value = F.col(field)
    hit = F.coalesce(value, F.lit(False)) == F.lit(good) if isinstance(good, bool) else value == good
    return rate_summary(judged, hit, population)
