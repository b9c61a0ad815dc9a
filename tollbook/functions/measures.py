"""Measures of a text: numbering prefixes, markdown structure, JSON weight, redundancy."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType

from tollbook.functions.variants import as_text

# Line-number styles, in order of preference; one match per line at most.
NUMBER_STYLES = {
    "tab": r"(?md)^[ \t]*\d+\t",
    "arrow": r"(?md)^[ \t]*\d+→",
    "colon": r"(?md)^[ \t]*\d+: ",
    "pipe": r"(?md)^[ \t]*\d+ ?\| ?",
}
# Markdown line patterns.
HEADER = r"(?d)^ {0,3}(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$"
BOLD_HEADER = r"(?d)^ {0,3}\*\*([^*]{1,80})\*\*:?[ \t]*$"
BULLET = r"(?d)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+\S"
FENCE = r"(?d)^[ \t]*(?:```|~~~)"
SUMMARY = r"(?i)summary|recap|next steps?|what i did"
# File endings by language, keys of written content, edges of the ratio buckets.
ENDINGS = {
    "py": "py", "ts": "ts", "tsx": "tsx", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "go": "go", "rs": "rs", "md": "md",
    "markdown": "md", "json": "json", "jsonl": "json", "yaml": "yaml", "yml": "yaml",
}
WRITTEN_KEYS = ["new_string", "newString", "new_str", "content", "contents", "file_text", "new_content", "text", "patchText", "patch", "diff"]
RATIO_EDGES = [(2.0, "<2"), (3.0, "2-3"), (5.0, "3-5"), (10.0, "5-10"), (20.0, "10-20")]


def count_of(text: Column, piece: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))


def share(part: Column, whole: Column) -> Column:
    """part / whole in double, 0 where there is nothing."""
    return F.coalesce(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def _matched(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def numbered_listing(text: Column) -> dict[str, Column]:
    """How much of a file listing is line numbers. The style with the most numbered lines
    counts, if at least half of the non-empty lines carry it."""
    tried = F.array(*[
        F.struct(F.size(_matched(text, p)).alias("hits"), F.lit(-i).alias("rank"), F.lit(name).alias("style"),
                 F.length(F.array_join(_matched(text, p), "")).alias("chars"))
        for i, (name, p) in enumerate(NUMBER_STYLES.items())
    ])
    n_lines = count_of(text, "\n") + 1
    some = F.regexp_count(text, F.lit(r"(?mdU)^.*\S"))
    best = F.array_max(tried)
    ok = (best["hits"] > 0) & (best["hits"] >= 0.5 * some)
    head = F.substring(text, 1, 600)
    image = (F.length(text) > 2000) & (n_lines <= 3) & (
        head.contains('"type":"image"') | head.contains('"base64"') | head.contains('"media_type"'))
    return {
        "result_chars": F.length(text).cast("long"), "n_lines": n_lines.cast("long"),
        "style": F.when(ok, best["style"]).when(image, "image_base64").otherwise("none"),
        "n_prefixed_lines": F.when(ok, best["hits"]).otherwise(0).cast("long"),
        "prefix_chars": F.when(ok, best["chars"]).otherwise(0).cast("long"),
        "prefix_share": share(F.when(ok, best["chars"]).otherwise(0), F.length(text)),
        "prefixed_line_share": share(F.when(ok, best["hits"]).otherwise(0), n_lines),
    }


def reply_structure(text: Column) -> Column:
    """Struct of markdown counts of a reply: headers, bullets, fences and summary sections.

    Lines are folded in order; inside a fence nothing is a header or bullet, but the lines
    of a summary section count whatever they are."""
    zero = F.lit(0).cast("long")
    names = ["fence_lines", "headers", "header_chars", "bullets", "bullet_chars", "summary_chars"]
    start = F.struct(*[zero.alias(n) for n in names], F.lit(False).alias("fenced"), F.lit(False).alias("summing"))

    def step(a, line):
        size = (F.length(line) + 1).cast("long")
        fence = line.rlike(FENCE)
        title = F.when(line.rlike(HEADER), F.regexp_extract(line, HEADER, 2)).when(line.rlike(BOLD_HEADER), F.regexp_extract(line, BOLD_HEADER, 1))
        plain = ~fence & ~a["fenced"]
        header = plain & title.isNotNull()
        bullet = plain & title.isNull() & line.rlike(BULLET)
        def add(name, p, by):
            return (a[name] + F.when(p, by).otherwise(0)).alias(name)
        return F.struct(
            add("fence_lines", fence, F.lit(1)), add("headers", header, F.lit(1)), add("header_chars", header, size),
            add("bullets", bullet, F.lit(1)), add("bullet_chars", bullet, size), add("summary_chars", a["summing"] & ~header, size),
            F.when(fence, ~a["fenced"]).otherwise(a["fenced"]).alias("fenced"),
            F.when(header, F.coalesce(title.rlike(SUMMARY), F.lit(False))).otherwise(a["summing"]).alias("summing"))

    return F.aggregate(F.split(text, "\n"), start, step)


def reply_columns(text: Column, folded: Column) -> dict[str, Column]:
    """Columns of ``reply_structure`` once it has been computed into ``folded``."""
    total = F.length(text)
    summary = F.least(folded["summary_chars"], total)
    return {
        "text_chars": total.cast("long"), "n_lines": (count_of(text, "\n") + 1).cast("long"), "n_headers": folded["headers"],
        "n_bullets": folded["bullets"], "n_fences": F.floor(folded["fence_lines"] / 2).cast("long"), "header_chars": folded["header_chars"],
        "bullet_chars": folded["bullet_chars"], "summary_chars": summary.cast("long"), "summary_share": share(summary, total),
        "bullet_share": share(folded["bullet_chars"], total),
    }


def leaf_chars(dumped: Column) -> Column:
    """Characters of all string values inside a compact JSON text (names of fields, which a
    colon follows, do not count; an escape is one character)."""
    strings = F.regexp_extract_all(dumped, F.lit(r'"(?:[^"\\]++|\\.)*+":?'), F.lit(0))
    values = F.filter(strings, lambda x: ~x.endswith(":"))
    plain = F.transform(values, lambda x: F.length(F.regexp_replace(x, r"\\u[0-9a-fA-F]{4}|\\.", "x")) - 2)
    return F.aggregate(plain, F.lit(0).cast("long"), lambda n, x: n + x)


def deflated_sizes(texts: pa.Array) -> pa.Array:
    """Size of each text after zlib at level 6. The texts are read where they lie in the column, none is copied."""
    return pa.array([None if not t.is_valid else len(zlib.compress(t.as_buffer(), 6)) for t in texts], pa.int64())


@F.arrow_udf(LongType())
def deflated_bytes(text: pa.Array) -> pa.Array:
    return deflated_sizes(text)


def ratio_bucket(ratio: Column) -> Column:
    out = None
    for edge, label in RATIO_EDGES:
        out = F.when(ratio < edge, label) if out is None else out.when(ratio < edge, label)
    return out.otherwise(">=20")


def file_ending(path: Column) -> Column:
    base = F.regexp_extract(path, "([^/]*)$", 1)
    known = F.create_map(*[F.lit(x) for pair in ENDINGS.items() for x in pair])
    named = F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1))), F.lit("other"))
    return F.when(F.coalesce(path, F.lit("")) == "", "none").otherwise(named)


def written_content(inp: Column) -> Column:
    """The longest string among the keys that hold written content."""
    found = [as_text(F.try_variant_get(inp, f"$.{k}", "variant")) for k in WRITTEN_KEYS]
    sized = F.array(*[F.struct(F.coalesce(F.length(c), F.lit(0)).alias("n"), F.lit(-i).alias("rank"), c.alias("text")) for i, c in enumerate(found)])
    return F.coalesce(as_text(inp), F.array_max(sized)["text"], F.lit(""))


def indent_chars(text: Column) -> Column:
    return F.length(F.array_join(_matched(text, r"(?md)^[ \t]+"), ""))
