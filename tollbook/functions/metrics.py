"""Small aggregate and projection helpers shared by the analyses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CHARS_PER_TOKEN = 4.0
PER_MILLION = 1e6


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def zero(x) -> Column:
    """NULL counts as nothing."""
    return F.coalesce(_c(x), F.lit(0))


def yes(x) -> Column:
    """Three-valued flag read as a plain one: NULL is no."""
    return F.coalesce(_c(x), F.lit(False))


def rows() -> Column:
    return F.count(F.lit(1))


def rows_where(p: Column) -> Column:
    return F.count(F.when(p, 1))


def total(x) -> Column:
    return F.sum(zero(x))


def sum_where(p: Column, x) -> Column:
    return F.sum(F.when(p, _c(x)))


def distinct_where(p: Column, x) -> Column:
    return F.count_distinct(F.when(p, _c(x)))


def ratio(a, b) -> Column:
    """a / b in double; NULL where b is zero."""
    return _c(a).cast("double") / F.nullif(_c(b).cast("double"), F.lit(0.0))


def pct(a, b) -> Column:
    return F.lit(100.0) * ratio(a, b)


def chars_as_tokens(x) -> Column:
    return _c(x).cast("double") / CHARS_PER_TOKEN


def usd(tokens, price_per_million) -> Column:
    return _c(tokens).cast("double") * _c(price_per_million) / PER_MILLION


def millis_between(start, end) -> Column:
    """Whole milliseconds on the clock at ``end`` less those at ``start``."""
    a, b = (F.unix_millis(_c(x).cast("timestamp")) for x in (start, end))
    return b - a


def seconds_between(start, end) -> Column:
    return millis_between(start, end) / 1000.0


def bands(x, edges: list[tuple[float, str]], beyond: str) -> Column:
    """Label of the first edge that ``x`` is below; ``beyond`` above all (and for NULL)."""
    value = _c(x)
    out = None
    for edge, label in edges:
        out = F.when(value < edge, label) if out is None else out.when(value < edge, label)
    return out.otherwise(beyond)


def at_most(df, n: int | None):
    """The first n rows, or all."""
    return df if n is None else df.limit(n)


def lead_part(x, n: int) -> Column:
    return F.substring(_c(x), 1, n)


def month_of(ts) -> Column:
    return F.date_trunc("month", _c(ts)).cast("timestamp_ntz")


def version_key(version) -> Column:
    """'2.10.3-beta' -> [2, 10, 3], so that versions sort by number."""
    parts = F.split(F.regexp_replace(_c(version), "-.*$", ""), "[.]")
    return F.transform(parts, lambda p: p.try_cast("int"))


def call_tie() -> Column:
    """Order among several calls on one record number: by message, then time, then size."""
    return F.concat_ws("|", "msg_id", F.col("ts").cast("string"), F.lpad(F.col("output_tokens").cast("string"), 12, "0"), F.col("n_text_chars").cast("string"))
