"""Forcing loosely typed answers to their declared type, with a note of every repair.

Every rule gives a struct (value, coerced, invalid): ``coerced`` marks a usable value of
the wrong type or spelling, ``invalid`` one that had to be replaced."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tollbook.functions.prompts import stripped
from tollbook.functions.variants import as_text, dump, is_text, kind

# Spellings of yes.
TRUE_STRINGS = ["true", "yes", "1"]


def _there(v: Column) -> Column:
    return v.isNotNull() & ~F.is_variant_null(v)


def _plain(v: Column) -> Column:
    return F.coalesce(as_text(v), F.try_variant_get(v, "$", "string"), dump(v))


def _kind_is(v: Column, *names: str) -> Column:
    return F.coalesce(kind(v).isin(*names), F.lit(False))


def _outcome(value: Column, coerced: Column, invalid: Column) -> Column:
    return F.struct(value.alias("value"), F.coalesce(coerced, F.lit(False)).alias("coerced"), F.coalesce(invalid, F.lit(False)).alias("invalid"))


def coerce_text(v: Column, default: str | None = None) -> Column:
    there = F.coalesce(_there(v), F.lit(False))
    return _outcome(F.when(there, _plain(v)).otherwise(F.lit(default)), there & ~is_text(v), ~there & F.lit(default is not None))


def coerce_enum(v: Column, allowed: list[str], fallback: str) -> Column:
    s = as_text(v)
    low = F.lower(stripped(s))
    exact, close = F.coalesce(s.isin(*allowed), F.lit(False)), F.coalesce(low.isin(*allowed), F.lit(False))
    return _outcome(F.when(exact, s).when(close, low).otherwise(fallback), ~exact & close, ~exact & ~close)


def coerce_language(v: Column) -> Column:
    """A lower-case two-letter code, else 'unknown'; 'en-US' is 'en'."""
    s = as_text(v)
    low = F.lower(stripped(s))
    code = F.when(low.rlike("^..[-_]"), F.substring(low, 1, 2)).otherwise(low)
    good = F.coalesce(code.rlike(r"^\p{L}{2}$"), F.lit(False))
    return _outcome(F.when(good, code).otherwise("unknown"), good & (code != s), ~good)


def coerce_flag(v: Column) -> Column:
    there, exact = F.coalesce(_there(v), F.lit(False)), _kind_is(v, "BOOLEAN")
    said = F.coalesce(F.lower(stripped(as_text(v))).isin(*TRUE_STRINGS), F.lit(False))
    return _outcome(F.when(exact, F.try_variant_get(v, "$", "boolean")).otherwise(said), there & ~exact, ~there)


def coerce_integer(v: Column) -> Column:
    there, exact = F.coalesce(_there(v), F.lit(False)), _kind_is(v, "BIGINT")
    truth = F.when(_kind_is(v, "BOOLEAN"), F.try_variant_get(v, "$", "boolean").cast("long"))
    number = F.coalesce(truth, F.trim(_plain(v)).try_cast("double").cast("long"))
    value = F.when(exact, F.try_variant_get(v, "$", "long")).when(there, number)
    return _outcome(value, there & ~exact & number.isNotNull(), ~there | (~exact & number.isNull()))


def shown_value(v: Column) -> Column:
    """Type and start of a value, for the repair report."""
    kinds = {"STRING": "str", "BOOLEAN": "bool", "BIGINT": "int", "DOUBLE": "float"}
    k = F.coalesce(kind(v), F.lit("VOID"))
    name = F.when(k == "VOID", "none")
    for spark_name, short in kinds.items():
        name = name.when(k == spark_name, short)
    name = name.when(k.startswith("OBJECT"), "dict").when(k.startswith("ARRAY"), "list").otherwise("float")
    plain = F.when(_there(v), _plain(v)).otherwise("")
    cut = F.when(F.length(plain) > 60, F.concat(F.substring(plain, 1, 57), F.lit("..."))).otherwise(plain)
    return F.rtrim(F.concat(name, F.lit(" "), cut))
