"""Time stamps as the harnesses write them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def iso_time(value: Column) -> Column:
    """'2026-04-24T21:13:53.677Z'; up to six digits of the fraction, the zone is not read."""
    digits = F.regexp_extract(F.substr(value, F.lit(20)), r"^\.([0-9]+)", 1)
    plain = F.concat(F.substring(value, 1, 10), F.lit(" "), F.substring(value, 12, 8))
    full = F.when(digits != "", F.concat(plain, F.lit("."), F.substring(digits, 1, 6))).otherwise(plain)
    return F.when(F.length(value) >= 19, full.try_cast("timestamp_ntz"))


def epoch_time(value: Column) -> Column:
    """Milliseconds or seconds since 1970, told apart by size."""
    v = value.try_cast("double")
    micros = F.when(v > 1e12, v * 1e3).otherwise(v * 1e6)
    return F.when(v > 0, F.timestamp_micros(micros.cast("long")).cast("timestamp_ntz"))


def to_millis(ts: Column) -> Column:
    """Cut to the millisecond, the resolution of the ledger."""
    return F.date_trunc("millisecond", ts).cast("timestamp_ntz")


def latency_ms(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end).cast("long") / F.lit(1000)
