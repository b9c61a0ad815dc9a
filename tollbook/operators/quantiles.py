"""Exact interpolated quantiles per group.

``percentile`` keeps every distinct value of a group in one task. Here a first aggregate, beside
whatever else is asked of the group, brackets each quantile between two values of a bounded sketch
(``percentile_approx``, whose rank error is known). A second aggregate counts the values below and
at both ends, takes the nearest ones outside and gathers those strictly between them, a share of at most ``6 / ACCURACY`` of
the group however often a value repeats. The wanted ranks are then looked up. Both aggregates are reduced
before their exchange; there is no window, and no row is moved for its rank.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

ACCURACY = 10_000
MARGIN = 3 / ACCURACY  # thrice the sketch's error, on both sides


@dataclass(frozen=True)
class Distinct:
    """A count of distinct values among the aggregates of ``grouped``. It is taken by an aggregate of its own: beside
    sketches it would make Spark keep one sketch for every distinct value, all merged by one task."""

    name: str
    col: str


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """NULL-safe equality on all keys (still a hash-joinable condition)."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def attach(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on NULL-safe keys, keeping one copy of the keys."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def _bracket(value: Column, q: float) -> Column:
    """Number of values, and two of them between which the quantile lies."""
    ends = F.array(F.lit(max(0.0, q - MARGIN)), F.lit(min(1.0, q + MARGIN)))
    return F.struct(F.count(value).alias("n"), F.percentile_approx(value, ends, ACCURACY).alias("ends"))


def _facts(value: Column, ends: Column) -> Column:
    """What places ranks around a bracket: counts below, at and between its ends, the values between, and the next ones outside."""
    low, high = ends[0], ends[1]
    return F.struct(
        F.count_if(value < low).alias("below"), F.count_if(value == low).alias("low"), F.count_if((value == high) & (high > low)).alias("high"),
        F.array_sort(F.collect_list(F.when((value > low) & (value < high), value))).alias("inner"),
        F.max(F.when(value < low, value)).alias("before"), F.min(F.when(value > high, value)).alias("after"))


def _ranked(facts: Column, ends: Column, rank: Column) -> Column:
    """The value of a rank, counted from 0. In small groups it can be next to the bracket."""
    at = rank - facts["below"]
    inner = at - facts["low"]
    beyond = inner - F.size(facts["inner"])
    return (F.when(at < 0, facts["before"]).when(inner < 0, ends[0]).when(beyond < 0, F.get(facts["inner"], inner.cast("int")))
            .when(beyond < facts["high"], ends[1]).otherwise(facts["after"]))


def grouped(df: DataFrame, keys: list[str], aggs: list[Column | Distinct], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """``groupBy(keys).agg(aggs)`` plus the wanted quantiles, each of a (value, q)."""
    apart = [(i, a) for i, a in enumerate(aggs) if isinstance(a, Distinct)]
    if apart:
        out = grouped(df, keys, [a for a in aggs if not isinstance(a, Distinct)], wanted)
        counts = df.groupBy(*keys).agg(*[F.count_distinct(a.col).alias(a.name) for _, a in apart])
        order = list(out.columns)
        for i, a in apart:
            order.insert(len(keys) + i, a.name)
        found = attach(out, counts, keys) if keys else out.withColumns({a.name: counts.select(a.name).scalar() for _, a in apart})
        return found.select(*order)
    names = list(wanted)
    values = {f"_v{i}": wanted[n][0].cast("double") for i, n in enumerate(names)}
    facts = [_facts(F.col(f"_v{i}"), F.col(f"_b{i}.ends")).alias(f"_f{i}") for i in range(len(names))]
    # the first aggregate also holds what else is asked of a group; its row goes with the values to the second one
    first = df.groupBy(*keys).agg(*aggs, *[_bracket(wanted[n][0].cast("double"), wanted[n][1]).alias(f"_b{i}") for i, n in enumerate(names)])
    cells = [c.alias(v) for v, c in values.items()]
    if keys:
        rows = attach(df.select(*keys, *cells), first, keys, "inner")
        out = rows.groupBy(*keys).agg(*[F.first(c).alias(c) for c in first.columns if c not in keys], *facts)
    else:  # one row, also of nothing: no join
        brackets = first.select(F.struct(*[f"_b{i}" for i in range(len(names))])).scalar()
        found = df.select(*cells, brackets.alias("_b")).select(*values, "_b.*").agg(*facts).select(F.struct(*[f"_f{i}" for i in range(len(names))])).scalar()
        out = first.withColumn("_f", found).select("*", "_f.*").drop("_f")
    for i, n in enumerate(names):
        ends, count = F.col(f"_b{i}.ends"), F.col(f"_b{i}.n")
        place = (count - 1) * F.lit(float(wanted[n][1]))
        a, z = (_ranked(F.col(f"_f{i}"), ends, x) for x in (F.floor(place), F.ceil(place)))
        out = out.withColumn(n, F.when(count > 0, a + (z - a) * (place - F.floor(place))))
    return out.drop(*[f"_{kind}{i}" for kind in "bf" for i in range(len(names))])


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row per group with one column per wanted (value, q)."""
    return grouped(df, keys, [], wanted).select(*keys, *wanted)


def med(x) -> tuple[Column, float]:
    return (F.col(x) if isinstance(x, str) else x, 0.5)
