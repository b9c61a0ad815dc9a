"""Running values inside a key, without ever putting a whole key into one task.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task. Here the key is
cut into blocks along its ordering column first:

1. rows are exchanged by (key, block) and the running value is taken inside the block;
2. each block is reduced to one row, and a window over those few rows gives the value
   carried into every block from the blocks before it;
3. the carried value is joined back on (key, block) and combined.

A block holds a bounded stretch of the ordering column, so a key with a third of all rows
spreads over as many tasks as it has blocks. ``blocks=None`` takes the plain window instead,
for keys that are bounded by themselves; both give the same answer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_SPAN = 65_536


@dataclass(frozen=True)
class Carry:
    """One running value.

    how: ``sum`` | ``max`` | ``last`` (the latest non-NULL value).
    inclusive: whether the current row counts.
    backwards: run from the end of the ordering to its start.
    """

    name: str
    value: Column
    how: str = "sum"
    inclusive: bool = True
    backwards: bool = False


def span_blocks(col: str, span: int = BLOCK_SPAN) -> Column:
    """Blocks of ``span`` consecutive values of an integer ordering column."""
    return F.floor(F.col(col) / F.lit(span)).cast("long")


def _run(how: str, cell: Column, window) -> Column:
    if how == "sum":
        return F.sum(cell).over(window)
    if how == "max":
        return F.max(cell).over(window)
    return F.last(cell, ignorenulls=True).over(window)


def _window(part: list[str], order: list[str], c: Carry):
    ordering = [F.col(o).desc() if c.backwards else F.col(o).asc() for o in order]
    w = Window.partitionBy(*part).orderBy(*ordering)
    return w.rowsBetween(Window.unboundedPreceding, 0 if c.inclusive else -1)


def _reduce(c: Carry, cell: Column, order: list[str]) -> Column:
    if c.how == "sum":
        return F.sum(cell)
    if c.how == "max":
        return F.max(cell)
    place = F.when(cell.isNotNull(), F.struct(*order))
    return F.min_by(cell, place) if c.backwards else F.max_by(cell, place)


def _combine(c: Carry, near: Column, far: Column) -> Column:
    if c.how == "sum":
        return F.coalesce(near + far, near, far)
    if c.how == "max":
        return F.greatest(near, far)
    return F.coalesce(near, far)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    carries: list[Carry],
    blocks: Column | None = None,
) -> DataFrame:
    """Add one column per carry. ``order`` names non-NULL columns that order a key totally."""
    cells = {c.name: f"_in_{c.name}" for c in carries}
    df = df.withColumns({cells[c.name]: c.value for c in carries})
    if blocks is None:
        out = df.withColumns({c.name: _run(c.how, F.col(cells[c.name]), _window(keys, order, c)) for c in carries})
        return out.drop(*cells.values())

    part = [*keys, "_block"]
    df = df.withColumn("_block", blocks).repartition(*part)
    near = df.withColumns(
        {f"_near_{c.name}": _run(c.how, F.col(cells[c.name]), _window(part, order, c)) for c in carries}
    )
    per_block = df.groupBy(*part).agg(
        *[_reduce(c, F.col(cells[c.name]), order).alias(f"_far_{c.name}") for c in carries]
    )
    far = per_block.withColumns({
        f"_far_{c.name}": _run(
            c.how,
            F.col(f"_far_{c.name}"),
            _window(keys, ["_block"], Carry(c.name, c.value, c.how, False, c.backwards)),
        )
        for c in carries
    })
    out = near.join(far, part, "inner").withColumns(
        {c.name: _combine(c, F.col(f"_near_{c.name}"), F.col(f"_far_{c.name}")) for c in carries}
    )
    return out.drop("_block", *cells.values(), *[f"_{p}_{c.name}" for c in carries for p in ("near", "far")])


def lookback(name: str, *cols: str) -> Carry:
    """The previous row's columns as one struct (``lag``)."""
    return Carry(name, F.struct(*cols), "last", inclusive=False)


def lookahead(name: str, *cols: str) -> Carry:
    """The next row's columns as one struct (``lead``)."""
    return Carry(name, F.struct(*cols), "last", inclusive=False, backwards=True)
