"""Ordered operators over long groups, without one task per group.

A sensor's capture can hold a large part of all rows, so a window function over the
whole capture would put them into one task. Here a group is cut into cells (stretches of
its order), each cell is worked on alone, one summary row per cell is carried forward in
order, and the carry is joined back. Only summaries meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = "_cell"
FIRST = Window.unboundedPreceding
HERE = Window.currentRow


def cell_of(order_col: Column | str, width: int) -> Column:
    """Cell number of a position on an integer axis."""
    col = F.col(order_col) if isinstance(order_col, str) else order_col
    return F.floor(col / F.lit(width)).cast("bigint") if width != 1 else col


def order_value(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def cell_window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, CELL).orderBy(*order)


def carry_window(keys: Sequence[str]):
    """Earlier cells of the same group, over the summary table."""
    return Window.partitionBy(*keys).orderBy(CELL).rowsBetween(FIRST, -1)


def join_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach each cell's carry; every cell has one row in ``carry``."""
    return rows.join(carry, [*keys, CELL], "left")


@dataclass(frozen=True)
class Running:
    """One running column: ``kind`` is sum, max, min, last or prev.

    sum, max, min and last include the row itself; prev looks only at rows before it.
    last and prev skip nulls.
    """

    name: str
    kind: str
    col: Column


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cell: Column, specs: Sequence[Running]
) -> DataFrame:
    """Running columns over ``keys`` in ``order``; ``cell`` must grow with the order."""
    base = df.withColumn(CELL, cell).withColumns({f"_v_{s.name}": s.col for s in specs})
    upto = cell_window(keys, order).rowsBetween(FIRST, HERE)
    before = cell_window(keys, order).rowsBetween(FIRST, -1)
    position = order_value(order)
    local, summary, carried, final = {}, [], [], {}
    for s in specs:
        v, l, c = F.col(f"_v_{s.name}"), f"_l_{s.name}", f"_c_{s.name}"
        if s.kind in ("sum", "max", "min"):
            fn = getattr(F, s.kind)
            local[l] = fn(v).over(upto)
            summary.append(fn(v).alias(c))
            carried.append(fn(c).over(carry_window(keys)).alias(c))
        elif s.kind in ("last", "prev"):
            local[l] = F.last(v, ignorenulls=True).over(upto if s.kind == "last" else before)
            summary.append(F.max_by(v, F.when(v.isNotNull(), position)).alias(c))
            carried.append(F.last(c, ignorenulls=True).over(carry_window(keys)).alias(c))
        else:
            raise ValueError(f"unknown kind {s.kind!r}")
        a, b = F.col(l), F.col(c)
        final[s.name] = {
            "sum": F.coalesce(a + b, a, b), "max": F.greatest(a, b), "min": F.least(a, b),
            "last": F.coalesce(a, b), "prev": F.coalesce(a, b),
        }[s.kind]
    carry = base.groupBy(*keys, CELL).agg(*summary).select(*keys, CELL, *carried)
    out = join_carry(base.withColumns(local), carry, keys).withColumns(final)
    return out.drop(CELL, *(f"_{p}_{s.name}" for s in specs for p in "vlc"))


def change_count(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cell: Column,
    value: Column,
    changed,
    name: str,
) -> DataFrame:
    """Running number of rows where ``changed(previous, current)`` holds.

    ``value`` may be null; such rows neither count nor become the previous value. The
    first value of a group has no previous one and never counts.
    """
    base = df.withColumns({CELL: cell, "_v": value})
    v = F.col("_v")
    upto = cell_window(keys, order).rowsBetween(FIRST, HERE)
    before = cell_window(keys, order).rowsBetween(FIRST, -1)
    prev = F.last(v, ignorenulls=True).over(before)
    marked = base.withColumn(
        "_chg", F.coalesce((v.isNotNull() & changed(prev, v)).cast("bigint"), F.lit(0))
    )
    seen = F.when(v.isNotNull(), order_value(order))
    cells = marked.groupBy(*keys, CELL).agg(
        F.sum("_chg").alias("_n"), F.min_by(v, seen).alias("_first"), F.max_by(v, seen).alias("_last")
    )
    cells = cells.withColumn("_in", F.last("_last", ignorenulls=True).over(carry_window(keys)))
    edge = F.coalesce(changed(F.col("_in"), F.col("_first")).cast("bigint"), F.lit(0))
    cells = cells.withColumn("_edge", edge)
    carry = cells.select(
        *keys, CELL, "_edge",
        F.coalesce(F.sum(F.col("_n") + F.col("_edge")).over(carry_window(keys)), F.lit(0)).alias("_base"),
    )
    local = marked.withColumns({
        "_run": F.sum("_chg").over(upto), "_has": F.count("_v").over(upto) > 0,
    })
    out = join_carry(local, carry, keys).withColumn(
        name,
        F.col("_run") + F.coalesce("_base", F.lit(0))
        + F.when(F.col("_has"), F.coalesce("_edge", F.lit(0))).otherwise(0),
    )
    return out.drop(CELL, "_v", "_chg", "_run", "_has", "_edge", "_base")


def rolling_mean(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cell: Column,
    col: str,
    size: int,
    least: int,
    name: str,
    block: int = 100_000,
) -> DataFrame:
    """Mean over the last ``size`` rows, null below ``least`` rows.

    Rows are numbered across cells, cut into blocks of ``block`` rows, and the last
    ``size - 1`` rows of a block are lent to the next one.
    """
    numbered = running(df, keys, order, cell, [Running("_rn", "sum", F.lit(1))])
    at = F.col("_rn") - 1
    own = F.floor(at / block).cast("bigint")
    lent = at % block >= block - (size - 1)
    spread = numbered.withColumn("_own", own).withColumn(
        "_block", F.explode(F.when(lent, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own")))
    )
    frame = Window.partitionBy(*keys, "_block").orderBy("_rn").rowsBetween(-(size - 1), HERE)
    rolled = spread.withColumn(
        name, F.when(F.count(col).over(frame) >= least, F.sum(col).over(frame) / F.count(col).over(frame))
    )
    return rolled.where(F.col("_block") == F.col("_own")).drop("_rn", "_own", "_block")
