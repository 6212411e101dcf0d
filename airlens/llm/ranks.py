"""Gapless ranks and running sums inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlens.operators.stage import stage

ROWS_PER_BIN = 4096


def bins_for(count: int) -> int:
    return max(1, -(-count // ROWS_PER_BIN))


def in_bins(rows: DataFrame, bins: Column | int, *key: str) -> DataFrame:
    """``rows`` with a column ``bin`` that deals them into ``bins`` bins by the hash of ``key``."""
    return rows.withColumn("bin", F.pmod(F.xxhash64(*key), bins if isinstance(bins, Column) else F.lit(bins)))


def ranked(rows: DataFrame, groups: Sequence[str], order: Sequence[str], weight: str | None = None) -> DataFrame:
    """``rows`` (with ``bin``) plus ``rank``, gapless from 0 in each group, and ``before``, the sum of ``weight`` ahead.

    Rows of a group go by bin, then by ``order``. A bin is ordered alone; what lies before a
    bin is summed over one row for each bin, so no task gets a group. ``rows`` is read twice
    and should be staged.
    """
    groups = list(groups)
    value = F.col(weight) if weight else F.lit(0)
    bins = rows.groupBy(*groups, "bin").agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    bins = _cumulated(stage(bins), groups)
    within = Window.partitionBy(*groups, "bin").orderBy(*order)
    local = rows.withColumn("place", F.row_number().over(within)).withColumn(
        "sum", F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, 0)) - value
    )
    both = local.join(bins, [*groups, "bin"])
    return both.withColumn("rank", F.col("n_before") + F.col("place") - 1).withColumn("before", F.col("s_before") + F.col("sum")).drop(
        "place", "sum", "n_before", "s_before"
    )


def _cumulated(bins: DataFrame, groups: list[str]) -> DataFrame:
    """For each bin the count and sum of the group's bins before it, first within spans of bins, then over spans."""
    bins = bins.withColumn("span", F.floor(F.col("bin") / ROWS_PER_BIN))
    spans = bins.groupBy(*groups, "span").agg(F.sum("n").alias("sn"), F.sum("s").alias("ss"))
    over = Window.partitionBy(*groups).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*groups, "span", F.coalesce(F.sum("sn").over(over), F.lit(0)).alias("sn"), F.coalesce(F.sum("ss").over(over), F.lit(0)).alias("ss"))
    inside = Window.partitionBy(*groups, "span").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    local = bins.select(
        *groups, "bin", "span", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("ln"), F.coalesce(F.sum("s").over(inside), F.lit(0)).alias("ls")
    )
    return local.join(spans, [*groups, "span"]).select(*groups, "bin", (F.col("sn") + F.col("ln")).alias("n_before"), (F.col("ss") + F.col("ls")).alias("s_before"))
