"""Exact ranks and quantiles from value counts.

Rows are first folded to one row per distinct value. The distinct values of a group are
cut into slices at approximate quantiles; slices are ranked alone and the slice totals are
carried forward, so no task holds all values of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlens.operators.stage import stage

SLICES = 200


def cumulative_counts(
    counts: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str], slices: int = SLICES
) -> DataFrame:
    """Add ``<col>_upto``, the total over values up to this one, and ``<col>_all`` per group.

    ``counts`` holds one row per (keys, value).
    """
    cuts = counts.groupBy(*keys).agg(
        F.percentile_approx(value, [i / slices for i in range(1, slices)], 10 * slices).alias("_cuts")
    )
    sliced = counts.join(cuts, list(keys), "left").withColumn(
        "_slice", F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    ).drop("_cuts")
    totals = sliced.groupBy(*keys, "_slice").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys, "_slice",
        *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in sums],
        *[F.sum(f"_t_{c}").over(Window.partitionBy(*keys)).alias(f"{c}_all") for c in sums],
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sliced.withColumns({f"{c}_upto": F.sum(c).over(inside) for c in sums}).join(
        totals, [*keys, "_slice"], "left"
    )
    return out.withColumns({f"{c}_upto": F.col(f"{c}_upto") + F.col(f"_b_{c}") for c in sums}).drop(
        "_slice", *(f"_b_{c}" for c in sums)
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("n"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles of ``value`` per ``keys``; one row per group."""
    return quantiles_of_counts(stage(value_counts(df, keys, value)), keys, value, probs)


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """The same from value counts, which are read more than once and should be staged."""
    ranked = cumulative_counts(counts, keys, value, ["n"])
    v = F.col(value)
    picks, out = [], {}
    for name, p in probs.items():
        at = F.lit(p) * (F.col("n_all") - 1)
        picks += [
            F.min(F.when(F.col("n_upto") > F.floor(at), v)).alias(f"_lo_{name}"),
            F.min(F.when(F.col("n_upto") > F.ceil(at), v)).alias(f"_hi_{name}"),
            F.max(at - F.floor(at)).alias(f"_f_{name}"),
        ]
        lo, hi, part = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_f_{name}")
        out[name] = (lo + (hi - lo) * part).cast("double")
    picked = ranked.groupBy(*keys).agg(*picks).withColumns(out)
    return picked.select(*keys, *probs)
