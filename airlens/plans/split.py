"""Repeatable stratified splits, class weights and constant fills."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlens import schema as S
from airlens.operators.quantiles import quantiles

ROW_KEY = ("capture_id", "window_us")
SEED = 42


def row_hash(seed: int = SEED, key: Sequence[str] = ROW_KEY) -> Column:
    """Text hash that orders the rows of a class at random, the same way on every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))


def rank_cutoffs(df: DataFrame, shares: Sequence[float], label: str = "label", seed: int = SEED, key: Sequence[str] = ROW_KEY) -> dict[int, list[str]]:
    """Per class, the hash at each share of its rows in hash order.

    Two small jobs instead of a global ranking: row counts per hash prefix tell which
    prefix holds each cutoff; only the rows of those prefixes are then ranked. The splits are
    plain comparisons with these constants and need no shuffle.
    """
    hashed = df.select(F.col(label).alias("label"), row_hash(seed, key).alias("h")).withColumn("pre", F.substring("h", 1, 3))
    sizes = hashed.groupBy("label", "pre").count().collect()  # at most classes x 4096 rows
    wanted: dict[tuple[int, str], list[tuple[int, int]]] = {}
    cutoffs: dict[int, list[str]] = {}
    for cls in sorted({r["label"] for r in sizes}):
        mine = sorted((r["pre"], r["count"]) for r in sizes if r["label"] == cls)
        total = sum(n for _, n in mine)
        cutoffs[cls] = [""] * len(shares)
        for slot, share in enumerate(shares):
            rank, seen = math.floor(share * total + 0.5), 0
            for pre, n in mine:
                if seen < rank <= seen + n:
                    wanted.setdefault((cls, pre), []).append((slot, rank - seen))
                    break
                seen += n
    if wanted:
        picked = F.lit(False)
        for cls, pre in wanted:
            picked = picked | ((F.col("label") == cls) & (F.col("pre") == pre))
        place = F.row_number().over(Window.partitionBy("label", "pre").orderBy("h"))
        hit = F.lit(False)
        ranked = hashed.where(picked).withColumn("rn", place)
        for (cls, pre), slots in wanted.items():
            for _, rank in slots:
                hit = hit | ((F.col("label") == cls) & (F.col("pre") == pre) & (F.col("rn") == rank))
        for row in ranked.where(hit).collect():  # one row per class and cutoff
            for slot, rank in wanted[(row["label"], row["pre"])]:
                if rank == row["rn"]:
                    cutoffs[row["label"]][slot] = row["h"]
    return cutoffs


def _upto(cutoffs: dict[int, list[str]], slot: int, label: str, seed: int, key: Sequence[str]) -> Column:
    out = F.lit(False)
    for cls, cuts in cutoffs.items():
        out = out | ((F.col(label) == cls) & (row_hash(seed, key) <= F.lit(cuts[slot])))
    return out


def stratified_split(df: DataFrame, test_share: float = 0.3, seed: int = SEED, label: str = "label", key: Sequence[str] = ROW_KEY) -> DataFrame:
    """Add ``is_test``: the given share of each class (M1)."""
    cutoffs = rank_cutoffs(df, [test_share], label, seed, key)
    return df.withColumn("is_test", _upto(cutoffs, 0, label, seed, key))


def stratified_folds(df: DataFrame, n: int = 3, seed: int = SEED, label: str = "label", key: Sequence[str] = ROW_KEY) -> DataFrame:
    """Add ``fold`` 0..n-1, each with the same share of every class."""
    cutoffs = rank_cutoffs(df, [(i + 1) / n for i in range(n - 1)], label, seed, key)
    fold = F.lit(n - 1)
    for slot in reversed(range(n - 1)):
        fold = F.when(_upto(cutoffs, slot, label, seed, key), slot).otherwise(fold)
    return df.withColumn("fold", fold)


def class_weights(df: DataFrame, label: str = "label") -> dict[int, float]:
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    return {cls: sum(sizes.values()) / (2.0 * n) for cls, n in sizes.items()}


def balanced_weights(df: DataFrame, label: str = "label", name: str = "weight", of: DataFrame | None = None) -> DataFrame:
    """Weight ``n / (2 * n_class)`` of each row (M2); sizes may come from ``of``, the training part."""
    weight = F.lit(1.0)
    for cls, value in class_weights(df if of is None else of, label).items():
        weight = F.when(F.col(label) == cls, value).otherwise(weight)
    return df.withColumn(name, weight)


def normal_medians(train: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """Median of each column over normal training rows, 0.0 where there are none."""
    long = train.where("label = 0").select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names
    ])).alias("_x")).select("_x.*")
    found = quantiles(long, ["feature"], "value", {"p50": 0.5}).collect()  # one row per column
    return {n: 0.0 for n in names} | {r["feature"]: r["p50"] for r in found}


def join_fills(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    """Overwrite columns by their constants; they are literals in the plan, nothing is joined."""
    return df.withColumns({n: F.lit(float(v)) for n, v in fills.items()})


def neutralize(df: DataFrame, names: Sequence[str], fills: dict[str, float] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """Hold columns at their normal training median in train and test alike.

    ``df`` must carry ``is_test``.
    """
    fills = normal_medians(df.where(~F.col("is_test")), names) if fills is None else fills
    return join_fills(df, fills), fills


NEUTRAL_SETS = {
    "no-heap": ("heap",), "nids-only": S.HIDS, "nids-counts": (*S.HIDS, *S.RF_SOFT),
}
