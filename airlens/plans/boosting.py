"""Second-order boosting of exact trees (M5): one booster that grows by levels, one that grows best leaves first.

Every round folds the slopes and bends of the logistic loss, as whole numbers of 1 / UNIT, so
their sums do not depend on the order of rows and any engine grows the same trees. A leaf
moves the margin by a Newton step, -slope / (bend + ridge), times the rate.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens import schema as S
from airlens.operators.stage import stage
from airlens.plans.exact_trees import UNIT, Forest, Split, Tree, TreeSpec, feature_order, grow, slices_of
from airlens.plans.split import class_weights

STAGED_EVERY = 10  # rounds after which margins are written


@dataclass(frozen=True)
class Settings:
    """Fixed values of the two boosters: rounds, depth and rate as set, the rest as those libraries come."""

    rounds: int = 80
    depth: int = 4
    rate: float = 0.1
    ridge: float = 1.0
    least_bend: float = 1.0
    least_rows: int = 1
    least_gain: float = 1e-6
    leaves: int | None = None  # grown best first up to so many
    from_shares: bool = False  # margins start at the log odds of the classes, not at 0


BY_LEVEL = Settings()
BY_LEAF = Settings(ridge=0.0, least_bend=1e-3, least_rows=20, least_gain=0.0, leaves=31, from_shares=True)


def best_first(tree: Tree, leaves: int) -> Tree:
    """The splits that are made when always the open leaf of the greatest gain is split, until there are ``leaves``.

    A node's split depends on its rows alone, so a tree grown by levels holds all candidates.
    """
    kept: dict[int, Split] = {}
    open_ = [(-tree.splits[1].gain, 1)] if 1 in tree.splits else []
    while open_ and len(kept) + 1 < leaves:
        _, node = heapq.heappop(open_)
        kept[node] = tree.splits[node]
        for child in (2 * node, 2 * node + 1):
            if child in tree.splits:
                heapq.heappush(open_, (-tree.splits[child].gain, child))
    return Tree(tree.features, tree.weights, tree.root, kept)


@dataclass
class Boosted:
    start: float
    settings: Settings
    trees: list[Tree] = field(default_factory=list)

    def step(self, tree: Tree, node: int) -> float:
        slope, bend = (n / UNIT for n in tree.counts(node))
        return -slope / (bend + self.settings.ridge) * self.settings.rate if bend + self.settings.ridge else 0.0

    def added(self, df: DataFrame, margin: Column, trees: Sequence[Tree]) -> DataFrame:
        """``df`` with ``margin`` raised by the steps of ``trees``, one after the other."""
        df = df.withColumn("margin", margin)
        if not trees:
            return df
        moved = Forest(trees).leaf_steps(df, self.step)
        return moved.withColumn("margin", F.aggregate("steps", F.col("margin"), lambda a, b: a + b)).drop("steps")

    def scored(self, df: DataFrame) -> DataFrame:
        out = self.added(df, F.lit(self.start), self.trees)
        out = out.withColumn("score", _chance(F.col("margin"))).drop("margin")
        return out.withColumn("pred", (F.col("score") > 0.5).cast("int"))


def _chance(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def fit(train: DataFrame, settings: Settings = BY_LEVEL, features: Sequence[str] = S.WINDOW_FEATURES, label: str = "label") -> Boosted:
    """A boosted model on unweighted rows of ``train``, which is read once a level and should be staged."""
    sizes = class_weights(train, label)
    counts = {c: 1.0 / w for c, w in sizes.items()}  # in proportion to the classes
    start = math.log(counts[1] / counts[0]) if settings.from_shares and len(counts) == 2 else 0.0
    model = Boosted(start, settings)
    chance = _chance(F.col("margin"))
    whole = lambda c: F.round(c * F.lit(float(UNIT))).cast("long")
    spec = TreeSpec(
        "round", features, settings.depth, settings.least_rows, label, slope=whole(chance - F.col(label)), bend=whole(chance * (F.lit(1.0) - chance)),
        ridge=settings.ridge, least_bend=settings.least_bend, least_gain=settings.least_gain,
    )
    cuts = slices_of(train, feature_order(features))
    held, new = train.withColumn("margin", F.lit(start)), 0
    for k in range(settings.rounds):
        tree = grow(model.added(held, F.col("margin"), model.trees[len(model.trees) - new:]), [spec], cuts)["round"]
        model.trees.append(best_first(tree, settings.leaves) if settings.leaves else tree)
        new += 1
        if new == STAGED_EVERY and k + 1 < settings.rounds:
            held, new = stage(model.added(held, F.col("margin"), model.trees[-new:])), 0
    return model


def losses(model: Boosted, rows: DataFrame, label: str = "label") -> list[float]:
    """Mean logistic loss over ``rows`` before the first round and after each."""
    steps = Forest(model.trees).leaf_steps(rows, model.step) if model.trees else rows.withColumn("steps", F.array().cast("array<double>"))
    margins = F.transform(F.sequence(F.lit(0), F.lit(len(model.trees))), lambda k: F.aggregate(F.slice("steps", F.lit(1), k), F.lit(model.start), lambda a, b: a + b))
    y = F.col(label).cast("double")
    each = steps.select(F.posexplode(F.transform(margins, lambda m: F.log1p(F.exp(-F.abs(m))) + F.greatest(m, F.lit(0.0)) - m * y)).alias("k", "loss"))
    return [r.loss for r in each.groupBy("k").agg(F.avg("loss").alias("loss")).orderBy("k").collect()]
