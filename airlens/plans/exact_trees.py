"""Decision trees with exact thresholds, many grown at once (M3-M5).

Every midpoint between two neighbouring values of a node is a candidate threshold. A level of
all trees is one set of jobs: rows are folded to class counts per (tree, node, feature, value),
running sums over the values of a feature give the classes on either side of each threshold,
and the best threshold of each node by weighted Gini impurity comes back to the driver, a row
a node. Values are cut into slices at approximate quantiles of the whole table and the
slices' sums carried forward, so no task orders all values of a feature. Counts are whole
numbers and classes have one weight each, so any engine finds the same trees: of equal
candidates the first feature and the smallest value win.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlens import schema as S
from airlens.operators.stage import stage

ROWS_PER_SLICE = 1 << 16
MOST_SLICES = 4096
UNIT = 1 << 30  # of a slope or bend; sums of whole numbers are the same in any order


@dataclass
class TreeSpec:
    """What one tree is fitted on.

    ``times`` says how often a row counts, 0 not at all; ``weights`` of the classes are those
    that balance the rows it counts, unless given. ``choice`` may name the features of a node.
    With ``slope`` and ``bend``, whole numbers of 1 / UNIT, a tree follows these two sums of a
    loss instead of the classes: a side is worth slope^2 / (bend + ridge), must have a bend of
    ``least_bend``, and a split must gain more than ``least_gain``.
    """

    name: str
    features: Sequence[str] = S.WINDOW_FEATURES
    depth: int = 4
    leaf: int = 1
    label: str = "label"
    times: Column | None = None
    weights: tuple[float, float] | None = None
    choice: Callable[[int], Sequence[str]] | None = None
    slope: Column | None = None
    bend: Column | None = None
    ridge: float = 0.0
    least_bend: float = 0.0
    least_gain: float = 0.0


@dataclass
class Split:
    feature: str
    threshold: float
    left: tuple[int, int]  # rows of class 0 and 1, or slope and bend
    right: tuple[int, int]
    gain: float = 0.0


@dataclass
class Tree:
    """Splits by node (children of i are 2i and 2i + 1) and the classes of the root."""

    features: tuple[str, ...]
    weights: tuple[float, float]
    root: tuple[int, int]
    splits: dict[int, Split] = field(default_factory=dict)

    def counts(self, node: int) -> tuple[int, int]:
        if node == 1:
            return self.root
        parent = self.splits[node // 2]
        return parent.right if node % 2 else parent.left

    def shares(self, node: int) -> tuple[float, float]:
        a, b = (w * n for w, n in zip(self.weights, self.counts(node), strict=True))
        return (a / (a + b), b / (a + b)) if a + b else (1.0, 0.0)

    def nested(self, depth: int | None = None, node: int = 1) -> tuple:
        """The tree as nested nodes, cut off below ``depth`` levels; growing level by level, that is the tree of that depth."""
        split = self.splits.get(node)
        if split is None or depth == 0:
            return self.shares(node)
        below = None if depth is None else depth - 1
        return (split.feature, split.threshold, self.nested(below, 2 * node), self.nested(below, 2 * node + 1))

    def importances(self) -> list[tuple[str, float]]:
        """What each feature's splits take from the weighted impurity, as shares, the largest first."""
        found = dict.fromkeys(self.features, 0.0)
        for node in sorted(self.splits):
            split = self.splits[node]
            found[split.feature] += self._impurity(self.counts(node)) - self._impurity(split.left) - self._impurity(split.right)
        total = sum(found.values())
        return sorted(((f, v / total if total else 0.0) for f, v in found.items()), key=lambda x: -x[1])

    def _impurity(self, counts: tuple[int, int]) -> float:
        """Weight of the rows times their Gini impurity."""
        a, b = (w * n for w, n in zip(self.weights, counts, strict=True))
        return (a + b) - (a * a + b * b) / (a + b) if a + b else 0.0


def grow(rows: DataFrame, specs: Sequence[TreeSpec], cuts: list[list[float]] | None = None) -> dict[str, Tree]:
    """The trees of all ``specs`` on ``rows``, which are read once a level and should be staged.

    A node without both classes, or without a threshold that leaves ``leaf`` rows on either
    side, stays a leaf. Rows without a label of 0 or 1 don't count. Features must not be null.
    ``cuts`` are those of ``slices_of``, for callers that grow many trees on the same rows.
    """
    names = feature_order(f for s in specs for f in s.features)
    where = {f: k for k, f in enumerate(names)}
    times = [F.lit(1).cast("long") if s.times is None else s.times.cast("long") for s in specs]
    of = lambda s, n, y: F.when(F.col(s.label) == y, n).otherwise(0)
    a = F.array(*[of(s, n, 0) if s.slope is None else s.slope.cast("long") for s, n in zip(specs, times, strict=True)])
    b = F.array(*[of(s, n, 1) if s.bend is None else s.bend.cast("long") for s, n in zip(specs, times, strict=True)])
    values = F.array(*[F.col(f).cast("double") for f in names])
    base = rows.select(values.alias("vals"), F.array(*times).alias("times"), a.alias("a"), b.alias("b"))
    trees = _roots(base, specs)
    cuts = slices_of(rows, names) if cuts is None else cuts
    state = base.withColumn("nodes", F.array_repeat(F.lit(1), len(specs)))
    for level in range(max(s.depth for s in specs)):
        width = 2 << level
        chosen = _chosen(specs, trees, where, level)
        if not chosen:
            break
        found = _best(_counted(state, chosen, len(specs), width), cuts, specs, trees)
        if not found:
            break
        feature, threshold = [0] * (len(specs) * width), [0.0] * (len(specs) * width)
        for r in found:
            tree = trees[specs[r.tree].name]
            tree.splits[r.node] = Split(names[r.f], r.threshold, (r.l0, r.l1), (r.t0 - r.l0, r.t1 - r.l1), r.gain)
            feature[r.tree * width + r.node], threshold[r.tree * width + r.node] = r.f + 1, r.threshold
        state = state.withColumn("nodes", _moved(F.lit(feature), F.lit(threshold), width))
    return trees


def _roots(base: DataFrame, specs: Sequence[TreeSpec]) -> dict[str, Tree]:
    sums = base.agg(*[F.sum(F.col(c)[k]).alias(f"{c}{k}") for k in range(len(specs)) for c in ("a", "b")]).first()
    out = {}
    for k, s in enumerate(specs):
        n = tuple(int(sums[f"{c}{k}"] or 0) for c in ("a", "b"))
        balanced = tuple(sum(n) / (2.0 * c) if c else 0.0 for c in n)
        out[s.name] = Tree(tuple(s.features), s.weights or balanced, n)
    return out


def feature_order(names: Iterable[str]) -> list[str]:
    """Each name once, in the order of the window's features, which decides between equal splits."""
    order = {f: k for k, f in enumerate(S.WINDOW_FEATURES)}
    return sorted(dict.fromkeys(names), key=lambda f: order.get(f, len(order)))


def slices_of(rows: DataFrame, names: Sequence[str]) -> list[list[float]]:
    """Values of each feature between slices of about ROWS_PER_SLICE rows; they bound tasks and change no result."""
    slices = min(MOST_SLICES, math.ceil(rows.count() / ROWS_PER_SLICE))
    if slices < 2:
        return [[] for _ in names]
    shares = [i / slices for i in range(1, slices)]
    row = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 10 * slices).alias(f"q{k}") for k, f in enumerate(names)]).first()
    return [sorted(set(row[f"q{k}"] or [])) for k in range(len(names))]


def _chosen(specs: Sequence[TreeSpec], trees: dict[str, Tree], where: dict[str, int], level: int) -> dict[tuple[int, int], list[int]]:
    """Features by (tree, node) of the nodes of this level that may be split."""
    out = {}
    for k, s in enumerate(specs):
        tree = trees[s.name]
        nodes = [1] if level == 0 else [c for n in tree.splits if n >> (level - 1) == 1 for c in (2 * n, 2 * n + 1)]
        for node in nodes if level < s.depth else []:
            if s.slope is not None or min(tree.counts(node)) > 0:
                out[k, node] = [where[f] + 1 for f in (s.choice(node) if s.choice else s.features)]
    return out


def _counted(state: DataFrame, chosen: dict[tuple[int, int], list[int]], trees: int, width: int) -> DataFrame:
    """(tree, node, f, v, n0, n1, n) of the open nodes: both sums and the rows of each value."""
    lists = [[] for _ in range(trees * width)]
    for (tree, node), features in chosen.items():
        lists[tree * width + node] = features
    table = F.array(*[F.lit(x).cast("array<int>") if x else F.array().cast("array<int>") for x in lists])
    each = F.transform("nodes", lambda node, tree: F.struct(
        tree.alias("tree"), node.alias("node"), F.col("times")[tree].alias("n"), F.col("a")[tree].alias("a"), F.col("b")[tree].alias("b"), table[tree * width + node].alias("fs")
    ))
    open_ = F.filter(each, lambda e: (e["n"] > 0) & (F.size(e["fs"]) > 0))
    long = state.select("vals", F.explode(open_).alias("e")).select("vals", "e.*").select("tree", "node", "n", "a", "b", "vals", F.explode("fs").alias("f"))
    long = long.select("tree", "node", (F.col("f") - 1).alias("f"), F.element_at("vals", F.col("f")).alias("v"), "n", "a", "b")
    return long.groupBy("tree", "node", "f", "v").agg(F.sum("a").alias("n0"), F.sum("b").alias("n1"), F.sum("n").alias("n"))


_SUMS = {"n0": "0", "n1": "1", "n": "n"}


def _running(counts: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """Each value of a (tree, node, f) with the next one, the sums up to it (l) and over all values (t)."""
    key = ["tree", "node", "f"]
    every = Window.partitionBy(*key)
    if not any(cuts):  # one slice: the values of a feature fit one task
        upto = every.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        return counts.select(
            *key, "v", F.lead("v").over(every.orderBy("v")).alias("next"), *[F.sum(c).over(upto).alias(f"l{k}") for c, k in _SUMS.items()],
            *[F.sum(c).over(every).alias(f"t{k}") for c, k in _SUMS.items()],
        )
    counts = stage(counts)
    table = F.array(*[F.lit(c).cast("array<double>") if c else F.array().cast("array<double>") for c in cuts])
    counts = counts.withColumn("slice", F.size(F.filter(table[F.col("f")], lambda c: c < F.col("v"))))
    inside = Window.partitionBy(*key, "slice").orderBy("v")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = counts.select(*key, "slice", "v", *[F.sum(c).over(upto).alias(f"i{k}") for c, k in _SUMS.items()], F.lead("v").over(inside).alias("next"))
    sums = counts.groupBy(*key, "slice").agg(*[F.sum(c).alias(c) for c in _SUMS], F.min("v").alias("first"))
    slices = every.orderBy("slice")
    earlier = slices.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *key, "slice", F.lead("first").over(slices).alias("after"),
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"b{k}") for c, k in _SUMS.items()],
        *[F.sum(c).over(every).alias(f"t{k}") for c, k in _SUMS.items()],
    )
    return local.join(sums, [*key, "slice"]).select(
        *key, "v", F.coalesce("next", "after").alias("next"), *[(F.col(f"i{k}") + F.col(f"b{k}")).alias(f"l{k}") for k in _SUMS.values()], *[f"t{k}" for k in _SUMS.values()]
    )


def _best(counts: DataFrame, cuts: list[list[float]], specs: Sequence[TreeSpec], trees: dict[str, Tree]) -> list:
    """The best split of each (tree, node) that has one."""
    every = _running(counts, cuts)
    by_tree = lambda values: F.lit(list(values))[F.col("tree")]
    weight = [by_tree(trees[s.name].weights[y] for s in specs) for y in (0, 1)]
    leaf, left = by_tree(s.leaf for s in specs), (F.col("l0"), F.col("l1"))
    rest = (F.col("t0") - F.col("l0"), F.col("t1") - F.col("l1"))
    able = F.col("next").isNotNull() & (F.col("ln") >= leaf) & (F.col("tn") - F.col("ln") >= leaf)
    if specs[0].slope is None:
        def side(a: Column, b: Column) -> Column:
            a, b = weight[0] * a.cast("double"), weight[1] * b.cast("double")
            return (a * a + b * b) / (a + b)

        scored = every.where(able).withColumn("score", side(*left) + side(*rest)).withColumn("gain", F.lit(0.0))
    else:
        ridge, unit = by_tree(s.ridge for s in specs), F.lit(float(UNIT))

        def side(a: Column, b: Column) -> Column:
            a, b = a.cast("double") / unit, b.cast("double") / unit
            return a * a / (b + ridge)

        bend = lambda b: b.cast("double") / unit >= by_tree(s.least_bend for s in specs)
        scored = every.where(able & bend(left[1]) & bend(rest[1])).withColumn("score", side(*left) + side(*rest))
        scored = scored.withColumn("gain", F.col("score") - side(F.col("t0"), F.col("t1"))).where(F.col("gain") > by_tree(s.least_gain for s in specs))
    middle = (F.col("v") + F.col("next")) / F.lit(2.0)
    threshold = F.when(middle >= F.col("next"), F.col("v")).otherwise(middle)
    top = F.max(F.struct("score", (-F.col("f")).alias("f"), (-F.col("v")).alias("v"), threshold.alias("threshold"), "l0", "l1", "t0", "t1", "gain")).alias("b")
    best = scored.groupBy("tree", "node").agg(top)  # one row a node
    return best.select("tree", "node", (-F.col("b.f")).alias("f"), "b.threshold", "b.l0", "b.l1", "b.t0", "b.t1", "b.gain").collect()


def _moved(feature: Column, threshold: Column, width: int) -> Column:
    """Each tree's node of a row one level further down, where its node has been split."""
    def step(node: Column, tree: Column) -> Column:
        at = tree * width + node
        f = F.when(node < width, feature[at]).otherwise(0)
        right = (F.element_at("vals", f) > threshold[at]).cast("int")
        return F.when(f > 0, 2 * node + right).otherwise(node)

    return F.transform("nodes", step)


class Forest:
    """Trees whose shares of attack are averaged; rows are scored by looking nodes up, level by level."""

    def __init__(self, trees: Sequence[Tree]):
        self.trees = list(trees)

    def nodes(self, df: DataFrame) -> tuple[DataFrame, int]:
        """``df`` with ``nodes``, the node of each tree a row ends in, and the bound of node numbers."""
        names = sorted({f for t in self.trees for f in t.features}, key=S.WINDOW_FEATURES.index)
        depth = max((n.bit_length() for t in self.trees for n in t.splits), default=0)
        df = df.withColumn("vals", F.array(*[F.col(f).cast("double") for f in names])).withColumn("nodes", F.array_repeat(F.lit(1), len(self.trees)))
        for level in range(depth):
            width = 2 << level
            feature, threshold = [0] * (len(self.trees) * width), [0.0] * (len(self.trees) * width)
            for k, tree in enumerate(self.trees):
                for node, split in tree.splits.items():
                    if node >> level == 1:
                        feature[k * width + node], threshold[k * width + node] = names.index(split.feature) + 1, split.threshold
            df = df.withColumn("nodes", _moved(F.lit(feature), F.lit(threshold), width))
        return df, 2 << depth

    def leaf_steps(self, df: DataFrame, value: Callable[[Tree, int], float]) -> DataFrame:
        """``df`` with ``steps``: the values of a row's leaves in the order of the trees."""
        df, width = self.nodes(df)
        table = [0.0] * (len(self.trees) * width)
        for k, tree in enumerate(self.trees):
            for node in [1, *(c for n in tree.splits for c in (2 * n, 2 * n + 1))]:
                if node not in tree.splits:
                    table[k * width + node] = value(tree, node)
        table = F.lit(table)
        return df.withColumn("steps", F.transform("nodes", lambda node, tree: table[tree * width + node])).drop("vals", "nodes")

    def scored(self, df: DataFrame) -> DataFrame:
        out = self.leaf_steps(df, lambda tree, node: tree.shares(node)[1])
        out = out.withColumn("score", F.aggregate("steps", F.lit(0.0), lambda a, b: a + b) / F.lit(float(len(self.trees)))).drop("steps")
        return out.withColumn("pred", (F.col("score") > 0.5).cast("int"))
