"""Exact trees and boosters against plain versions over all rows at once."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlens import schema as S
from airlens.functions.trees import tree_prob
from airlens.plans import boosting, exact_trees, training
from airlens.plans.exact_trees import Forest, TreeSpec, grow

NAMES = S.WINDOW_FEATURES[:3]


def table(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    x[:, 1] = rng.integers(0, 4, n)
    y = ((x[:, 0] + 0.3 * x[:, 1] + rng.normal(scale=0.7, size=n)) > 0.5).astype(int)
    rows = [(k % 5, k, *map(float, x[k]), int(y[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "capture_id long, window_us long, " + ", ".join(f"{f} double" for f in NAMES) + ", label int")
    return df, x, y


def plain_split(x, a, b, worth, able, leaf):
    """(score, feature, threshold, left rows) of the best split, the first feature and smallest value among equals."""
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for v, w in zip(values, values[1:], strict=False):
            left = x[:, f] <= v
            if min(left.sum(), (~left).sum()) < leaf or not able(a[left].sum(), b[left].sum()) or not able(a[~left].sum(), b[~left].sum()):
                continue
            score = worth(a[left].sum(), b[left].sum()) + worth(a[~left].sum(), b[~left].sum())
            if best is None or score > best[0]:
                best = (score, f, (v + w) / 2, left)
    return best


def plain_tree(x, y, weights, depth, leaf):
    a, b = (y == 0).astype(float), (y == 1).astype(float)
    p, q = weights[0] * a.sum(), weights[1] * b.sum()
    found = None
    if depth and a.sum() and b.sum():
        def worth(m, n):
            m, n = weights[0] * m, weights[1] * n
            return (m * m + n * n) / (m + n)

        found = plain_split(x, a, b, worth, lambda *_: True, leaf)
    if found is None:
        return (p / (p + q), q / (p + q))
    _, f, threshold, left = found
    return (NAMES[f], threshold, plain_tree(x[left], y[left], weights, depth - 1, leaf), plain_tree(x[~left], y[~left], weights, depth - 1, leaf))


@pytest.mark.parametrize("rows_per_slice", [1 << 16, 20])
def test_trees_equal_plain_ones(spark, monkeypatch, rows_per_slice):
    monkeypatch.setattr(exact_trees, "ROWS_PER_SLICE", rows_per_slice)
    df, x, y = table(spark, 400, 1)
    weights = tuple(len(y) / (2.0 * (y == c).sum()) for c in (0, 1))
    odd = F.col("window_us") % 2
    specs = [TreeSpec("a", NAMES, 4), TreeSpec("b", NAMES, 3, leaf=25), TreeSpec("c", NAMES[1:], 2), TreeSpec("d", NAMES, 3, times=odd)]
    got = grow(df, specs)
    assert got["a"].nested() == plain_tree(x, y, weights, 4, 1) and got["a"].nested(2) == plain_tree(x, y, weights, 2, 1)
    assert got["b"].nested() == plain_tree(x, y, weights, 3, 25)
    half = np.arange(400) % 2 == 1
    of_half = tuple(half.sum() / (2.0 * (y[half] == c).sum()) for c in (0, 1))
    assert got["d"].nested() == plain_tree(x[half], y[half], of_half, 3, 1)
    assert {f for f, v in got["c"].importances() if v > 0} <= set(NAMES[1:]) and sum(v for _, v in got["a"].importances()) == pytest.approx(1)


def test_forest_looks_up_what_its_trees_say(spark):
    df, _, _ = table(spark, 200, 2)
    forest = training.exact_forest(df, trees=4, depth=3, features=NAMES)
    scored = forest.scored(df)
    for tree in forest.trees:
        scored = scored.withColumn("sum", F.coalesce(F.col("sum"), F.lit(0.0)) + tree_prob(tree.nested()) if "sum" in scored.columns else tree_prob(tree.nested()))
    assert scored.where(F.abs(F.col("score") - F.col("sum") / 4) > 1e-12).count() == 0
    drawn = df.select(*[training.draws(t).alias(f"t{t}") for t in range(2)]).toPandas()
    assert 0.7 < drawn["t0"].mean() < 1.3 and drawn["t0"].max() >= 3 and (drawn["t0"] != drawn["t1"]).any()


def plain_boosted(x, y, settings):
    """Margins after every round, trees grown by levels."""
    start = math.log((y == 1).sum() / (y == 0).sum()) if settings.from_shares else 0.0
    m, out = np.full(len(y), start), []

    def walk(rows, g, h, depth):
        def worth(a, b):
            return a * a / (b + settings.ridge)

        found = None
        if depth:
            found = plain_split(x[rows], g[rows], h[rows], worth, lambda a, b: b >= settings.least_bend, settings.least_rows)
        if found is None or found[0] - worth(g[rows].sum(), h[rows].sum()) <= settings.least_gain:
            return [(rows, -g[rows].sum() / (h[rows].sum() + settings.ridge) * settings.rate)]
        return walk(rows[found[3]], g, h, depth - 1) + walk(rows[~found[3]], g, h, depth - 1)

    for _ in range(settings.rounds):
        p = 1 / (1 + np.exp(-m))
        for rows, step in walk(np.arange(len(y)), p - y, p * (1 - p), settings.depth):
            m[rows] += step
        out.append(m.copy())
    return out


@pytest.mark.parametrize("settings", [replace(boosting.BY_LEVEL, rounds=4, depth=3), replace(boosting.BY_LEAF, rounds=4, depth=3)])
def test_boosters_equal_plain_ones_and_lower_the_loss(spark, monkeypatch, settings):
    monkeypatch.setattr(boosting, "STAGED_EVERY", 2)
    df, x, y = table(spark, 300, 3)
    model = boosting.fit(df, settings, NAMES)
    margins = model.added(df, F.lit(model.start), model.trees).orderBy("window_us").toPandas()["margin"].to_numpy()
    np.testing.assert_allclose(margins, plain_boosted(x, y, settings)[-1], atol=1e-6)
    losses = boosting.losses(model, df)
    assert len(losses) == 5 and all(b < a for a, b in zip(losses, losses[1:], strict=False))
    chance = 1 / (1 + np.exp(-margins))
    assert losses[-1] == pytest.approx(-np.mean(y * np.log(chance) + (1 - y) * np.log(1 - chance)))


def test_best_leaves_first(spark):
    df, _, _ = table(spark, 300, 4)
    whole = boosting.fit(df, replace(boosting.BY_LEAF, rounds=1, depth=4, leaves=None, least_rows=5), NAMES).trees[0]
    for leaves in (1, 2, 4, 7, 100):
        kept = boosting.best_first(whole, leaves).splits
        assert len(kept) == min(leaves - 1, len(whole.splits)) and all(n == 1 or n // 2 in kept for n in kept)
        open_ = [whole.splits[c].gain for n in kept or [0] for c in ((2 * n, 2 * n + 1) if kept else (1,)) if c in whole.splits and c not in kept]
        last = min((whole.splits[n].gain for n in kept if not {2 * n, 2 * n + 1} & kept.keys()), default=math.inf)
        assert leaves > 4 or not open_ or leaves == 1 or last >= max(open_) or len(kept) < leaves
