"""The configuration program against all configurations, and what its rounding places."""

import itertools

import numpy as np
import public_tokenizers
import pytest

from airlens.llm import packing


def every_configuration(lengths, capacity):
    out = [()]
    for length in lengths:
        out = [(*c, n) for c in out for n in range(capacity // length + 1) if sum(a * b for a, b in zip(c, lengths, strict=False)) + n * length <= capacity]
    return np.array([c for c in out if any(c)], dtype=float)


def exact_program(lengths, demand, capacity):
    """Least sum of uses over all bases of all configurations; slack columns let demand be covered beyond need."""
    m = len(lengths)
    columns = np.vstack([every_configuration(lengths, capacity), -np.eye(m)])
    cost = np.r_[np.ones(len(columns) - m), np.zeros(m)]
    best = np.inf
    for basis in itertools.combinations(range(len(columns)), m):
        matrix = columns[list(basis)].T
        if abs(np.linalg.det(matrix)) > 1e-9:
            uses = np.linalg.solve(matrix, demand)
            if (uses >= -1e-9).all():
                best = min(best, float(cost[list(basis)] @ uses))
    return best


@pytest.mark.parametrize("lengths,demand,capacity", [
    ([3, 4, 7], [40, 31, 12], 12), ([5, 6, 9], [7, 90, 33], 16), ([2, 5, 11], [300, 20, 45], 13), ([4, 5, 6, 7], [10, 20, 30, 40], 15), ([9], [17], 20),
])
def test_program_against_all_configurations(lengths, demand, capacity):
    lengths, demand = np.array(lengths), np.array(demand)
    want = exact_program(lengths, demand, capacity)
    columns, uses, lower = packing.fractional(lengths, demand, capacity)
    assert lower <= want + 1e-6 and want - 1e-6 <= uses.sum() <= (1 + packing.GAP) * lower + 1e-6
    assert (columns @ uses >= demand - 1e-6).all() and (lengths @ columns <= capacity).all()
    fewer, times = packing.vertex(columns, uses)
    assert fewer.shape[1] <= len(lengths) and times.sum() <= uses.sum() + 1e-6 and (fewer @ times >= demand - 1e-5).all()
    every = every_configuration(lengths.tolist(), capacity)
    prices = np.random.default_rng(1).random(len(lengths))
    found = packing.best_configuration(lengths, prices, capacity)
    assert sum(prices[k] * n for k, n in found.items()) == pytest.approx((every @ prices).max())


def test_groups_cost_the_fewest_tokens():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = np.sort(rng.choice(np.arange(1, 60), 8, replace=False))
        counts = rng.integers(1, 9, 8)

        def waste(cuts, lengths=lengths, counts=counts):
            ends = [0, *cuts, 8]
            return sum(int((lengths[b - 1] * counts[a:b] - lengths[a:b] * counts[a:b]).sum()) for a, b in zip(ends, ends[1:], strict=False))

        got = packing.grouped(lengths, counts, 3)
        assert waste([a for a, _ in got][1:]) == min(waste(c) for k in range(3) for c in itertools.combinations(range(1, 8), k))


def check(histogram, capacity, most, share=None):
    lengths = np.array(sorted(histogram))
    rest = np.array([histogram[k] for k in sorted(histogram)])
    total, before = int(lengths @ rest), rest.copy()
    opened = packing.programmed(lengths, rest, capacity)
    if share is not None:
        assert 1 - rest.sum() / before.sum() >= share
    assert len(opened) <= 40 * len(lengths)
    found, held = packing.configurations(histogram, capacity), {}
    for content, times in found:
        assert 0 < sum(k * n for k, n in content) <= capacity and times > 0
        for k, n in content:
            held[k] = held.get(k, 0) + n * times
    assert held == histogram and sum(t for _, t in found) <= most * -(-total // capacity) + 1


def test_given_table_is_packed_by_configurations(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    pieces = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    check(histogram, packing.CAPACITY, 1.01, 0.9)
    check({k: 100_000 * n for k, n in histogram.items()}, packing.CAPACITY, 1.01, 0.9)


def test_odd_histograms():
    rng = np.random.default_rng(3)
    check({1: 5}, 2048, 1)
    check({2048: 1000}, 2048, 1, 0.9)
    check({1025: 500, 1: 3}, 2048, 2)
    for n in (3, 40, 900):
        lengths = np.clip(rng.lognormal(4, 1, n).astype(int), 1, 300)
        check(dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True)), 300, 1.03)
