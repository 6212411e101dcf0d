"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.operators.stage import stage

# Nodes a task keeps while it contracts its links; it writes out what it has and starts anew beyond.
NODES_PER_TASK = 1 << 20
ROUNDS = 60


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning forest of a task's links, each node under the smallest node of its tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top and up != x:
            parent[x], x = top, up
        return top

    def forest() -> pd.DataFrame:
        pairs = [(x, root(x)) for x in list(parent)]
        return pd.DataFrame([(x, r) for x, r in pairs if x != r], columns=["u", "v"], dtype="int64")

    for frame in frames:
        for u, v in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > NODES_PER_TASK:
            yield forest()
            parent = {}
    yield forest()


def _contracted(links: DataFrame) -> DataFrame:
    return links.mapInPandas(_contract, "u long, v long")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links(u, v)``; the component is its smallest node.

    Alternates large-star and small-star steps over link tables in the shared folder, after
    each task has contracted its own links. A hub is never gathered: its minimum is a
    map-side aggregate, and the join that hands it out is one Spark may split.
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links = stage(_contracted(links))
    before = None
    for _ in range(ROUNDS):
        state = links.agg(
            F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit(0xFFFFFFFF)))
        ).first()
        if state == before or state[0] == 0:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                links.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        before = state
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        links = stage(_contracted(small.distinct()).distinct())
    raise RuntimeError("components did not settle")
