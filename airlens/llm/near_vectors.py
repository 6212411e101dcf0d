"""Near-duplicate vectors by an epsilon grid order join.

Vectors of unit length at most eps apart have a cosine of at least 1 - eps**2 / 2. All are
turned into the axes of their principal components, which leaves distances as they are, and
sorted by the cells of a grid of width eps on the leading axes. The sorted sequence is cut
into blocks. Pairs of intervals of the sequence are divided recursively, on Spark down to
blocks and inside a task down to a few vectors, and every pair whose bounding boxes are more
than eps apart is skipped. What remains is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlens.llm.components import connected_components
from airlens.llm.vectors import dimensions, matrix, second_moments, usable
from airlens.operators.stage import stage

COSINE = 0.95
GRID = 4  # leading axes that order the sequence
BLOCK = 4096  # vectors of a block
LEAF = 64  # vectors of an interval that is not divided further
FAN = 16  # intervals of one level that make one of the next
SLACK = 1e-9  # for rounding in distances; the exact test decides


def _epsilon(cosine: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK


def _ordered_blocks(classes: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """Blocks (part, seq, low, high, n, ids, sizes, vectors) of the sequence in grid order."""
    dimension = len(axes)
    grid = min(GRID, dimension)
    turn = classes.sparkSession.sparkContext.broadcast(axes)  # dimension squared numbers

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = matrix(frame["v"], dimension)
            x = x / np.linalg.norm(x, axis=1, keepdims=True) @ turn.value[:, :grid]
            yield frame.assign(**{f"c{k}": np.floor(x[:, k] / eps).astype(np.int64) for k in range(grid)}, along=x[:, 0])

    kind = classes.schema["v"].dataType.simpleString()
    names = [f"c{k}" for k in range(grid)]
    placed = stage(classes.mapInPandas(cells, f"cid long, n long, v {kind}, " + ", ".join(f"{c} long" for c in names) + ", along double"))
    order = [*names, "along"]
    raw = "<f4" if kind == "array<float>" else "<f8"

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, held = TaskContext.get().partitionId(), 0, None
        for frame in frames:
            held = frame if held is None or held.empty else pd.concat([held, frame], ignore_index=True)
            while len(held) >= BLOCK:
                yield block(part, seq, held.iloc[:BLOCK])
                held, seq = held.iloc[BLOCK:], seq + 1
        if held is not None and len(held):
            yield block(part, seq, held)

    def block(part: int, seq: int, rows: pd.DataFrame) -> pd.DataFrame:
        x = matrix(rows["v"], dimension)
        turned = x / np.linalg.norm(x, axis=1, keepdims=True) @ turn.value
        row = (part, seq, turned.min(0).tolist(), turned.max(0).tolist(), len(x), rows["cid"].to_numpy("<i8").tobytes(), rows["n"].to_numpy("<i8").tobytes(), x.astype(raw).tobytes())
        return pd.DataFrame([row], columns=["part", "seq", "low", "high", "n", "ids", "sizes", "vectors"])

    sequence = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("cid", "n", "v")
    schema = "part int, seq int, low array<double>, high array<double>, n int, ids binary, sizes binary, vectors binary"
    blocks = stage(sequence.mapInPandas(cut, schema))
    # Parts are shuffle partitions, so one number for each may go through one task.
    parts = blocks.groupBy("part").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = parts.select("part", before.alias("first"))
    return stage(blocks.join(F.broadcast(first), "part").withColumn("block", F.col("first") + F.col("seq")).drop("part", "seq", "first"))


def _apart(a: str, b: str):
    """Squared distance of two boxes."""
    gap = F.zip_with(
        F.zip_with(f"{a}.low", f"{b}.high", lambda x, y: x - y), F.zip_with(f"{b}.low", f"{a}.high", lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)),
    )
    return F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)


def _close_blocks(blocks: DataFrame, eps: float) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks whose boxes are at most eps apart: intervals divided level by level."""
    level = blocks.select(F.col("block").alias("node"), "low", "high")
    top = blocks.agg(F.max("block")).first()[0]
    levels = [stage(level)]
    while top:
        top //= FAN
        dims = range(len(blocks.select("low").first()[0])) if len(levels) == 1 else dims
        up = levels[-1].groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(
            F.array(*[F.min(F.col("low")[k]) for k in dims]).alias("low"), F.array(*[F.max(F.col("high")[k]) for k in dims]).alias("high")
        )
        levels.append(stage(up))
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(levels[:-1]):
        a = level.select(F.floor(F.col("node") / FAN).alias("up_a"), F.struct("node", "low", "high").alias("x"))
        b = level.select(F.floor(F.col("node") / FAN).alias("up_b"), F.struct("node", "low", "high").alias("y"))
        near = (F.col("x.node") <= F.col("y.node")) & (_apart("x", "y") <= eps * eps)
        joined = pairs.join(a, F.col("a") == F.col("up_a")).join(b, (F.col("b") == F.col("up_b")) & near)
        pairs = stage(joined.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    return pairs


class _Interval:
    """The vectors of a block with the boxes of its halves, quarters and so on."""

    def __init__(self, ids: bytes, sizes: bytes, vectors: bytes, raw: str, axes: np.ndarray):
        self.ids, self.sizes = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i8")
        x = np.frombuffer(vectors, raw).reshape(len(self.ids), -1).astype(np.float64)
        self.unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        turned = self.unit @ axes
        self.leaves = -(-len(x) // LEAF)
        starts = np.arange(0, len(x), LEAF)
        low, high = np.minimum.reduceat(turned, starts), np.maximum.reduceat(turned, starts)
        self.boxes = [(low, high)]
        while len(low) > 1:
            pairs = np.arange(0, len(low), 2)
            low, high = np.minimum.reduceat(low, pairs), np.maximum.reduceat(high, pairs)
            self.boxes.append((low, high))

    def leaf(self, k: int) -> slice:
        return slice(k * LEAF, min((k + 1) * LEAF, len(self.ids)))


def _leaf_pairs(a: _Interval, b: _Interval, same: bool, eps: float) -> Iterator[tuple[int, int]]:
    """Pairs of leaves whose boxes are at most eps apart: all pairs of one level at once, from the top."""
    height = max(len(a.boxes), len(b.boxes)) - 1
    ia, ib = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    for level in range(height, -1, -1):
        la, lb = min(level, len(a.boxes) - 1), min(level, len(b.boxes) - 1)
        if level < height:
            def halves(i: np.ndarray, held: _Interval, at: int) -> tuple[np.ndarray, np.ndarray]:
                if len(held.boxes) - 1 <= level:  # this side is not divided at this level
                    return i, np.full_like(i, -1)
                second = 2 * i + 1
                return 2 * i, np.where(second < len(held.boxes[at][0]), second, -1)

            a0, a1 = halves(ia, a, la)
            b0, b1 = halves(ib, b, lb)
            ia, ib = np.concatenate([a0, a0, a1, a1]), np.concatenate([b0, b1, b0, b1])
            there = (ia >= 0) & (ib >= 0)
            ia, ib = ia[there], ib[there]
        if same:
            ia, ib = ia[ia <= ib], ib[ia <= ib]
        gap = np.maximum(np.maximum(a.boxes[la][0][ia] - b.boxes[lb][1][ib], b.boxes[lb][0][ib] - a.boxes[la][1][ia]), 0)
        near = np.einsum("ij,ij->i", gap, gap) <= eps * eps
        ia, ib = ia[near], ib[near]
    yield from zip(ia.tolist(), ib.tolist(), strict=True)


def _joined(a: _Interval, b: _Interval, same: bool, cosine: float, eps: float) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Rows linked to each vector of a and of b, and a forest (place -> place) with the components of the links.

    Places number a's vectors first, then b's (the same ones where both are one block).
    """
    na, shift = len(a.ids), 0 if same else len(a.ids)
    ca, cb = np.zeros(na, dtype=np.int64), np.zeros(len(b.ids), dtype=np.int64)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for i, j in _leaf_pairs(a, b, same, eps):
        sa, sb = a.leaf(i), b.leaf(j)
        hit = a.unit[sa] @ b.unit[sb].T >= cosine
        if same and i == j:
            hit = np.triu(hit, 1)
        if not hit.any():
            continue
        ca[sa] += hit @ b.sizes[sb]
        cb[sb] += a.sizes[sa] @ hit
        left, right = np.arange(hit.shape[0]) + sa.start, np.arange(hit.shape[1]) + sb.start + shift
        mine, other = left.copy(), right.copy()
        while True:  # smallest place in reach, step by step
            new = np.minimum(mine, np.where(hit, other[None, :], np.iinfo(np.int64).max).min(1))
            far = np.minimum(other, np.where(hit, new[:, None], np.iinfo(np.int64).max).min(0))
            if same and i == j:
                new = far = np.minimum(new, far)
            if (new == mine).all() and (far == other).all():
                break
            mine, other = new, far
        for x, y in {*zip(left.tolist(), mine.tolist(), strict=True), *zip(right.tolist(), other.tolist(), strict=True)}:
            if x != y and (p := root(x)) != (q := root(y)):
                parent[max(p, q)] = min(p, q)
    return ca, cb, {x: root(x) for x in list(parent)}


def links(classes: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """For distinct vectors (cid, n, v): (cid, linked) with the rows of other vectors linked to it, and (u, v) with the components.

    Links are counted where they are found and only a forest of them leaves a task, so a
    cluster of m vectors gives rows in proportion to m, not to its pairs.
    """
    dimension = len(classes.select("v").first()[0])
    eps = _epsilon(cosine)
    _, covariance, _ = second_moments(classes, "v", dimension, unit=True)
    axes = np.linalg.eigh(covariance)[1][:, ::-1].copy()
    raw = "<f4" if classes.schema["v"].dataType.simpleString() == "array<float>" else "<f8"
    blocks = _ordered_blocks(classes, axes, eps)
    pairs = _close_blocks(blocks, eps)
    shared = classes.sparkSession.sparkContext.broadcast(axes)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                same = row.a == row.b
                x = _Interval(row.ids_a, row.sizes_a, row.vectors_a, raw, shared.value)
                y = x if same else _Interval(row.ids_b, row.sizes_b, row.vectors_b, raw, shared.value)
                ca, cb, forest = _joined(x, y, same, cosine, eps)
                ids = x.ids if same else np.concatenate([x.ids, y.ids])
                counts = ca + cb if same else np.concatenate([ca, cb])
                some = np.flatnonzero(counts)
                tree = np.array([ids[forest.get(int(k), int(k))] for k in some], dtype=np.int64)
                yield pd.DataFrame({"cid": ids[some], "linked": counts[some], "root": tree})

    def held(side: str) -> DataFrame:
        return blocks.select(F.col("block").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("ids", "sizes", "vectors")])

    # One pair of blocks is the work of many rows, so pairs are dealt out one by one.
    rows = pairs.repartition(F.col("a"), F.col("b")).join(held("a"), "a").join(held("b"), "b")
    found = stage(rows.mapInPandas(compare, "cid long, linked long, root long"))
    return found.groupBy("cid").agg(F.sum("linked").alias("linked")), found.where("cid <> root").select(F.col("cid").alias("u"), F.col("root").alias("v"))


def near_duplicates(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``rows(vec_id, embedding)``.

    Equal vectors are one node with a size, so copies are never paired. Vectors of different
    dimensions have no cosine; each dimension is joined for itself. Vectors that are null, zero
    or hold null or non-finite components link with nothing: n_links 0, component_id their own
    vec_id, kept. Rows without a vec_id link like any other; a component of such rows only has
    a null component_id. An empty table gives an empty one. Other columns are ignored.
    """
    rows = stage(rows.select("vec_id", F.col("embedding").alias("v")))
    out = rows.where(~usable("v")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for dimension in dimensions(rows, "v"):
        out = out.unionByName(_of_one_dimension(rows.where(usable("v") & (F.size("v") == dimension)), cosine))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _of_one_dimension(rows: DataFrame, cosine: float) -> DataFrame:
    grouped = rows.groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    classes = stage(grouped.withColumn("cid", F.monotonically_increasing_id()))  # ids are fixed once written
    counted, forest = links(classes.select("cid", "n", "v"), cosine)
    tree = connected_components(forest)
    nodes = classes.join(tree.withColumnRenamed("node", "cid"), "cid", "left").join(counted, "cid", "left")
    nodes = stage(nodes.select("v", "n", "first", F.coalesce("component", "cid").alias("root"), F.coalesce("linked", F.lit(0)).alias("linked")))
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    full = nodes.join(least, "root").select("v", (F.col("linked") + F.col("n") - 1).alias("n_links"), "component_id")
    return rows.join(full, "v").select("vec_id", "n_links", "component_id")
