"""Approximate nearest neighbours by learned partitions.

A sample's neighbour graph is cut into balanced parts with few neighbours apart, a small
network learns to tell a vector's part from its components, and so extends the parts to all
vectors: every row is indexed under its most probable part. A query is sent to its most
probable parts and ranked there exactly. How many parts it needs is measured on sample
vectors the network has not seen.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from airlens.llm.vectors import dimensions, matrix, usable
from airlens.operators.stage import stage

NEAREST = 20
SAMPLE = 4000  # vectors the index is fitted on, at most
NEIGHBOURS = 10  # edges of a sample vector
TRIED = 300  # sample vectors on which the number of parts to probe is measured
RECALL = 0.95  # the share of their neighbours the probed parts must hold
MOST_PARTS = 256
HIDDEN = 96
EPOCHS = 30
BLOCK = 4096  # candidates or queries of a block


def parts_for(count: int) -> int:
    """A power of two near an eighth of the square root of the rows, so that parts grow as parts multiply."""
    return int(min(MOST_PARTS, 2 ** max(0, int(np.log2(max(count, 1)) / 2 - 3))))


def _neighbours(x: np.ndarray, k: int) -> np.ndarray:
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 1024):
        s = x[at:at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at:at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _halved(nodes: np.ndarray, edges: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of equal size with few edges between: order by the second eigenvector, then swap pairs that gain."""
    n = len(nodes)
    place = np.full(int(max(edges.max(initial=-1), nodes.max())) + 1, -1)
    place[nodes] = np.arange(n)
    a, b = place[edges[:, 0]], place[edges[:, 1]]
    inside = (a >= 0) & (b >= 0)
    a, b = a[inside], b[inside]
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1e-9
    x = rng.normal(size=n)
    for _ in range(60):
        x = 0.5 * x + 0.5 * (np.bincount(a, x[b], n) + np.bincount(b, x[a], n)) / degree
        x -= (x * degree).sum() / degree.sum()
        x /= np.linalg.norm(x) + 1e-12
    side = np.zeros(n, dtype=bool)
    side[np.argsort(x, kind="stable")[n // 2:]] = True
    for _ in range(8):
        same = np.bincount(a, side[a] == side[b], n) + np.bincount(b, side[a] == side[b], n)
        gain = (degree - 2 * same) + rng.uniform(0, 1e-3, n)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left])], right[np.argsort(-gain[right])]
        m = min(len(left), len(right), max(1, n // 50))
        swap = gain[left[:m]] + gain[right[:m]] > 2
        if not swap.any():
            break
        side[left[:m][swap]], side[right[:m][swap]] = True, False
    return nodes[~side], nodes[side]


def balanced_parts(neighbours: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """Part of each node: the graph halved again and again, so that sizes differ by one a level at most."""
    rng = np.random.default_rng(seed)
    edges = np.stack([np.repeat(np.arange(len(neighbours)), neighbours.shape[1]), neighbours.ravel()], axis=1)
    groups = [np.arange(len(neighbours))]
    while len(groups) < parts:
        groups = [half for g in groups for half in (_halved(g, edges, rng) if len(g) > 1 else (g, g[:0]))]
    out = np.zeros(len(neighbours), dtype=np.int64)
    for k, g in enumerate(groups):
        out[g] = k
    return out


@dataclass
class Router:
    first: np.ndarray
    bias: np.ndarray
    second: np.ndarray
    last: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return len(self.last)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.first + self.bias, 0) @ self.second + self.last

    def part(self, x: np.ndarray) -> np.ndarray:
        return self.odds(x).argmax(axis=1)

    def probed(self, x: np.ndarray, counts: np.ndarray, least: int) -> list[np.ndarray]:
        """Parts of each query in order of odds: ``probes`` of them, and more where those hold fewer than ``least`` ids."""
        order = np.argsort(-self.odds(x), axis=1, kind="stable").astype(np.int32)
        short = (np.cumsum(counts[order], axis=1) < least).sum(axis=1) + 1
        return [row[:max(self.probes, n)] for row, n in zip(order, short.tolist(), strict=True)]


def _learn(x: np.ndarray, target: np.ndarray, seed: int = 5) -> Router:
    """One hidden layer with softmax on soft targets, by Adam on small batches."""
    rng, (n, d), parts = np.random.default_rng(seed), x.shape, target.shape[1]
    scale = max(float(np.sqrt((x**2).mean())), 1e-12)
    values = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            step += 1
            rows = order[at:at + 256]
            z = x[rows] / scale
            h = np.maximum(z @ values[0] + values[1], 0)
            o = h @ values[2] + values[3]
            p = np.exp(o - o.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            gh = (g @ values[2].T) * (h > 0)
            for k, grad in enumerate((z.T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                values[k] = values[k] - 3e-3 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-9)
    return Router(values[0] / scale, *values[1:], 1)


def fit(x: np.ndarray, parts: int, nearest: int = NEAREST, recall: float = RECALL) -> Router:
    """A router from sample vectors: graph, balanced parts, network, and the probes that reach ``recall``."""
    if len(x) < 4 * parts or parts == 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    tried, kept = x[:min(TRIED, len(x) // 4)], x[min(TRIED, len(x) // 4):]
    near = _neighbours(kept, NEIGHBOURS)
    part = balanced_parts(near, parts)
    target = np.zeros((len(kept), parts))
    np.add.at(target, (np.repeat(np.arange(len(kept)), near.shape[1] + 1), part[np.hstack([near, np.arange(len(kept))[:, None]])].ravel()), 1.0)
    router = _learn(kept, target / target.sum(axis=1, keepdims=True))
    found = router.part(kept)
    best = np.argsort(-(tried @ kept.T), axis=1)[:, :nearest]
    place = np.argsort(np.argsort(-router.odds(tried), axis=1), axis=1)
    needed = np.take_along_axis(place, found[best], axis=1)  # how many parts must be probed to meet each neighbour
    router.probes = int(min(parts, 1 + np.searchsorted(np.array([(needed <= p).mean() for p in range(parts)]), recall)))
    return router


def _blocks(rows: DataFrame, keys: list[str], dimension: int, side: str) -> DataFrame:
    """``rows(part, *keys, v)`` as blocks of at most about BLOCK rows: (part, ids_, vectors_) with one binary value each.

    Rows of a part are dealt to blocks by hash, as many as its count asks for, so a part that
    holds most rows is many blocks.
    """
    counts = rows.groupBy("part").count().collect()  # at most MOST_PARTS rows
    needed = F.create_map(*[F.lit(int(v)) for p, n in counts for v in (p, max(1, -(-n // BLOCK)))]) if counts else F.create_map(F.lit(0), F.lit(1))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("v"), needed[F.col("part")]))

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], pickle.dumps(frame[keys[0]].map(list).tolist() if side == "c" else frame[keys[0]].tolist()), matrix(frame["v"], dimension).tobytes())], columns=["part", "ids", "vectors"])

    return dealt.select("part", "block", *keys, "v").groupBy("part", "block").applyInPandas(pack, "part int, ids binary, vectors binary").select(
        "part", F.col("ids").alias(f"ids_{side}"), F.col("vectors").alias(f"vectors_{side}")
    )


def _best(queries: list[int], q: np.ndarray, ids: list[list[int]], c: np.ndarray, nearest: int) -> pd.DataFrame:
    """The ``nearest`` + 1 nearest ids of each query vector in one block, ties to smaller ids."""
    scores = q @ c.T
    keep = min(nearest + 1, len(ids))
    floor = np.partition(scores, len(ids) - keep, axis=1)[:, len(ids) - keep]
    rows: list[tuple[int, int, float]] = []
    for k, query in enumerate(queries):
        at = np.flatnonzero(scores[k] >= floor[k])
        found = sorted((-scores[k, j], i) for j in at.tolist() for i in ids[j])[:nearest + 1]
        rows += [(query, i, -s) for s, i in found]
    return pd.DataFrame(rows, columns=["query", "vec_id", "score"])


def search(rows: DataFrame, is_query, nearest: int = NEAREST, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest rows found for every row that ``is_query`` says is one.

    Nearness is the inner product in double precision. Rows without a vec_id, and vectors
    that are null, zero or hold null or non-finite components take no part; a vector is
    searched among those of its own dimension. Equal vectors are one entry with its smallest
    ids, ``nearest`` + 1 of them, which is all a result can hold. Equal query vectors are ranked
    once, and the list is handed to their ids. Rows that repeat a vec_id and vector count once.
    A query goes on to further parts, in order of odds, until ``nearest`` other ids are in reach.
    The index of a dimension is fitted on ``sample`` distinct vectors, the first by hash, and
    holds every row. An empty table gives an empty result.
    """
    usable_rows = rows.where(usable("embedding") & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").alias("v"))
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dimension in dimensions(usable_rows, "v"):
        out = out.unionByName(_of_one_dimension(usable_rows.where(F.size("v") == dimension).distinct(), is_query, dimension, nearest, sample))
    return out


def _of_one_dimension(usable_rows: DataFrame, is_query, dimension: int, nearest: int, sample: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    entries = usable_rows.withColumn("place", place).where(F.col("place") <= nearest + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = stage(entries)
    count = entries.count()
    chosen = entries.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).toPandas()
    router = fit(matrix(chosen["v"], dimension), parts_for(count), nearest)
    shared = usable_rows.sparkSession.sparkContext.broadcast(router)  # a small network

    def part(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.part(matrix(batch, dimension)), dtype="int32")

    def probed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.probed(matrix(batch, dimension), in_part.value, nearest + 1))

    candidates = stage(entries.withColumn("part", pandas_udf(part, "int")("v")))
    counts = np.zeros(router.parts, dtype=np.int64)
    for p, n in candidates.groupBy("part").agg(F.sum(F.size("ids"))).collect():  # a row a part
        counts[p] = n
    in_part = usable_rows.sparkSession.sparkContext.broadcast(counts)
    # One query a distinct vector, named by its smallest id and its hash, as an id may have several vectors.
    queries = stage(usable_rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v", F.xxhash64("v").alias("hash")))
    vectors = queries.groupBy("v", "hash").agg(F.min("query_id").alias("least"), F.count("*").alias("copies"))
    vectors = stage(vectors.select(F.concat_ws(":", "least", "hash").alias("query"), "v", "hash", F.ceil(F.col("copies") / BLOCK).cast("int").alias("salts")))
    asked = vectors.select("query", "v").withColumn("parts", pandas_udf(probed, "array<int>")("v"))
    asked = stage(asked.select("query", "v", F.explode("parts").alias("part")))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                q, c = (np.frombuffer(x, "<f8").reshape(-1, dimension) for x in (row.vectors_q, row.vectors_c))
                yield _best(pickle.loads(row.ids_q), q, pickle.loads(row.ids_c), c, nearest)

    met = _blocks(candidates, ["ids"], dimension, "c").join(_blocks(asked, ["query"], dimension, "q"), "part")
    found = met.mapInPandas(compare, "query string, vec_id long, score double")
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("place", order).where(F.col("place") <= nearest + 1)
    lists = found.groupBy("query").agg(F.collect_list(F.struct("vec_id", "score")).alias("near"))
    # A vector with more than BLOCK ids hands its list out in several places; there are at most rows / BLOCK such vectors.
    lists = vectors.join(lists, "query").select("v", "hash", "near", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    common = F.broadcast(vectors.where("salts > 1").select("v", "hash", "salts"))
    salt = F.pmod(F.xxhash64("query_id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
    dealt = queries.join(common, ["hash", "v"], "left").select("query_id", "v", "hash", salt)
    found = dealt.join(lists, ["hash", "v", "salt"]).select("query_id", F.explode("near").alias("n")).select("query_id", "n.*").where("vec_id <> query_id")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
