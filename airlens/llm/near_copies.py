"""Near-copies by word shingles: SimHash and MinHash buckets give candidates, exact Jaccard similarity decides.

A text is the set of its distinct five-word shingles; texts of less than five words have one.
Texts with equal sets are one node. Every set has a SimHash fingerprint, which lies in a
bucket of each covering mask: two fingerprints at most RADIUS bits apart share one. Sets at
0.8 may lie 14 bits apart, which no affordable family of masks covers, so sets meet in
MinHash buckets as well: two of similarity s share one of BANDS with probability
1 - (1 - s**ROWS)**BANDS, 0.99994 at 0.8 and more above.

All nodes of a bucket are first compared with its most central one, whose other buckets are
the fullest: in a family of near-copies that is the text the others were made from, so a
family costs as many comparisons as it has nodes. Nodes of a bucket still apart after that
are paired by prefix filtering: with shingles ordered from rare to common, two sets as
similar as asked share one of their first, at places that leave room for the rest of the
overlap. What a near-copy has of its own is rare and comes first, so members of a family that
differ too much meet nowhere. The filter loses no pair; the components of the links are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from airlens.llm import simhash
from airlens.llm.components import connected_components
from airlens.operators.stage import stage

WORDS = 5  # words of a shingle
SIMILAR, OF = 4, 5  # Jaccard similarity of 4/5 or more links
SEED = 42
RADIUS = 4  # bits up to which two fingerprints surely meet
MASKS = simhash.covering_masks(radius=RADIUS)
BANDS, ROWS = 32, 6
BLOCK = 1 << 13  # shingles whose minima are taken at once

_RNG = np.random.default_rng(SEED)
_FLIP = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's shingles; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) < WORDS:
        hashes = [digest(b" ".join(words), SEED)] if words else []
        return np.array(hashes, dtype=np.uint64)
    runs = zip(*(words[k:] for k in range(WORDS)), strict=False)
    return np.unique(np.fromiter((digest(b" ".join(r), SEED) for r in runs), dtype=np.uint64, count=len(words) - WORDS + 1))


def bands(found: np.ndarray) -> list[int]:
    """A long for each band of a set's minima; sets with the same minima in a band have the same long."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), BLOCK):
        part = found[at:at + BLOCK]
        least = np.minimum(least, ((part[None, :] ^ _FLIP[:, None]) * _TIMES[:, None]).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], dtype=np.uint64).view(np.int64).tolist()


def _node(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64)) if len(found) else 0


def _sketches(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        sets = [shingles(t) for t in batch]
        prints = np.array([simhash.of_hashes(s) for s in sets], dtype=np.uint64).view(np.int64)
        yield pd.DataFrame({"node": [_node(s) for s in sets], "fp": prints, "bands": [bands(s) for s in sets]})


def _keyed(nodes: DataFrame) -> DataFrame:
    """(node, key) of every bucket a node lies in: those of its fingerprint under the covering masks, and its bands."""
    masked = F.transform(simhash.tables("fp", MASKS), lambda b: F.xxhash64(b["mask"], b["key"]))
    return nodes.select("node", F.explode(F.concat(masked, "bands")).alias("key"))


def _sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([shingles(t).tobytes() for t in batch], dtype=object)


def _similar(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        out = []
        for a, b in zip(left, right, strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(OF * both >= SIMILAR * (len(x) + len(y) - both))
        yield pd.Series(out, dtype=bool)


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes whose whole sets are similar enough."""
    a, b = (sets.select(F.col("node").alias(n), F.col("hashes").alias(f"hashes_{n}")) for n in ("u", "v"))
    met = pairs.join(a, "u").join(b, "v")
    return met.where(pandas_udf(_similar, "boolean")("hashes_u", "hashes_v")).select("u", "v")


def _tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for node, hashes in zip(frame["node"], frame["hashes"], strict=True):
            yield pd.DataFrame({"token": np.frombuffer(hashes, np.int64)}).assign(node=node)


def _first_shared(sets: DataFrame) -> DataFrame:
    """(token, node, place, size) of the shingles of each set that a pair similar enough must share one of.

    Shingles of one set alone take the first places and are left out.
    """
    tokens = stage(sets.mapInPandas(_tokens, "token long, node long"))
    often = tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    met = tokens.join(often, "token")
    shared = met.groupBy("node").agg(F.count("*").alias("n_shared"))
    sizes = sets.select("node", (F.length("hashes") / 8).cast("long").alias("size")).join(shared, "node")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("often", "token"))  # a set at a time
    placed = met.withColumn("rank", rank).join(sizes, "node").withColumn("place", F.col("size") - F.col("n_shared") + F.col("rank") - 1)
    return placed.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * SIMILAR / OF)).select("token", "node", "place", "size")


def _met_in_front(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of ``apart(node, label, far)`` of different labels, one at least far from its pivot, that may be similar enough."""
    front = stage(_first_shared(sets.join(apart.select("node"), "node", "left_semi")).join(apart, "node"))
    a, b = (front.select("token", *[F.col(c).alias(f"{c}_{n}") for c in ("node", "label", "far", "place", "size")]) for n in "ab")
    both = a.where("far_a").join(b, "token").where("label_a <> label_b AND (NOT far_b OR node_a < node_b)")
    overlap = F.ceil((F.col("size_a") + F.col("size_b")) * SIMILAR / (SIMILAR + OF))
    room = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    return both.where(room >= overlap).select(F.col("node_a").alias("u"), F.col("node_b").alias("v")).distinct()


def _components(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(node, component) of the nodes with a link; of two nodes of a bucket it is known whether they are linked or connected already."""
    keyed = stage(_keyed(nodes))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stage(keyed.join(sizes, "key"))
    central = shared.groupBy("node").agg(F.sum("n").alias("score"))
    pivots = shared.join(central, "node").groupBy("key").agg(F.max(F.struct("score", "node"))["node"].alias("pivot"))
    shared = stage(shared.join(pivots, "key"))
    wanted = central.select("node").join(nodes.select("node", "one.*"), "node").select("node", F.col("doc_id").alias("of"), "mark")
    rows = documents.select(F.col("doc_id").alias("of_id"), F.xxhash64("text").alias("of_mark"), "text")
    texts = rows.join(wanted, F.col("of_id").eqNullSafe(F.col("of")) & (F.col("of_mark") == F.col("mark")))
    sets = stage(texts.dropDuplicates(["node"]).select("node", pandas_udf(_sets, "binary")("text").alias("hashes")))

    pairs = shared.where("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    links = stage(_links(pairs, sets))
    tree = stage(connected_components(links).select("node", "component"))
    label = lambda name: F.coalesce(F.col("component"), F.col(name))
    rest = shared.where("n > 2").join(tree, "node", "left").select("pivot", "node", label("node").alias("label"))
    rest = rest.join(tree.withColumnRenamed("node", "pivot"), "pivot", "left").select("pivot", "node", "label", (F.col("label") != label("pivot")).alias("far"))
    # Where every node of a bucket is connected to its pivot, no pair of it is unknown.
    mixed = rest.groupBy("pivot").agg(F.max("far").alias("some")).where("some").select("pivot")
    apart = rest.join(mixed, "pivot", "left_semi").groupBy("node", "label").agg(F.max("far").alias("far"))
    return connected_components(stage(links.union(_links(_met_in_front(stage(apart), sets), sets))))


def _sketched(documents: DataFrame) -> DataFrame:
    """doc_id, mark, node, fingerprint and bands of every row."""
    sketch = pandas_udf(_sketches, "node long, fp long, bands array<long>")
    rows = documents.select("doc_id", F.xxhash64("text").alias("mark"), sketch("text").alias("s"))
    return rows.select("doc_id", "mark", "s.node", "s.fp", "s.bands")


def _nodes(rows: DataFrame) -> DataFrame:
    one = F.min(F.struct("doc_id", "mark")).alias("one")
    return rows.groupBy("node").agg(F.min("doc_id").alias("first"), one, F.first("fp").alias("fp"), F.first("bands").alias("bands"))


def groups(documents: DataFrame) -> DataFrame:
    """(doc_id, mark, node, component_id) of every row; the component is the smallest doc_id linked to it, directly or not.

    ``mark`` is the hash of the text. Texts without words are one node. Rows without a doc_id
    take part; a component of such rows only has a null component_id.
    """
    rows = stage(_sketched(documents))
    nodes = stage(_nodes(rows))
    tree = _components(nodes, documents)
    rooted = nodes.select("node", "first").join(tree, "node", "left").select("node", "first", F.coalesce("component", "node").alias("root"))
    rooted = stage(rooted)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("node", "component_id")
    return rows.select("doc_id", "mark", "node").join(named, "node").select("doc_id", "mark", "node", "component_id")


def keep_first(documents: DataFrame) -> DataFrame:
    """One row of each group of near-copies, whole and with all its columns.

    The row with the group's smallest doc_id stays; of repeated rows with that id, one. Only
    ids are compared, so rows of one id but different groups both stay, once each.
    """
    kept = groups(documents).where(F.col("component_id").eqNullSafe(F.col("doc_id")))
    # A group may hold several texts of that id; the one with the least mark stays.
    kept = kept.groupBy(F.col("doc_id").alias("__kept_id"), F.col("component_id"), "node").agg(F.min("mark").alias("__kept_mark"))
    rows = documents.withColumn("__mark", F.xxhash64("text"))
    match = F.col("doc_id").eqNullSafe(F.col("__kept_id")) & (F.col("__mark") == F.col("__kept_mark"))
    return rows.join(kept, match, "left_semi").dropDuplicates(["doc_id", "__mark"]).select(*documents.columns)
