"""Importance resampling of documents towards a target's distribution of hashed features.

Features are runs of words, hashed into buckets. The buckets of all documents and of all
target texts are counted once; a bucket's gain is the whole part of a thousand times the log of
how much commoner it is in the target. A document's weight is the sum of its features' gains,
taken from one array, and Gumbel noise from a hash of its id turns weights into scores of
which the highest are a draw without replacement.

The cutoff is found exactly and without a sort of all keys. In each round every partition
gives the medians of its keys still in question, a block of BLOCK keys at a time; their
median weighted by the numbers of keys they stand for is the next pivot, so an eighth of the
keys at least falls away whatever their order. Keys are unique, so the rounds end at the key
with exactly the wanted number of keys before it. Only the winners are sorted.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlens.operators.stage import stage

BUCKETS = 10_000
SCALE = 1000  # gains and noise are whole thousandths
LEAST_WORDS = 20  # of a document that can be drawn
PERCENT = 10
SEED = "2024"
BLOCK = 1 << 16  # keys whose median is taken at once
REMEMBERED = 1 << 18  # words a task remembers the bucket of

# A-Z to a-z; what is no digit, letter or byte of a character beyond ASCII, to a blank.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
KEY = ("score", "doc_id", "n_features", "weight", "row")


def words(text: bytes | None) -> list[bytes]:
    """Words of a whole text in UTF-8; none of a null one."""
    return text.translate(_PLAIN).split() if text else []


def features(found: list[bytes], grams: tuple[int, int]) -> Iterator[bytes]:
    """All runs of ``grams`` consecutive words, from the least to the greatest length, joined by one blank."""
    for n in range(grams[0], grams[1] + 1):
        if n == 1:
            yield from found
        else:
            yield from map(b" ".join, zip(*(found[k:] for k in range(n)), strict=False))


class _Buckets(dict):
    """Bucket of a feature, remembered for the features met last."""

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = at = zlib.crc32(feature) % BUCKETS
        return at


def bucket_counts(texts: DataFrame, grams: tuple[int, int] = (1, 1)) -> np.ndarray:
    """How many features of all whole ``texts(text)`` fall into each bucket; a task hands on one sum a bucket."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, known = np.zeros(BUCKETS, dtype=np.int64), _Buckets()
        for frame in frames:
            for text in frame["text"]:
                at = np.fromiter(map(known.__getitem__, features(words(text), grams)), dtype=np.int64)
                total += np.bincount(at, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    found = texts.select(F.col("text").cast("binary").alias("text")).mapInPandas(count, "bucket int, n long")
    out = np.zeros(BUCKETS, dtype=np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket from its counts in source and target, with one added to each, in whole thousandths rounded down."""
    of_source, of_target = float(source.sum() + len(source)), float(target.sum() + len(target))
    ratio = [(t + 1.0) * of_source / ((s + 1.0) * of_target) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(SCALE * math.log(r)) for r in ratio], dtype=np.int64)


def noise(doc_id: str | None, seed: str = SEED) -> int:
    """Gumbel noise of a document in whole thousandths rounded down; a null id is written as nothing."""
    h = int(hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(documents: DataFrame, gain: np.ndarray, grams: tuple[int, int] = (1, 1), seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row, from whole texts."""
    shared = documents.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gain, known = shared.value, _Buckets()
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                found = words(text)
                at = np.fromiter(map(known.__getitem__, features(found, grams)), dtype=np.int64)
                weight = int(gain[at].sum())
                rows.append((doc_id, len(found), len(at), weight, weight + noise(doc_id, seed)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_features", "weight", "score"])

    rows = documents.select(F.col("doc_id").cast("string"), F.col("text").cast("binary").alias("text"))
    found = rows.mapInPandas(run, "doc_id string, n_words long, n_features long, weight long, score long")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


@dataclass(frozen=True)
class Key:
    """Place of a row in the order: highest score first, ties to the smaller doc_id (none last), then by the other columns."""

    order: tuple[int, ...]

    def before(self, or_at: bool = False) -> Column:
        """Whether a row comes before this key."""
        out = F.lit(or_at)
        for value, column in reversed(list(zip(self.order, _order(), strict=True))):
            out = (column < F.lit(value)) | ((column == F.lit(value)) & out)
        return out


def _order() -> list[Column]:
    """Ascending columns in which the rows' order is lexicographic."""
    return [-F.col("score"), F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0)), F.col("n_features"), F.col("weight"), F.col("row")]


_PARTS = [f"k{i}" for i in range(6)]


def _middle(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, int]:
    """The median of ``keys`` (one a row) weighted by ``weights``, and the sum of weights."""
    order = np.lexsort(keys.T[::-1])
    reach = np.cumsum(weights[order])
    return keys[order[int(np.searchsorted(reach, (reach[-1] + 1) // 2))]], int(reach[-1])


def _medians(pivot: tuple[int, ...] | None):
    """For each side of the pivot, the number of a task's keys there and the weighted median of the medians of its blocks."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[np.ndarray]] = [[], []]
        found: list[list[tuple[np.ndarray, int]]] = [[], []]

        def close(side: int) -> None:
            keys = np.concatenate(held[side])
            found[side].append(_middle(keys, np.ones(len(keys), dtype=np.int64)))
            held[side] = []

        for frame in frames:
            keys = frame.to_numpy(dtype=np.int64)
            ahead, same = np.zeros(len(keys), dtype=bool), np.ones(len(keys), dtype=bool)
            for k, value in enumerate(pivot or ()):
                ahead |= same & (keys[:, k] < value)
                same &= keys[:, k] == value
            for side, rows in enumerate((ahead, ~ahead & ~(same & (pivot is not None)))):
                if rows.any():
                    held[side].append(keys[rows])
                    if sum(map(len, held[side])) >= BLOCK:
                        close(side)
        out = []
        for side in (0, 1):
            if held[side]:
                close(side)
            if found[side]:
                key, n = _middle(np.array([k for k, _ in found[side]]), np.array([n for _, n in found[side]]))
                out.append((side, n, *key.tolist()))
        yield pd.DataFrame(out, columns=["side", "n", *_PARTS], dtype="int64")

    return run


def cutoff(keys: DataFrame, wanted: int) -> Key | None:
    """The key of the ``wanted``-th row of ``keys`` (columns of KEY, staged, unique ``row``); None where none is wanted.

    A round is one job: counts on both sides of the pivot together with the medians for the
    next. The driver gets two rows a task. Rows out of question are filtered before Python.
    """
    if wanted <= 0:
        return None
    schema = "side int, n long, " + ", ".join(f"{p} long" for p in _PARTS)
    low: Key | None = None
    high: Key | None = None
    pivot: Key | None = None
    while True:
        rows = keys
        if low is not None:
            rows = rows.where(~low.before(or_at=True) & (F.col("score") <= F.lit(-low.order[0])))
        if high is not None:
            rows = rows.where(high.before() & (F.col("score") >= F.lit(-high.order[0])))
        rows = rows.select(*[c.alias(p) for c, p in zip(_order(), _PARTS, strict=True)])
        found = rows.mapInPandas(_medians(pivot.order if pivot else None), schema).collect()
        ahead = sum(r.n for r in found if r.side == 0)
        if pivot is not None:
            if ahead + 1 == wanted:
                return pivot
            if ahead >= wanted:
                high = pivot
            else:
                low, wanted = pivot, wanted - ahead - 1
        side = 0 if pivot is not None and high is pivot else 1
        left = [r for r in found if r.side == side]
        if not left:
            raise ValueError("fewer keys than wanted")
        middle, _ = _middle(np.array([r[2:] for r in left], dtype=np.int64), np.array([r.n for r in left], dtype=np.int64))
        pivot = Key(tuple(middle.tolist()))


def _places(winners: DataFrame) -> DataFrame:
    """``winners`` with ``rank`` from 1 in the order: sorted by ranges, numbered in each, one count a range added up."""
    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n = TaskContext.get().partitionId(), 0
        for frame in frames:
            yield frame.assign(part=part, place=np.arange(n + 1, n + 1 + len(frame)))
            n += len(frame)

    order = _order()
    rows = winners.withColumn("id", F.col("doc_id").cast("string"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "n_features", "weight", "score")
    rows = stage(rows.mapInPandas(number, "id string, n_features long, weight long, score long, part int, place long"))
    parts = rows.groupBy("part").agg(F.count("*").alias("n"))  # a row a range
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("ahead"))
    rank = (F.col("ahead") + F.col("place")).alias("rank")
    return rows.join(F.broadcast(parts), "part").select(F.col("id").cast("long").alias("doc_id"), "n_features", "weight", "score", rank)


def resample(
    documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, grams: tuple[int, int] = (1, 1), seed: str = SEED
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``documents(doc_id, text)``; rank is null where undrawn.

    Of the rows with ``least_words`` words or more, ``percent`` in a hundred (rounded down) are
    drawn by highest score, ties to the smaller doc_id. ``target(text)`` says what to draw
    towards; without any text there each gain tells how rare a bucket is. Null and empty
    texts have no features and weight 0. Repeated rows count and are drawn singly; a null
    doc_id comes last among equal scores. An empty table gives an empty one. Other columns
    are ignored.
    """
    gain = gains(bucket_counts(documents, grams), bucket_counts(target, grams))
    rows = stage(scored(documents, gain, grams, seed).withColumn("row", F.monotonically_increasing_id()))
    able = F.col("n_words") >= least_words
    last = cutoff(rows.where(able).select(*KEY), rows.where(able).count() * percent // 100)
    drawn = able & last.before(or_at=True) if last else F.lit(False)
    out = ["doc_id", "n_features", "weight", "score"]
    rest = rows.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank"))
    return rest.unionByName(_places(rows.where(drawn))) if last else rest


def drawn_documents(documents: DataFrame, result: DataFrame) -> DataFrame:
    """The drawn rows of ``documents``, whole and with all their columns; rows of one id go together."""
    ids = result.where("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn")).distinct()
    return documents.join(ids, F.col("doc_id").eqNullSafe(F.col("__drawn")), "left_semi")
