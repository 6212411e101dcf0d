"""Token ids as directly addressable codes, in files.

Ids are split into chunks of eight bits. Level 0 holds the lowest chunk of every id, level k
the k-th chunk of those ids that need it. A bitmap a level says which ids go on, and a
directory of ones before every 512 bits gives an id's place on the next level, so any id is
read by looking at its own chunks only.

Files are Parquet with one segment a row: whole documents in ascending order, about
SEGMENT ids, as one binary value that carries its documents, levels, bitmaps and
directories. Any store Spark writes to will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlens.llm.word_ids import shared_coder

END = 2  # id that ends a document
SEGMENT = 1 << 18  # ids from which a segment is closed
CHUNK = 8
WORDS = 8  # 64-bit words between two entries of a directory
MAGIC = b"DAC1"
_HEAD = struct.Struct("<4sBxxxQQ")


@dataclass
class Level:
    chunks: np.ndarray  # one byte an id
    bitmap: np.ndarray  # 64-bit words; a set bit: the id goes on one level further
    before: np.ndarray  # set bits before each WORDS words

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = at >> 6
        out = self.before[word // WORDS].astype(np.int64)
        first = word // WORDS * WORDS
        for k in range(WORDS - 1):
            out += np.where(first + k < word, np.bitwise_count(self.bitmap[np.minimum(first + k, len(self.bitmap) - 1)]), 0)
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return out + np.bitwise_count(self.bitmap[word] & below)

    def goes_on(self, at: np.ndarray) -> np.ndarray:
        return (self.bitmap[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


@dataclass
class Segment:
    doc_ids: list[int | None]
    ends: np.ndarray  # ids of the segment up to the end of each document
    levels: list[Level]

    def __len__(self) -> int:
        return len(self.levels[0].chunks) if self.levels else 0

    def ids(self, at: np.ndarray) -> np.ndarray:
        """The ids at any places of the segment, each from its own chunks."""
        at = np.asarray(at, dtype=np.int64)
        if len(at) and (at.min() < 0 or at.max() >= len(self)):
            raise IndexError("no such id in the segment")
        out, which = np.zeros(len(at), dtype=np.uint32), np.arange(len(at))
        for k, level in enumerate(self.levels):
            out[which] |= level.chunks[at].astype(np.uint32) << np.uint32(CHUNK * k)
            on = level.goes_on(at)
            which, at = which[on], level.rank(at[on])
            if not len(which):
                break
        return out

    def all_ids(self) -> np.ndarray:
        """All ids in order, level by level."""
        out, which = np.zeros(len(self), dtype="<u4"), np.arange(len(self))
        for k, level in enumerate(self.levels):
            out[which] |= level.chunks.astype("<u4") << np.uint32(CHUNK * k)
            which = which[np.unpackbits(level.bitmap.view(np.uint8), bitorder="little")[:len(which)].astype(bool)]
        return out


def make_levels(ids: np.ndarray) -> list[Level]:
    levels, rest = [], ids.astype(np.uint32)
    while len(rest):
        on = rest >> np.uint32(CHUNK) > 0
        bits = np.packbits(on, bitorder="little")
        bitmap = np.frombuffer(bits.tobytes() + b"\0" * (-len(bits) % 8), dtype="<u8")
        ones = np.bitwise_count(bitmap).astype(np.int64)
        sums = np.add.reduceat(ones, np.arange(0, len(ones), WORDS))
        levels.append(Level((rest & np.uint32(0xFF)).astype(np.uint8), bitmap, (np.cumsum(sums) - sums).astype("<u4")))
        rest = rest[on] >> np.uint32(CHUNK)
    return levels


def pack_segment(doc_ids: list[int | None], arrays: list[np.ndarray]) -> bytes:
    """Header, documents, then for each level its size, chunks, bitmap and directory, and a checksum."""
    ids = np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)
    levels = make_levels(ids)
    parts = [
        _HEAD.pack(MAGIC, len(levels), len(doc_ids), len(ids)),
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(),
        np.cumsum([len(a) for a in arrays], dtype="<u8").tobytes() if arrays else b"",
    ]
    for level in levels:
        parts += [struct.pack("<Q", len(level.chunks)), level.chunks.tobytes(), level.bitmap.tobytes(), level.before.tobytes()]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def open_segment(data: bytes) -> Segment:
    body = memoryview(data)[:-4]
    if zlib.crc32(body) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("damaged segment")
    magic, n_levels, docs, _ = _HEAD.unpack_from(body)
    if magic != MAGIC:
        raise ValueError("not a segment")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(body, dtype=kind, count=n, offset=at)
        at += out.nbytes
        return out

    ids, missing, ends = take("<i8", docs), take("u1", docs), take("<u8", docs)
    levels = []
    for _ in range(n_levels):
        n = int(take("<u8", 1)[0])
        words = -(-n // 64)
        levels.append(Level(take("u1", n), take("<u8", words), take("<u4", -(-words // WORDS))))
    return Segment([None if m else d for d, m in zip(ids.tolist(), missing.tolist(), strict=True)], ends.astype(np.int64), levels)


_FILE = "part int, segment int, ids_before long, n_ids long, n_docs long, payload binary"


def write(documents: DataFrame, path: str, tokenizer: str, segment: int = SEGMENT) -> None:
    """Encode all whole texts and write them to ``path`` in ascending doc_id order, rows without an id first.

    A null text is empty and holds the end id only; rows of one doc_id go by a hash of their
    text. Ranges of ids are dealt out before texts are encoded, so each is encoded once.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, part = shared_coder(tokenizer, spaces_dropped=False), TaskContext.get().partitionId()
        names, arrays, held, before, number = [], [], 0, 0, 0

        def closed() -> pd.DataFrame:
            row = (part, number, before, held, len(names), pack_segment(names, arrays))
            return pd.DataFrame([row], columns=["part", "segment", "ids_before", "n_ids", "n_docs", "payload"])

        for frame in frames:
            for doc_id, ids in zip(frame["doc_id"], coder.encode_all(frame["text"]), strict=True):
                ids = np.append(ids, np.uint32(END))
                names.append(None if doc_id is None else int(doc_id))
                arrays.append(ids)
                held += len(ids)
                if held >= segment:
                    yield closed()
                    names, arrays, held, before, number = [], [], 0, before + held, number + 1
        if names:
            yield closed()

    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("__tie"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "__tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "__tie")
    rows.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, _FILE).write.parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the ids of all segments before them.

    Only one number a part goes through a single task and is handed to all; parts are the
    shuffle partitions of the writing job.
    """
    rows = spark.read.schema(_FILE).parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("part_start"))
    return rows.join(F.broadcast(parts), "part").withColumn("start", F.col("part_start") + F.col("ids_before")).drop("part_start")


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (and the ids) of every document in the files."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for payload, start in zip(frame["payload"], frame["start"], strict=True):
                held = open_segment(bytes(payload))
                ids, ends = held.all_ids(), held.ends
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                out = {
                    "doc_id": [None if d is None else str(d) for d in held.doc_ids], "start": start + begins, "n_tokens": ends - begins,
                    "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)],
                }
                if with_ids:
                    out["ids"] = [ids[a:b].astype(np.int64) for a, b in zip(begins, ends, strict=True)]
                yield pd.DataFrame(out)

    schema = "doc_id string, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    found = read_segments(spark, path).select("payload", "start").mapInPandas(run, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def ids_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """(place, id) for ``places(place)``, numbered over all files; places that do not exist give no row.

    Places meet their segment by ranges of the global numbering; only the chunks of the
    wanted ids are read from a segment.
    """
    segments = read_segments(spark, path).select("start", "n_ids", "payload")
    cell = lambda c: F.floor(c / SEGMENT)
    spread = segments.where("n_ids > 0").select("*", F.explode(F.sequence(cell(F.col("start")), cell(F.col("start") + F.col("n_ids") - 1))).alias("cell"))
    wanted = places.select("place", cell(F.col("place")).alias("cell"))
    inside = (F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("n_ids"))
    met = spread.join(wanted, "cell").where(inside).groupBy("start", "cell").agg(F.first("payload").alias("payload"), F.collect_list("place").alias("places"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start, payload, at in zip(frame["start"], frame["payload"], frame["places"], strict=True):
                yield pd.DataFrame({"place": at, "id": open_segment(bytes(payload)).ids(np.array(at) - start).astype(np.int64)})

    return met.select("start", "payload", "places").mapInPandas(run, "place long, id long")
