"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from airlens.llm.components import connected_components
from airlens.operators.stage import stage

WORDS = 3  # words of a shingle
SEED = 42
BITS = 64
RADIUS = 2
# Shingles whose bits are unpacked at once, so that a very long text needs no more memory than a short one.
BLOCK = 1 << 15
# Fingerprints of a bucket that are compared with each other; a larger bucket is divided by further masks.
BUCKET = 1024


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    bits = np.unpackbits(np.asarray(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def _majority(counts: np.ndarray, n: int) -> int:
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def of_hashes(hashes: np.ndarray) -> int:
    """Unsigned 64-bit fingerprint of shingle hashes: the bits set in over half of them."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        counts += _set_bits(hashes[at:at + BLOCK])
    return _majority(counts, len(hashes))


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of a whole text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - WORDS + 1)
    counts = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        part = words[at:min(at + BLOCK, n) + WORDS - 1]
        if len(words) <= WORDS:
            hashes = [digest(b" ".join(words), SEED)]
        else:
            hashes = [digest(b"%b %b %b" % s, SEED) for s in zip(part, part[1:], part[2:], strict=False)]
        counts += _set_bits(np.array(hashes, dtype="<u8"))
    return _majority(counts, n)


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], dtype=np.uint64).view(np.int64))


def fingerprint_column(text: Column | str) -> Column:
    """Fingerprint as a long with the same bits."""
    return pandas_udf(_fingerprints, "long")(text)


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """Masks of a covering family: any ``radius`` bits lie outside at least one mask.

    Every bit gets a non-zero vector m of radius + 1 binary entries, in turn; for every
    non-zero vector v the mask holds the bits with an odd product m.v. For at most
    ``radius`` bits some v is orthogonal to all their vectors, so its mask holds none.
    """
    vectors = range(1, 1 << (radius + 1))
    of_bit = [vectors[i % len(vectors)] for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(of_bit) if (m & v).bit_count() % 2) for v in vectors]


def finer_masks(mask: int, bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """Masks that divide a bucket of ``mask``: its free bits in radius + 1 parts, one added to each mask.

    Two fingerprints of the bucket at most ``radius`` apart agree on at least one part.
    """
    free = [i for i in range(bits) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[part::radius + 1]) for part in range(radius + 1)]


def tables(fp: Column | str, masks: list[int]) -> Column:
    """The bucket (mask, key) of a fingerprint in the table of each mask."""
    fp = F.col(fp) if isinstance(fp, str) else fp
    return F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks])


def _in_buckets(fingerprints: DataFrame, masks: list[int]) -> DataFrame:
    return fingerprints.select("fp", F.explode(tables("fp", masks)).alias("b")).select("b.mask", "b.key", "fp")


def close_pairs(fingerprints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints ``fp`` at most RADIUS bits apart, some of them more than once.

    A bucket with more than ``bucket`` members is not compared but divided, level by level.
    With m free bits it has at most 2**m members, so the division ends by itself.
    """
    masks = covering_masks()
    rows = stage(_in_buckets(fingerprints, masks))
    found = None
    while True:
        free = max(BITS - m.bit_count() for m in masks)
        hot = stage(rows.groupBy("mask", "key").count().where(F.col("count") > bucket).select("mask", "key"))
        divided = 1 << free > bucket and not hot.isEmpty()
        rest = rows.join(hot, ["mask", "key"], "left_anti") if divided else rows
        a, b = rest.alias("a"), rest.alias("b")
        close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS
        same = (F.col("a.mask") == F.col("b.mask")) & (F.col("a.key") == F.col("b.key"))
        pairs = a.join(b, same & (F.col("a.fp") < F.col("b.fp")) & close).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
        found = pairs if found is None else found.union(pairs)
        if not divided:
            return found
        finer = {m: finer_masks(m) for m in masks}
        options = F.create_map(*[x for m, parts in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(p)) for p in parts]))])
        rows = stage(
            rows.join(hot, ["mask", "key"], "left_semi")
            .select("fp", F.explode(options[F.col("mask")]).alias("mask"))
            .select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
            .distinct()
        )
        masks = sorted({p for parts in finer.values() for p in parts})


def groups(documents: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row; the component is the smallest doc_id linked to it, directly or not.

    Copies share a fingerprint and are one node of the graph, however many there are. A text
    that is null, empty or only white space has fingerprint 0 and links like any other. Rows
    without a doc_id take part; a component of such rows only has a null component_id. No
    rows give no rows. Columns beyond doc_id and text are ignored.
    """
    prints = stage(documents.select("doc_id", fingerprint_column("text").alias("fp")))
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    tree = connected_components(close_pairs(nodes.select("fp")))
    rooted = nodes.join(tree.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    rooted = stage(rooted.select("fp", "first", "root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(documents: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, whole and with all its columns.

    The row with the group's smallest doc_id stays; of repeated rows with that id, one. Only
    ids are compared, so rows of one id but different groups both stay, once each.
    """
    kept = groups(documents).where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id", "fp").distinct()
    kept = kept.select(F.col("doc_id").alias("__kept_id"), F.col("fp").alias("__kept_fp"))
    rows = documents.withColumn("__fp", fingerprint_column("text"))
    match = F.col("doc_id").eqNullSafe(F.col("__kept_id")) & (F.col("__fp") == F.col("__kept_fp"))
    return rows.join(kept, match, "left_semi").dropDuplicates(["doc_id", "__fp"]).select(*documents.columns)
