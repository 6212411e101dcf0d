"""A keyed table that micro-batches merge into, in buckets by the hash of the key.

Below the table's folder lie ``bucket=b/version=n``: the rows of bucket b as they are after
batch n. A batch writes the buckets it has keys of and no others, and reads the newest
version of those alone, so its cost follows the keys it brings. A batch that runs again
replaces its own versions; the version before stays for it, older ones are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.operators.stage import stage, staging
from airlens.session import remove

BUCKETS = 64


def versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Ascending versions of each bucket, from the names of folders."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    for status in system.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/bucket=*/version=*")) or []:
        bucket, version = status.getPath().getParent().getName(), status.getPath().getName()
        found.setdefault(int(bucket.split("=")[1]), []).append(int(version.split("=")[1]))
    return {b: sorted(v) for b, v in found.items()}


def merge(path: str, key: list[str], new: DataFrame, combine: Callable[[DataFrame], DataFrame], batch_id: int, buckets: int = BUCKETS) -> list[int]:
    """Merge ``new`` into the table: ``combine`` makes old and new rows of a key one. Returns the buckets written."""
    spark = new.sparkSession
    with staging(spark):
        new = stage(new.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")))
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # at most ``buckets`` rows
        if not touched:
            return []
        have = versions(spark, path)
        before = {b: max((v for v in have.get(b, []) if v < batch_id), default=None) for b in touched}
        old = [f"{path}/bucket={b}/version={v}" for b, v in before.items() if v is not None]
        rows = new.drop("bucket")
        if old:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(*old))
        merged = combine(rows).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).withColumn("version", F.lit(batch_id))
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(path)
    for b in touched:
        for v in have.get(b, []):
            if before[b] is not None and v < before[b]:
                remove(spark, f"{path}/bucket={b}/version={v}")
    return touched


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as it is: the newest version of every bucket. There must have been a batch."""
    return spark.read.parquet(*[f"{path}/bucket={b}/version={v[-1]}" for b, v in versions(spark, path).items()])
