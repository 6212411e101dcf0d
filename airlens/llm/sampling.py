"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether crc32 of the id as text has remainder 0; null ids are never held out."""
    id_ = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(F.encode(id_.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


def sample_ids(rows: DataFrame, by: str, per_class: int) -> DataFrame:
    """Of ``rows(doc_id, by, ...)``, at most ``per_class`` rows of each class, the first by a hash of the id.

    Only the given narrow columns are shuffled, and row_number with a limit is cut before the
    shuffle, so a class holding most rows costs no more than a small one.
    """
    order = F.row_number().over(_window(by))
    return rows.withColumn("__place", order).where(F.col("__place") <= per_class).drop("__place")


def _window(by: str):
    from pyspark.sql import Window

    return Window.partitionBy(by).orderBy(F.xxhash64("doc_id"), "doc_id")
