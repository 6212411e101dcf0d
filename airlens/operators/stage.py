"""Tables written once and read several times."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from airlens.session import remove, shared_dir

_HELD: list[list[str]] = []


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For inputs an operator reads more than once: the work behind them is done once, later
    reads are pruned column scans, and a lost executor costs no recomputation. Inside
    ``staging`` the folder belongs to that run and goes with it; elsewhere it stays until the
    cluster clears its shared folder.
    """
    path = f"{shared_dir(df.sparkSession)}/stage/{uuid.uuid4().hex}"
    if _HELD:
        _HELD[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Own what is staged inside, and delete it at the end, when results have been written or collected."""
    _HELD.append([])
    try:
        yield
    finally:
        for path in _HELD.pop():
            remove(spark, path)
