"""Vectors in tables: which take part, distinct ones, sums of squares, and blocks as binary rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column | str) -> Column:
    """Whether a vector is there, has finite components only, and is not zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def dimensions(rows: DataFrame, vector: str) -> list[int]:
    """The dimensions usable vectors have, ascending. Vectors of one dimension are work of their own, so a table should have few."""
    return sorted(r.d for r in rows.where(usable(vector)).select(F.size(vector).alias("d")).distinct().collect())


def matrix(values: pd.Series | list, dimension: int) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values]) if len(values) else np.zeros((0, dimension))


def second_moments(rows: DataFrame, vector: str, dimension: int, unit: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance and number of the vectors (of their directions with ``unit``).

    Each task adds up its own; what is shuffled and reaches the driver is dimension squared
    numbers, however many rows there are.
    """
    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dimension + 1, dimension + 1))
        for frame in frames:
            x = matrix(frame["v"], dimension)
            if unit and len(x):
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    cells = rows.select(F.col(vector).alias("v")).mapInPandas(sums, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    full = np.zeros((dimension + 1, dimension + 1))
    full[cells["i"], cells["j"]] = cells["s"]
    n = max(int(round(full[-1, -1])), 1)
    mean = full[-1, :-1] / n
    return mean, full[:-1, :-1] / n - np.outer(mean, mean), int(round(full[-1, -1]))
