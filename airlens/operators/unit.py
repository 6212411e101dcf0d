"""One column for several keys.

Ordered, greedy, calibration and state operators work per ``key``, one column. Where a
capture holds several devices, or a device's state starts anew at each boot, the unit of
work is (capture, device, boot): ``with_unit`` makes one column of them to give as ``key``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = "unit"
BOOT_KEYS = ("capture_id", "host_mac", "boot_id")


def with_unit(df: DataFrame, keys: Sequence[str] = BOOT_KEYS, name: str = UNIT) -> DataFrame:
    """``df`` with the text of ``keys``, each with its bars doubled, joined by single ones; a missing key is empty."""
    parts = [F.regexp_replace(F.coalesce(F.col(k).cast("string"), F.lit("")), r"\|", "||") for k in keys]
    return df.withColumn(name, F.concat_ws(" | ", *parts))
