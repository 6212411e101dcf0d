"""Decoding of captured frame headers held in a binary column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens.functions.scalars import deauth_targeted

# Management subtype numbers.
MANAGEMENT_SUBTYPES = {
    4: "PROBE_REQ", 5: "PROBE_RESP", 8: "BEACON", 10: "DISASSOC", 11: "AUTH", 12: "DEAUTH",
}
# Frame type numbers.
FRAME_TYPES = {0: "MGMT", 1: "CTRL", 2: "DATA"}
ZERO_MAC = "00:00:00:00:00:00"


def _byte(frame: Column, offset: int) -> Column:
    return F.conv(F.hex(F.substring(frame, offset + 1, 1)), 16, 10).cast("int")


def _mac(frame: Column, offset: int) -> Column:
    digits = F.hex(F.substring(frame, offset + 1, 6))
    return F.rtrim(F.regexp_replace(digits, "(..)", "$1:"), F.lit(":"))


def _choose(col: Column, names: dict[int, str], default: str) -> Column:
    out = F.lit(default)
    for number, name in names.items():
        out = F.when(col == number, name).otherwise(out)
    return out


def decode_frames(df: DataFrame, frame: str = "frame", length: str = "frame_len", host_mac: str = "host_mac") -> DataFrame:
    """Add type, subtype, addresses, sequence number and the targeted-deauth flag."""
    data, size = F.col(frame), F.col(length)
    control = F.when(size >= 1, _byte(data, 0))
    kind = F.shiftright(control, 2).bitwiseAND(3)
    management = _choose(F.shiftright(control, 4).bitwiseAND(15), MANAGEMENT_SUBTYPES, "MGMT_OTHER")
    sequence = F.shiftright(_byte(data, 23) * 256 + _byte(data, 22), 4)
    out = df.withColumns({
        "frame_type": F.when(control.isNotNull(), _choose(kind, FRAME_TYPES, "OTHER")),
        "subtype": F.when(kind == 0, management).otherwise(""),
        "dst_mac": F.when(size >= 16, _mac(data, 4)).otherwise(ZERO_MAC),
        "src_mac": F.when(size >= 16, _mac(data, 10)).otherwise(ZERO_MAC),
        "seq": F.when(size >= 24, sequence).otherwise(0),
    })
    return out.withColumn(
        "deauth_tgt", deauth_targeted(F.col("subtype"), F.col("dst_mac"), F.col(host_mac))
    )
