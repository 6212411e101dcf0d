"""Tumbling feature windows over packets (A1-A6) and their order (O2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens import schema as S
from airlens.functions.scalars import is_attack_type, rf_valid, running_variance, subtype_class

_LAST_FIELDS = {
    "gw_mac_flip": "gw_flip", "heap": "heap", "minheap": "minheap", "reconn": "reconn",
    "qpeak": "qpeak", "udpfail": "udpfail", "backlog": "backlog",
}
_ROW_BITS = 46


def window_of(gen_us: Column, width_us: int) -> Column:
    """Start of the epoch-aligned window a time falls into."""
    return gen_us - F.pmod(gen_us, F.lit(width_us).cast("bigint"))


def _place_in_window(gen_us: Column, row_no: Column, width_us: int) -> Column:
    """Order of a row inside its window.

    One long where both parts fit, so that the aggregate stays hash-based; a struct for
    wider windows.
    """
    offset = F.pmod(gen_us, F.lit(width_us).cast("bigint"))
    if width_us.bit_length() + _ROW_BITS > 63:
        return F.struct(offset, row_no)
    fits = (row_no >= 0) & (row_no < (1 << _ROW_BITS))
    packed = offset * F.lit(1 << _ROW_BITS) + row_no
    return F.when(fits, packed).otherwise(F.raise_error(F.lit("row number out of range")).cast("bigint"))


def _typed(packets: DataFrame) -> DataFrame:
    """Doubles for all measures; columns an old capture lacks become null or 0."""
    have = set(packets.columns)

    def col(name: str, default: Column | None) -> Column:
        if name not in have:
            return default if default is not None else F.lit(None).cast("double")
        value = F.col(name).cast("double")
        return value if default is None else F.coalesce(value, default)

    zero = F.lit(0.0)
    fields = {f: col(f, zero) for f in (
        "rssi", "snr", "deauth_tgt", "seq_jump", "gw_flip", "heap", "minheap", "reconn", "qpeak",
        "udpfail", "backlog", "label",
    )}
    fields |= {f: col(f, None) for f in ("win_pkts", "win_dens")}
    kind = F.col("attack_type") if "attack_type" in have else F.lit("NONE")
    return packets.withColumns({**fields, "attack_type": F.when(is_attack_type(kind), kind)})


def packet_measures(packets: DataFrame, width_us: int, row_no: str) -> DataFrame:
    """Typed packets with their window, place in it and frame class."""
    return _typed(packets).withColumns({
        "window_us": window_of(F.col("gen_us"), width_us),
        "_place": _place_in_window(F.col("gen_us"), F.col(row_no), width_us),
        "_kind": subtype_class(F.col("subtype")),
    })


def per_type_aggs() -> list[Column]:
    """What is kept per window and attack type."""
    valid = rf_valid(F.col("rssi"))
    rssi, snr = F.when(valid, F.col("rssi")), F.when(valid, F.col("snr"))
    one = lambda cond: F.count(F.when(cond, 1))
    return [
        F.count(F.lit(1)).alias("_n"),
        *[one(F.col("_kind") == k).alias(f"_{k}") for k in ("beacon", "deauth", "probe", "auth")],
        one(F.col("deauth_tgt") >= 1).alias("_tgt"),
        one(F.col("seq_jump") >= 1).alias("_jump"),
        F.count(rssi).alias("_rf_n"),
        F.sum(rssi).alias("_rssi"),
        F.sum(rssi * rssi).alias("_rssi2"),
        F.sum(snr).alias("_snr"),
        F.max("win_pkts").alias("_pkts"),
        F.max("win_dens").alias("_dens"),
        F.max("label").alias("_label"),
        F.min("_place").alias("_first"),
        F.max("_place").alias("_last"),
        *[F.max_by(src, "_place").alias(dst) for dst, src in _LAST_FIELDS.items()],
    ]


def per_window_aggs() -> list[Column]:
    """The types of a window folded to one row."""
    common = F.when(F.col("attack_type").isNotNull(), F.struct(-F.col("_n"), F.col("_first")))
    return [
        F.sum("_n").alias("_n"),
        *[F.sum(f"_{k}").cast("double").alias(f) for k, f in (
            ("beacon", "beacon_packets"), ("deauth", "deauth_packets"), ("probe", "probe_packets"),
            ("auth", "auth_packets"), ("tgt", "deauth_targeted"), ("jump", "seq_jump"),
        )],
        F.sum("_rf_n").alias("_rf_n"), F.sum("_rssi").alias("_rssi"),
        F.sum("_rssi2").alias("_rssi2"), F.sum("_snr").alias("_snr"),
        F.max("_pkts").alias("_pkts"), F.max("_dens").alias("_dens"), F.max("_label").alias("_label"),
        F.max_by(F.struct(*_LAST_FIELDS), "_last").alias("_host"),
        F.min_by("attack_type", common).alias("_type"),
    ]


def finish_windows(w: DataFrame, width_us: int, key: str, with_source: bool = False) -> DataFrame:
    """Feature columns from the folded sums."""
    seconds = F.lit(width_us / 1_000_000)
    reported = F.floor("_pkts").cast("double")
    total = F.coalesce(reported, F.col("_n").cast("double"))
    mean = F.col("_rssi") / F.col("_rf_n")
    variance = running_variance(F.col("_rssi2") / F.col("_rf_n"), mean)
    w = w.withColumns({
        "total_packets": total,
        "packet_density": F.coalesce(F.when(F.col("_pkts").isNotNull(), F.col("_dens")), total / seconds),
        "density_source": F.when(F.col("_pkts").isNotNull(), "sensor").otherwise("rows"),
        "rssi_mean": F.when(F.col("_rf_n") > 0, mean).otherwise(0.0),
        "rssi_var": F.when(F.col("_rf_n") > 1, variance).otherwise(0.0),
        "snr_mean": F.when(F.col("_rf_n") > 0, F.col("_snr") / F.col("_rf_n")).otherwise(0.0),
        **{f: F.col(f"_host.{f}") for f in _LAST_FIELDS},
        "label": (F.col("_label") >= 1).cast("int"),
        "attack_type": F.coalesce(F.col("_type"), F.lit("NONE")),
    }).withColumn("gw_mac_flip", F.col("gw_mac_flip").cast("int"))
    return w.select(
        key, "window_us", *S.WINDOW_FEATURES, *S.SIDECAR_FEATURES, "label", "attack_type",
        *(["density_source"] if with_source else []),
    )


def aggregate_windows(
    packets: DataFrame,
    width_us: int = S.WINDOW_US,
    key: str = "capture_id",
    row_no: str = "pkt_id",
    with_source: bool = False,
) -> DataFrame:
    """One row per capture and window that holds a packet.

    Two hash-partitioned passes. The first folds packets to one row per window and attack
    type with map-side combine; the second folds the few types of a window and picks the
    commonest one, the earlier in time on ties.
    """
    by_type = packet_measures(packets, width_us, row_no).groupBy(key, "window_us", "attack_type").agg(*per_type_aggs())
    folded = by_type.groupBy(key, "window_us").agg(*per_window_aggs())
    return finish_windows(folded, width_us, key, with_source)


def density_contract(packets: DataFrame, **kw) -> DataFrame:
    """Totals, densities and which source they came from (A2)."""
    key = kw.get("key", "capture_id")
    return aggregate_windows(packets, with_source=True, **kw).select(
        key, "window_us", "total_packets", "packet_density", "density_source"
    )


def density_sources(windows: DataFrame, key: str = "capture_id") -> DataFrame:
    """Windows per density source; ``legacy_only`` marks captures without sensor counts."""
    return windows.groupBy(key).agg(
        F.count(F.when(F.col("density_source") == "sensor", 1)).alias("sensor_windows"),
        F.count(F.when(F.col("density_source") == "rows", 1)).alias("row_windows"),
    ).withColumn("legacy_only", (F.col("sensor_windows") == 0) & (F.col("row_windows") > 0))


def majority_type(packets: DataFrame, width_us: int = S.WINDOW_US, key: str = "capture_id", row_no: str = "pkt_id") -> DataFrame:
    """Commonest attack type per window, the first seen on ties, else NONE."""
    kind = F.when(is_attack_type(F.col("attack_type")), F.col("attack_type"))
    place = _place_in_window(F.col("gen_us"), F.col(row_no), width_us)
    counts = (
        packets.select(key, window_of(F.col("gen_us"), width_us).alias("window_us"), kind.alias("_type"), place.alias("_p"))
        .groupBy(key, "window_us", "_type").agg(F.count(F.lit(1)).alias("_n"), F.min("_p").alias("_first"))
    )
    rank = F.when(F.col("_type").isNotNull(), F.struct(-F.col("_n"), F.col("_first")))
    return counts.groupBy(key, "window_us").agg(
        F.coalesce(F.min_by("_type", rank), F.lit("NONE")).alias("attack_type")
    )


def signal_moments(packets: DataFrame, width_us: int = S.WINDOW_US, key: str = "capture_id") -> DataFrame:
    """Sensor-side means and variance over all packets, nothing filtered (A4)."""
    g = packets.groupBy(key, window_of(F.col("gen_us"), width_us).alias("window_us")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("rssi").alias("_s"),
        F.sum(F.col("rssi") * F.col("rssi")).alias("_q"), F.sum("snr").alias("_r"),
    )
    mean = F.col("_s") / F.col("n")
    return g.select(
        key, "window_us", "n", mean.alias("rssi_mean"),
        running_variance(F.col("_q") / F.col("n"), mean).alias("rssi_var"),
        (F.col("_r") / F.col("n")).alias("snr_mean"),
    )


def run_summary(windows: DataFrame, key: str = "capture_id") -> DataFrame:
    """Totals and density range of a run, per capture (A5)."""
    return windows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.count(F.when(F.col("label") == 0, 1)).alias("n_normal"),
        F.count(F.when(F.col("label") == 1, 1)).alias("n_attack"),
        F.min("packet_density").alias("density_min"),
        F.max("packet_density").alias("density_max"),
        F.avg("packet_density").alias("density_mean"),
        F.count_distinct("packet_density").alias("density_distinct"),
    )


def attack_type_counts(windows: DataFrame, key: str = "capture_id") -> DataFrame:
    """Attack windows per type (A5)."""
    return windows.where("label = 1").groupBy(key, "attack_type").agg(F.count(F.lit(1)).alias("n_windows"))


def order_windows(windows: DataFrame, key: str = "capture_id") -> DataFrame:
    """Windows in time order inside their capture (O2)."""
    return windows.orderBy(key, "window_us")


def union_captures(*captures: DataFrame) -> DataFrame:
    """Windows of several captures, one after the other; columns may differ (O1)."""
    out = captures[0]
    for other in captures[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
