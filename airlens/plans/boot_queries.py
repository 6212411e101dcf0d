"""Operators per capture, device and boot: the sensor starts anew whenever it boots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.operators import calibration, greedy, ordered, rules, windows
from airlens.operators.unit import UNIT, with_unit
from airlens.plans.oracle import CALIB_MS, CTES
from airlens.plans.queries import ELASTIC_SQL, packets
from airlens.plans.registry import query

_HOST = "concat('02:00:00:00:01:0', capture_id)"
# The packets with the unit in place of the capture, so that every statement on them is one per unit.
BY_BOOT = {"packets": f"select * replace (concat(capture_id, ' | ', {_HOST}, ' | ', pkt_id // 4000 + 1) as capture_id) from ({CTES['packets']})"}


def booted_packets(spark: SparkSession, d: str) -> DataFrame:
    """Packets with device, boot as found from the clock, and the unit of all three."""
    p = ordered.align_clock(packets(spark, d).withColumn("host_mac", F.expr(_HOST)))
    return with_unit(p)


def booted_windows(spark: SparkSession, d: str) -> DataFrame:
    from airlens.plans.queries import quiet

    return quiet(windows.aggregate_windows(booted_packets(spark, d), key=UNIT))


@query("calibrated_alerts_by_boot", "select capture_id as unit, window_us, raw_pred, calib, calib_thr, candidate, alert from alerts", BY_BOOT)
def _(spark, d):
    scored = rules.score_tree(booted_windows(spark, d), "deployed")
    out = calibration.calibrated_alerts(scored, key=UNIT, calib_ms=CALIB_MS)
    return out.select(UNIT, "window_us", "raw_pred", "calib", "calib_thr", "candidate", "alert")


@query("ring_baseline_by_boot", "select capture_id as unit, armed_us, n_samples::int as n_samples, p90, greatest(2 * p90, 1)::double as threshold from rings", BY_BOOT)
def _(spark, d):
    return calibration.ring_baseline(booted_windows(spark, d), key=UNIT, calib_ms=CALIB_MS)


@query("elastic_windows_by_boot", ELASTIC_SQL, BY_BOOT)
def _(spark, d):
    return greedy.elastic_windows(booted_packets(spark, d), key=UNIT).select(
        F.col(UNIT).alias("capture_id"), "start_us", "end_us", "total_packets", "packet_density", "beacon_packets", "deauth_packets",
        "probe_packets", "auth_packets", "deauth_targeted", "seq_jump", "rssi_mean", "snr_mean",
    )


@query("align_clock_by_device", f"select {_HOST} as host_mac, pkt_id, boot_id::bigint as boot_id, min_offset_us, aligned_us from aligned")
def _(spark, d):
    """Two devices share each capture; their clocks are told apart."""
    p = packets(spark, d).withColumn("host_mac", F.expr(_HOST)).withColumn("capture_id", F.floor(F.col("capture_id") / 2))
    out = ordered.align_clock(with_unit(p, ("capture_id", "host_mac")), key=UNIT)
    return out.select("host_mac", "pkt_id", "boot_id", "min_offset_us", "aligned_us")
