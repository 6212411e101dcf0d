"""Column contracts: packet captures, window rows, named feature sets, limits."""

from __future__ import annotations

from pyspark.sql import types as T

# The column order of a raw packet capture file.
RAW_PACKET_COLUMNS = (
    "pen", "subtype", "rssi", "snr", "ipat", "seq", "heap", "minheap",
    "uptime", "reconn", "qpeak", "udpfail", "backlog", "dropped",
    "host_mac", "pred_attack", "pred_raw", "calib", "calib_thr",
    "deauth_tgt", "seq_jump", "ap_bssid", "channel", "win_pkts", "win_dens",
    "gw_mac", "gw_flip", "label", "attack_type", "timestamp",
)

# Keys of a telemetry line, in line order.
TELEMETRY_REQUIRED = (
    "pen", "subtype", "rssi", "snr", "ipat", "seq", "heap", "minheap",
    "uptime", "reconn", "qpeak", "udpfail", "backlog", "dropped",
)
TELEMETRY_OPTIONAL = (
    "host_mac", "attack", "deauth_tgt", "seq_jump", "ap_bssid", "channel",
    "win_pkts", "win_dens", "pred", "calib", "thr", "gw_mac", "gw_flip",
)
# Keys whose missing value is "" (all others default to "0").
TELEMETRY_TEXT_KEYS = (
    "subtype", "host_mac", "attack", "ap_bssid", "channel", "win_pkts",
    "win_dens", "pred", "calib", "thr", "gw_mac", "gw_flip",
)
# Telemetry key -> capture column, where the two differ.
TELEMETRY_RENAMES = {"attack": "pred_attack", "pred": "pred_raw", "thr": "calib_thr"}

# The window feature contract, in model input order.
WINDOW_FEATURES = (
    "total_packets", "packet_density", "beacon_packets", "deauth_packets",
    "deauth_targeted", "probe_packets", "auth_packets", "seq_jump",
    "rssi_mean", "rssi_var", "snr_mean", "heap", "minheap", "reconn",
    "qpeak", "udpfail", "backlog",
)
SIDECAR_FEATURES = ("gw_mac_flip",)

# Named feature sets.
NIDS_ONLY = WINDOW_FEATURES[:11]
NIDS_COUNTS = WINDOW_FEATURES[:8]
RF_SOFT = ("rssi_mean", "rssi_var", "snr_mean")
WIDS_P0 = ("deauth_targeted", "seq_jump")
NIDS_BASELINE = tuple(f for f in NIDS_ONLY if f not in WIDS_P0)
HIDS = ("heap", "minheap", "reconn", "qpeak", "udpfail", "backlog")
HIDS_NO_HEAP = HIDS[1:]
NO_HEAP = tuple(f for f in WINDOW_FEATURES if f != "heap")

# Acceptance limits of a training set.
REQUIRED_ATTACK_TYPES = ("DEAUTH", "SYN_FLOOD", "ARP_SPOOF")
OPTIONAL_ATTACK_TYPES = ("AUTH_FLOOD",)
MIN_NORMAL_WINDOWS = 200
MIN_WINDOWS_PER_ATTACK = 150
MAX_ATTACK_OVER_NORMAL = 8.0
MAX_SYN_SHARE = 0.70
MAX_HEAP_IMPORTANCE = 0.70

# Valid range of a signal-strength sample, in dBm.
RSSI_VALID_MIN = -100.0
RSSI_VALID_MAX = 0.0

# Site calibration settings.
CALIB_MS = 45_000
CALIB_K = 2.0
CALIB_RING = 128
CALIB_MIN_SAMPLES = 32
CALIB_STREAK = 3
CALIB_DEAUTH_STREAK = 1
CALIB_CLEAR_STREAK = 2
ABSOLUTE_TOTAL_THRESHOLD = 27.5
EXPERT_H_GATE = 0.85

WINDOW_US = 100_000

# Attack-type texts that mean "no attack".
NO_ATTACK = ("", "NONE", "nan")


def raw_packet_schema() -> T.StructType:
    """Every capture column as nullable text; typing happens in ``to_typed``."""
    return T.StructType([T.StructField(c, T.StringType()) for c in RAW_PACKET_COLUMNS])


def packet_fields() -> dict[str, T.DataType]:
    """Types of a packet after coercion (``gen_us`` stands for ``timestamp``)."""
    text = {"pen", "subtype", "host_mac", "calib", "ap_bssid", "channel", "gw_mac", "attack_type"}
    return {
        c: T.StringType() if c in text else T.DoubleType()
        for c in RAW_PACKET_COLUMNS
        if c != "timestamp"
    }


def control_schema() -> T.StructType:
    return T.StructType([
        T.StructField("capture_id", T.StringType()),
        T.StructField("arrival_us", T.LongType()),
        T.StructField("seq_no", T.LongType()),
        T.StructField("payload", T.StringType()),
    ])


WINDOW_OUTPUT_COLUMNS = (
    "capture_id", "window_us", *WINDOW_FEATURES, *SIDECAR_FEATURES, "label", "attack_type",
)
