"""Packet, control, telemetry-line and frame tables derived from ``events``.

Every expression is plain SQL that Spark and DuckDB read alike, so the oracle can use
the same text. ``{str}`` stands for the engine's text type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_US = 1_704_067_200_000_000
PHASE_US = 400_000

_WIN_PKTS = "case when event_id % 6 = 0 then 1 + event_id % 600 else 1 + event_id % 30 end"
_PHASE = f"((event_id*2875 - (event_id*2875) % {PHASE_US})/{PHASE_US})"

PACKET_EXPRS: dict[str, str] = {
    "capture_id": "cast(user_id % 8 as int)",
    "pkt_id": "event_id",
    "gen_us": f"{BASE_US} + event_id*2875 + (event_id*7919) % 5000",
    "arrival_us": f"{BASE_US} + event_id*2875 + (event_id*7919) % 5000 + (event_id*104729) % 3000",
    # The device restarts every 4000 packets.
    "uptime_ms": "60000 + cast(floor((event_id % 4000)*2.875) as bigint)",
    "subtype": "case event_type when 'view' then 'BEACON'"
    " when 'error' then case when event_id % 3 = 0 then 'DISASSOC' else 'DEAUTH' end"
    " when 'click' then case when event_id % 2 = 0 then 'PROBE_REQ' else 'PROBE_RESP' end"
    " when 'signup' then 'AUTH' else '' end",
    "rssi": "cast(-30 - cast(floor(value) as int) % 80 as double)",
    "snr": "cast(65 - cast(floor(value) as int) % 80 as double)",
    "seq": "(event_id*37) % 4096",
    "frame_len": "case when event_id % 10 = 3 then 12 when event_id % 10 = 7 then 20"
    " else 24 + event_id % 200 end",
    "heap": "65000 + (event_id*31) % 4000",
    "minheap": "1080 + event_id % 7",
    "reconn": "cast(floor(event_id/500) as bigint)",
    "qpeak": "event_id % 100",
    "udpfail": "cast(floor(event_id/50) as bigint)",
    "backlog": "event_id % 13",
    "deauth_tgt": "case when event_type = 'error' and event_id % 2 = 0 then 1 else 0 end",
    "seq_jump": "case when event_id % 11 = 0 then 1 else 0 end",
    "gw_mac": "case when event_id % 97 = 0 then '-' when event_id % 200 < 190"
    " then 'AA:00:00:00:00:01' else 'AA:00:00:00:00:02' end",
    "gw_flip": "2*cast(floor(event_id/200) as bigint) + case when event_id % 200 >= 190 then 1 else 0 end",
    "src_mac": "concat('02:00:00:00:00:', cast(10 + event_id % 40 as {str}))",
    "win_pkts": f"case when (user_id % 8) % 2 = 0 then {_WIN_PKTS} end",
    "win_dens": f"case when (user_id % 8) % 2 = 0 then cast({_WIN_PKTS} as double)"
    " * cast(4 + event_id % 12 as double) end",
    "label": f"case when cast({_PHASE} as bigint) % 4 = 0 then 0 else 1 end",
    "attack_type": f"case cast({_PHASE} as bigint) % 4"
    " when 1 then 'DEAUTH' when 2 then 'SYN_FLOOD' when 3 then 'ARP_SPOOF' else 'NONE' end",
}

# START/STOP messages at the phase edges, each sent three times. Every eighth phase loses
# its STOP, every twelfth uses the plain-text form.
CONTROL_EXPRS: dict[str, str] = {
    "capture_id": "capture_id",
    "arrival_us": f"{BASE_US} + phase*{PHASE_US} + msg_no*10000 + case when msg_no >= 3 then 320000 else 0 end",
    "seq_no": "phase*10 + msg_no",
    "payload": "case when msg_no >= 3 and phase % 8 = 7 then 'PING'"
    " when phase % 12 = 5 then case when msg_no < 3 then 'START' else 'STOP' end"
    " when msg_no >= 3 then '{{\"status\":\"STOP\"}}'"
    " when phase % 12 = 10 then '{{\"status\":\"START\"}}'"
    " else concat('{{\"status\":\"START\",\"attack_type\":\"',"
    " case phase % 4 when 1 then 'DEAUTH' when 2 then 'SYN_FLOOD' else 'ARP_SPOOF' end, '\"}}') end",
}

_KV = {
    "subtype": "subtype", "rssi": "cast(cast(rssi as int) as {str})", "snr": "cast(cast(snr as int) as {str})",
    "ipat": "cast(pkt_id % 9000 as {str})", "seq": "cast(seq as {str})", "heap": "cast(heap as {str})",
    "minheap": "cast(minheap as {str})", "uptime": "cast(uptime_ms as {str})", "reconn": "cast(reconn as {str})",
    "qpeak": "cast(qpeak as {str})", "udpfail": "cast(udpfail as {str})", "backlog": "cast(backlog as {str})",
    "dropped": "'0'",
}
_OPTIONAL_KV = {
    "host_mac": "concat('02:00:00:00:01:0', cast(capture_id as {str}))", "attack": "cast(label as {str})",
    "deauth_tgt": "cast(deauth_tgt as {str})", "seq_jump": "cast(seq_jump as {str})",
    "ap_bssid": "'11:22:33:44:55:66'", "channel": "cast(1 + pkt_id % 13 as {str})",
    "win_pkts": "cast(1 + pkt_id % 30 as {str})", "win_dens": "cast((1 + pkt_id % 30)*10 as {str})",
    "pred": "cast(label as {str})", "calib": "'ARMED'", "thr": "'18.0'", "gw_mac": "gw_mac",
    "gw_flip": "cast(gw_flip as {str})",
}


def _line_expr() -> str:
    """Telemetry line; by packet number: complete, short of optional keys, cut, repeated key."""
    def pair(key: str, expr: str) -> str:
        return f"concat(' {key}=\"', {expr}, '\"')"

    required = ", ".join(pair(k, v) for k, v in _KV.items())
    some = ", ".join(pair(k, _OPTIONAL_KV[k]) for k in ("host_mac", "channel", "gw_mac"))
    every = ", ".join(pair(k, v) for k, v in _OPTIONAL_KV.items())
    upto_heap = ", ".join(pair(k, _KV[k]) for k in ("subtype", "rssi", "snr", "ipat", "seq", "heap"))
    upto_seq = ", ".join(pair(k, _KV[k]) for k in ("subtype", "rssi", "snr", "ipat", "seq"))
    head = "'<14>1 - node probe - - [meta@45917'"
    return (
        f"case pkt_id % 10 when 1 then concat({head}, {required}, ']')"
        f" when 2 then concat({head}, {required}, {some}, ']')"
        f" when 3 then concat({head}, {upto_heap}, ' minhe')"
        f" when 4 then concat({head}, {upto_seq})"
        f" when 5 then concat({head}, {upto_heap}, ' rssi=\"-1\"')"
        f" else concat({head}, {required}, {every}, ']') end"
    )


LINE_EXPRS: dict[str, str] = {
    "capture_id": "capture_id", "pkt_id": "pkt_id", "arrival_us": "arrival_us", "value": _line_expr(),
}


def _hex(expr: str, width: int) -> str:
    return f"lpad(hex(cast({expr} as bigint)), {width}, '0')"


_FC0 = (
    "case subtype when 'PROBE_REQ' then 64 when 'PROBE_RESP' then 80 when 'BEACON' then 128"
    " when 'DISASSOC' then 160 when 'AUTH' then 176 when 'DEAUTH' then 192"
    " else case when pkt_id % 2 = 0 then 8 else 0 end end"
)
_DST = (
    "case when deauth_tgt = 1 then case when pkt_id % 4 = 0 then 'FFFFFFFFFFFF' else "
    "concat('02000000010', cast(capture_id as {str})) end else '0A0000000099' end"
)
_SRC = "replace(src_mac, ':', '')"
# Sequence control: 12-bit number shifted left by four, low byte first.
_SEQ_LE = f"concat({_hex('(seq*16) % 256', 2)}, {_hex('floor((seq*16)/256)', 2)})"
_FRAME = f"concat({_hex(_FC0, 2)}, '000000', {_DST}, {_SRC}, '0B0000000001', {_SEQ_LE})"

FRAME_EXPRS: dict[str, str] = {
    "capture_id": "capture_id", "pkt_id": "pkt_id", "frame_len": "frame_len",
    "host_mac": "concat('02:00:00:00:01:0', cast(capture_id as {str}))",
    "frame_hex": f"substr({_FRAME}, 1, cast(2*least(frame_len, 24) as int))",
}


def select_list(exprs: dict[str, str], text_type: str) -> str:
    return ", ".join(f"{e.format(str=text_type)} as {n}" for n, e in exprs.items())


def _select(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e.format(str='string')} as {n}" for n, e in exprs.items()])


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def packets_of(events: DataFrame) -> DataFrame:
    return _select(events, PACKET_EXPRS)


def control_of(packet_df: DataFrame) -> DataFrame:
    phases = (
        packet_df.selectExpr("capture_id", f"cast((pkt_id*2875 - (pkt_id*2875) % {PHASE_US})/{PHASE_US} as bigint) as phase")
        .where("phase % 4 <> 0").distinct()
    )
    return _select(phases.selectExpr("*", "explode(sequence(0, 5)) as msg_no"), CONTROL_EXPRS)


def lines_of(packet_df: DataFrame) -> DataFrame:
    # The one-element generator keeps the long text expression from being repeated in later steps.
    lines = _select(packet_df, LINE_EXPRS).withColumnRenamed("value", "_line")
    return lines.selectExpr("capture_id", "pkt_id", "arrival_us", "explode(array(_line)) as value")


def frames_of(packet_df: DataFrame) -> DataFrame:
    return _select(packet_df, FRAME_EXPRS).selectExpr("*", "unhex(frame_hex) as frame")


def duck_ctes() -> dict[str, str]:
    """The same tables as DuckDB common table expressions."""
    return {
        "packets": f"select {select_list(PACKET_EXPRS, 'varchar')} from events",
        "control": (
            f"select {select_list(CONTROL_EXPRS, 'varchar')} from (select *, unnest([0,1,2,3,4,5]) as msg_no from (select distinct capture_id,"
            f" cast((pkt_id*2875 - (pkt_id*2875) % {PHASE_US})/{PHASE_US} as bigint) as phase from packets) where phase % 4 <> 0)"
        ),
        "lines": f"select {select_list(LINE_EXPRS, 'varchar')} from packets",
        "frames": f"select {select_list(FRAME_EXPRS, 'varchar')} from packets",
    }
