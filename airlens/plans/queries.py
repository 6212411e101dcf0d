"""One registered query per operator, over packets derived from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens import adapter
from airlens import schema as S
from airlens.functions import frames, scalars
from airlens.functions.trees import TREES, tree_pred, tree_prob
from airlens.operators import calibration, greedy, labels, metrics, ordered, quality, rules, windows
from airlens.operators.stage import stage
from airlens.plans import split
from airlens.plans.oracle import CALIB_MS, FEATURES, QUIET_US, RELABEL_KEEP_S
from airlens.plans.registry import query
from airlens.sources import captures, telemetry


# ---- shared inputs -------------------------------------------------------------------

def packets(spark: SparkSession, d: str) -> DataFrame:
    return adapter.packets(spark, d)


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    return adapter.lines_of(packets(spark, d))


def windows_of(spark: SparkSession, d: str) -> DataFrame:
    return windows.aggregate_windows(packets(spark, d))


def quiet_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows whose first seconds are idle, so that calibration has something to learn."""
    return quiet(windows_of(spark, d))


def quiet(rows: DataFrame) -> DataFrame:
    early = F.col("window_us") < QUIET_US
    return rows.withColumns({
        "label": F.when(early, 0).otherwise(F.col("label")),
        "attack_type": F.when(early, "NONE").otherwise(F.col("attack_type")),
    })


def scored_windows(spark: SparkSession, d: str) -> DataFrame:
    scored = rules.score_tree(quiet_windows(spark, d), "deployed")
    return rules.score_tree(scored, "phase_a", "host_prob", "host_pred")


def tree_scores(spark: SparkSession, d: str) -> DataFrame:
    each = F.array(*[
        F.struct(F.lit(n).alias("tree"), tree_prob(t).alias("score"), tree_pred(t).alias("pred")) for n, t in TREES.items()
    ])
    w = windows_of(spark, d).withColumn("_x", F.explode(each))
    return w.select("capture_id", "window_us", "label", "attack_type", "_x.*")


def fused_windows(spark: SparkSession, d: str) -> DataFrame:
    w = scored_windows(spark, d)
    either, either_score = rules.or_fusion(*(F.col(c) for c in ("raw_pred", "host_pred", "raw_prob", "host_prob")))
    gated, gated_score = rules.gated_or_fusion(*(F.col(c) for c in ("raw_pred", "raw_prob", "host_prob")))
    return w.withColumns({"or_pred": either, "or_score": either_score, "gated_pred": gated, "gated_score": gated_score})


def alert_windows(spark: SparkSession, d: str) -> DataFrame:
    return calibration.calibrated_alerts(scored_windows(spark, d), calib_ms=CALIB_MS)


def aligned_packets(spark: SparkSession, d: str) -> DataFrame:
    return ordered.align_clock(packets(spark, d))


def spans(spark: SparkSession, d: str) -> DataFrame:
    return stage(labels.control_to_spans(adapter.control_of(packets(spark, d))))


def labelled_packets(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_packets(aligned_packets(spark, d), spans(spark, d))


def r6(col: str) -> F.Column:
    return F.round(col, 6).alias(col)


# ---- sources -------------------------------------------------------------------------

@query("latest_capture", f"select capture_id, window_us, label, attack_type, {FEATURES} from windows where capture_id = (select max(capture_id) from windows)")
def _(spark, d):
    return captures.latest_capture(windows_of(spark, d)).select("capture_id", "window_us", "label", "attack_type", *S.WINDOW_FEATURES)


def disturbed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows as text, some with impossible signal means, without one feature."""
    shift = F.when(F.col("window_us") % 300000 == 0, 100.0).otherwise(0.0)
    mirrored = F.when(F.col("window_us") % 600000 == 0, F.col("rssi_mean") + 100.0).otherwise(F.col("snr_mean"))
    text = windows_of(spark, d).withColumns({"rssi_mean": F.col("rssi_mean") + shift, "snr_mean": mirrored})
    return text.drop("backlog").withColumns({c: F.col(c).cast("string") for c in S.WINDOW_FEATURES if c != "backlog"})


@query("cleaning_counts", """
select count(*) as n_windows, count(*) filter (bad) as n_rf_bad, count(*) filter (bad and abs(snr_mean - rssi_mean) <= 1e-6) as n_rf_mirror
from (select *, rssi_mean > 0 or rssi_mean < -100 as bad from (
select rssi_mean + case when window_us % 300000 = 0 then 100 else 0 end as rssi_mean, case when window_us % 600000 = 0 then rssi_mean + 100 else snr_mean end as snr_mean from windows))""")
def _(spark, d):
    return quality.cleaning_counts(captures.prepare_windows(disturbed_windows(spark, d)))


@query("default_attack_type", "select capture_id, window_us, label, 'NONE' as attack_type from windows")
def _(spark, d):
    """Windows of a set without the column."""
    return captures.prepare_windows(windows_of(spark, d).drop("attack_type")).select("capture_id", "window_us", "label", "attack_type")


@query("type_counts", "select attack_type, count(*) as n_windows from windows group by 1")
def _(spark, d):
    return quality.type_counts(windows_of(spark, d))


@query("prepare_windows", f"""
select capture_id, window_us, label, attack_type, {", ".join(f for f in S.WINDOW_FEATURES if f not in ("rssi_mean", "rssi_var", "snr_mean", "backlog"))},
 0::double as backlog, rssi_mean > 0 or rssi_mean < -100 as rf_bad,
 case when rssi_mean > 0 or rssi_mean < -100 then 0 else rssi_mean end as rssi_mean,
 case when rssi_mean > 0 or rssi_mean < -100 then 0 else rssi_var end as rssi_var,
 case when (rssi_mean > 0 or rssi_mean < -100) and abs(snr_mean - rssi_mean) <= 1e-6 then 0 else snr_mean end as snr_mean
from (select * replace (rssi_mean + case when window_us % 300000 = 0 then 100 else 0 end as rssi_mean,
 case when window_us % 600000 = 0 then rssi_mean + 100 else snr_mean end as snr_mean) from windows)""")
def _(spark, d):
    text = disturbed_windows(spark, d)
    return captures.prepare_windows(text).select("capture_id", "window_us", "label", "attack_type", *S.WINDOW_FEATURES, "rf_bad")


_STATUS = """case when pkt_id % 10 in (3, 5) then 'lenient' when pkt_id % 10 = 4 then 'reject' else 'strict' end"""
_FULL = "pkt_id % 10 not in (1, 2, 3, 4, 5)"


@query("parse_telemetry", f"""
select capture_id, pkt_id, {_STATUS} as status, pkt_id % 10 in (3, 5) as truncated, '45917' as pen, subtype,
 case when pkt_id % 10 = 5 then '-1' else rssi::int::varchar end as rssi, snr::int::varchar as snr, heap::varchar as heap,
 case when pkt_id % 10 in (3, 5) then '0' else uptime_ms::varchar end as uptime,
 case when {_FULL} then label::varchar else '' end as pred_attack,
 case when {_FULL} then label::varchar else '' end as pred_raw, case when {_FULL} then '18.0' else '' end as calib_thr,
 case when {_FULL} then seq_jump::varchar when pkt_id % 10 in (3, 5) then '0' else '' end as seq_jump,
 case when {_FULL} then (1 + pkt_id % 30)::varchar else '' end as win_pkts,
 case when {_FULL} or pkt_id % 10 = 2 then gw_mac else '' end as gw_mac,
 case when {_FULL} then gw_flip::varchar else '' end as gw_flip,
 (pkt_id % 9000)::varchar as ipat, seq::varchar as seq, '0' as dropped,
 {", ".join(f"case when pkt_id % 10 in (3, 5) then '0' else {c}::varchar end as {c}" for c in ("minheap", "reconn", "qpeak", "udpfail", "backlog"))},
 case when {_FULL} or pkt_id % 10 = 2 then concat('02:00:00:00:01:0', capture_id) else '' end as host_mac,
 case when {_FULL} then deauth_tgt::varchar when pkt_id % 10 in (3, 5) then '0' else '' end as deauth_tgt,
 case when {_FULL} then '11:22:33:44:55:66' else '' end as ap_bssid, case when {_FULL} or pkt_id % 10 = 2 then (1 + pkt_id % 13)::varchar else '' end as channel,
 case when {_FULL} then ((1 + pkt_id % 30) * 10)::varchar else '' end as win_dens, case when {_FULL} then 'ARMED' else '' end as calib
from packets where pkt_id % 10 <> 4""")
def _(spark, d):
    parsed = telemetry.parse_telemetry(text_lines(spark, d))
    return telemetry.accepted_lines(parsed).select(
        "capture_id", "pkt_id", "status", "truncated", "pen", "subtype", "rssi", "snr", "heap", "uptime", "pred_attack",
        "pred_raw", "calib_thr", "seq_jump", "win_pkts", "gw_mac", "gw_flip", "ipat", "seq", "dropped", "minheap", "reconn", "qpeak",
        "udpfail", "backlog", "host_mac", "deauth_tgt", "ap_bssid", "channel", "win_dens", "calib",
    )


@query("reject_lines", "select capture_id, pkt_id, value as raw, 'cut before heap' as reason from lines where pkt_id % 10 = 4")
def _(spark, d):
    parsed = telemetry.parse_telemetry(text_lines(spark, d))
    return telemetry.reject_lines(parsed).select("capture_id", "pkt_id", "raw", "reason")


@query("parse_control", "select capture_id, arrival_us, seq_no, status, kind as attack_type from messages")
def _(spark, d):
    control = adapter.control_of(packets(spark, d))
    ends = F.when(F.col("seq_no") % 3 == 0, "\r\n").when(F.col("seq_no") % 3 == 1, "\n").otherwise("")
    return labels.parse_control(control.withColumn("payload", F.concat("payload", ends))).select(
        "capture_id", "arrival_us", "seq_no", "status", "attack_type"
    )


DEVICE_STATE_SQL = """
select case when pkt_id % 10 in (1, 3, 5) then '' else concat('02:00:00:00:01:0', capture_id) end as host_mac,
 arg_max(concat('10.0.', capture_id, '.', pkt_id % 250), sent_at) as source_ip,
 arg_max('11:22:33:44:55:66', case when pkt_id % 10 not in (1, 2, 3, 5) then sent_at end) as ap_bssid,
 arg_max((1 + pkt_id % 13)::varchar, case when pkt_id % 10 not in (1, 3, 5) then sent_at end) as channel, max(arrival_us) as updated_us
from (select *, arrival_us::hugeint * 1000000000 + pkt_id as sent_at from packets where pkt_id % 10 <> 4) group by 1"""


def addressed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("source_ip", F.concat(F.lit("10.0."), F.col("capture_id").cast("string"), F.lit("."), (F.col("pkt_id") % 250).cast("string")))


@query("device_state", DEVICE_STATE_SQL)
def _(spark, d):
    return captures.device_state(telemetry.accepted_lines(telemetry.parse_telemetry(addressed(text_lines(spark, d)))))


# ---- scalar functions ----------------------------------------------------------------

@query("to_float", """
select pkt_id, coalesce(try_cast(case when pkt_id % 5 = 0 then 'x' when pkt_id % 5 = 1 then '' else rssi::varchar end as double), 0) as rssi,
 (label > 0)::int as label from packets""")
def _(spark, d):
    text = F.when(F.col("pkt_id") % 5 == 0, "x").when(F.col("pkt_id") % 5 == 1, "").otherwise(F.concat(F.lit(" "), F.col("rssi").cast("string")))
    return packets(spark, d).select(
        "pkt_id", scalars.to_float(text).alias("rssi"), scalars.normalize_label(F.col("label").cast("string")).alias("label")
    )


@query("rf_valid", "select capture_id, count(*) filter (rssi between -100 and 0) as valid, count(*) filter (not rssi between -100 and 0) as dirty from packets group by 1")
def _(spark, d):
    ok = scalars.rf_valid(F.col("rssi"))
    return packets(spark, d).groupBy("capture_id").agg(F.count(F.when(ok, 1)).alias("valid"), F.count(F.when(~ok, 1)).alias("dirty"))


@query("subtype_class", """
select capture_id, case when subtype = 'BEACON' then 'beacon' when subtype in ('DEAUTH','DISASSOC') then 'deauth'
 when subtype like 'PROBE%' then 'probe' when subtype = 'AUTH' then 'auth' else 'other' end as frame_class, count(*) as n from packets group by 1, 2""")
def _(spark, d):
    return packets(spark, d).groupBy("capture_id", scalars.subtype_class(F.col("subtype")).alias("frame_class")).agg(F.count(F.lit(1)).alias("n"))


@query("decode_frames", """
select p.capture_id, p.pkt_id,
 case when subtype <> '' or pkt_id % 2 = 1 then 'MGMT' else 'DATA' end as frame_type,
 case when subtype <> '' then subtype when pkt_id % 2 = 0 then '' else 'MGMT_OTHER' end as subtype,
 case when frame_len < 16 then '00:00:00:00:00:00' when deauth_tgt = 0 then '0A:00:00:00:00:99' when pkt_id % 4 = 0 then 'FF:FF:FF:FF:FF:FF'
  else concat('02:00:00:00:01:0', capture_id) end as dst_mac,
 case when frame_len < 16 then '00:00:00:00:00:00' else src_mac end as src_mac,
 case when frame_len >= 24 then seq else 0 end as seq,
 case when frame_len >= 16 and deauth_tgt = 1 then 1 else 0 end as deauth_tgt from packets p""")
def _(spark, d):
    out = frames.decode_frames(adapter.frames_of(packets(spark, d)))
    return out.select("capture_id", "pkt_id", "frame_type", "subtype", "dst_mac", "src_mac", F.col("seq").cast("bigint").alias("seq"), "deauth_tgt")


@query("deauth_targeted", """
select capture_id, count(*) filter (subtype in ('DEAUTH','DISASSOC') and src_mac in ('02:00:00:00:00:12', '02:00:00:00:00:14')) as targeted from packets group by 1""")
def _(spark, d):
    dst = F.when(F.col("src_mac") == "02:00:00:00:00:12", "ff:ff:ff:ff:ff:ff").otherwise(F.col("src_mac"))
    hit = scalars.deauth_targeted(F.col("subtype"), dst, F.lit("02:00:00:00:00:14"))
    return packets(spark, d).groupBy("capture_id").agg(F.sum(hit.cast("bigint")).alias("targeted"))


@query("snr", "select pkt_id, rssi + 95 as snr from packets")
def _(spark, d):
    return packets(spark, d).select("pkt_id", scalars.snr(F.col("rssi"), F.lit(-95.0)).alias("snr"))


@query("drop_bad_time", """
select capture_id, count(*) filter (pkt_id % 7 > 1) as kept, count(*) filter (pkt_id % 7 <= 1) as dropped,
 coalesce(sum(gen_us) filter (pkt_id % 7 > 1), 0)::double as time_sum from packets group by 1""")
def _(spark, d):
    iso = F.date_format(F.timestamp_micros("gen_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(F.col("pkt_id") % 7 == 0, "").when(F.col("pkt_id") % 7 == 1, "soon").otherwise(iso)
    typed = packets(spark, d).select("capture_id", scalars.parse_time_us(text).alias("gen_us"))
    kept = captures.drop_bad_time(typed).groupBy("capture_id").agg(F.sum(F.col("gen_us").cast("decimal(20,0)")).cast("double").alias("time_sum"))
    return captures.bad_time_counts(typed).join(kept, "capture_id")


@query("elapsed_seconds", "select capture_id, window_us, (window_us - min(window_us) over (partition by capture_id)) / 1e6::double as elapsed_s from windows")
def _(spark, d):
    return ordered.elapsed_seconds(windows_of(spark, d).select("capture_id", "window_us"))


_HOST = ", ".join(S.HIDS)


@query("neutralize", f"""
select capture_id, window_us, is_test, {", ".join(f"(select coalesce(quantile_cont({c}, 0.5), 0) from split where not is_test and label = 0) as {c}" for c in (*S.HIDS, *S.RF_SOFT))}
from split""")
def _(spark, d):
    w = split.stratified_split(stage(windows_of(spark, d)))
    out, _fills = split.neutralize(w, (*S.HIDS, *S.RF_SOFT))
    return out.select("capture_id", "window_us", "is_test", *S.HIDS, *S.RF_SOFT)


# ---- ordered operators ---------------------------------------------------------------

@query("inter_arrival", """
select capture_id, pkt_id, coalesce(case when t < p then 0 else t - p end, 0) as ipat from (
select capture_id, pkt_id, t, lag(t) over (partition by capture_id order by pkt_id) as p from (
select *, gen_us - case when pkt_id % 50 = 0 then 1000000 else 0 end as t from packets))""")
def _(spark, d):
    p = packets(spark, d).select("capture_id", "pkt_id", (F.col("gen_us") - F.when(F.col("pkt_id") % 50 == 0, 1000000).otherwise(0)).alias("t"))
    return ordered.inter_arrival(p, time="t").select("capture_id", "pkt_id", "ipat")


@query("seq_jumps", """
select capture_id, pkt_id, case when frame_len >= 24 and d > 64 and d < 4032 then 1 else 0 end as seq_jumped from (
select *, (seq - last_value(case when frame_len >= 24 then seq end ignore nulls) over (partition by capture_id order by pkt_id
 rows between unbounded preceding and 1 preceding) + 4096) % 4096 as d from packets)""")
def _(spark, d):
    return ordered.seq_jumps(packets(spark, d)).select("capture_id", "pkt_id", "seq_jumped")


@query("detect_boots", "select capture_id, boot_id::bigint as boot_id, min(arrival_us) as first_us, count(*) as n_lines from boots group by 1, 2")
def _(spark, d):
    return aligned_packets(spark, d).groupBy("capture_id", "boot_id").agg(
        F.min("arrival_us").alias("first_us"), F.count(F.lit(1)).alias("n_lines")
    )


@query("align_clock", "select capture_id, pkt_id, boot_id::bigint as boot_id, min_offset_us, aligned_us from aligned")
def _(spark, d):
    return aligned_packets(spark, d).select("capture_id", "pkt_id", "boot_id", "min_offset_us", "aligned_us")


@query("control_to_spans", "select capture_id, start_us, coalesce(end_us, -1) as end_us, coalesce(valid_until_us, -1) as valid_until_us, attack_type, state from spans")
def _(spark, d):
    known = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return spans(spark, d).select("capture_id", "start_us", known("end_us"), known("valid_until_us"), "attack_type", "state")


@query("gateway_mac_flips", """
select capture_id, conn, pkt_id, coalesce(sum(f) over (partition by capture_id, conn order by arrival_us, pkt_id), 0)::bigint as flips from (
select *, case when m is not null and m <> last_value(m ignore nulls) over (partition by capture_id, conn order by arrival_us, pkt_id
 rows between unbounded preceding and 1 preceding) then 1 else 0 end as f from (
select *, pkt_id // 3000 as conn, case when gw_mac not in ('', '-', '00:00:00:00:00:00') then gw_mac end as m from packets))""")
def _(spark, d):
    p = packets(spark, d).select("capture_id", "pkt_id", "arrival_us", "gw_mac", F.floor(F.col("pkt_id") / 3000).alias("conn"))
    return ordered.gateway_flips(p, ("capture_id", "conn")).select("capture_id", "conn", "pkt_id", "flips")


@query("thin", """
select capture_id, pkt_id from (select capture_id, pkt_id, row_number() over (partition by capture_id order by gen_us, pkt_id) as rn from packets) where rn % 50 = 0""")
def _(spark, d):
    return ordered.thin(packets(spark, d), 50).select("capture_id", "pkt_id")


@query("busy_peak", "select capture_id, peak_us from peaks")
def _(spark, d):
    return ordered.busy_peak(quiet_windows(spark, d))


@query("busy_windows", """
select e.capture_id, e.window_us, p.peak_us, e.packet_density from early e join peaks p on e.capture_id = p.capture_id
 where abs(e.window_us - p.peak_us) <= 3000000""")
def _(spark, d):
    return ordered.busy_windows(quiet_windows(spark, d), around_us=3_000_000).select("capture_id", "window_us", "peak_us", "packet_density")


@query("attack_spans", """
select capture_id, start_us, coalesce(lead_us, last_us) as end_us, n_windows from (
select *, lead(start_us) over (partition by capture_id order by start_us) as lead_us from (
select capture_id, label, min(window_us) as start_us, max(window_us) as last_us, count(*) as n_windows from (
select capture_id, window_us, label, row_number() over (partition by capture_id order by window_us)
 - row_number() over (partition by capture_id, label order by window_us) as isle from windows) group by capture_id, label, isle)) where label = 1""")
def _(spark, d):
    return ordered.attack_spans(windows_of(spark, d))


@query("streak_latch", """
select capture_id, window_us, coalesce(last_value(ev ignore nulls) over (partition by capture_id order by window_us rows unbounded preceding), 0) as alert from (
select *, case when c = 1 and run >= case when deauth_packets > 1.5 then 1 else 3 end then 1 when c = 0 and run >= 2 then 0 end as ev from (
select *, row_number() over (partition by capture_id, c, isle order by window_us) as run from (
select *, row_number() over (partition by capture_id order by window_us) - row_number() over (partition by capture_id, c order by window_us) as isle
from (select *, (total_packets > 4)::int as c from windows))))""")
def _(spark, d):
    need = F.when(F.col("deauth_packets") > 1.5, 1).otherwise(3)
    return calibration.streak_latch(windows_of(spark, d), F.col("total_packets") > 4, need).select("capture_id", "window_us", "alert")


@query("relabel_missed_stop", f"""
select p.capture_id, p.pkt_id, case when late then 0 else label end as label, case when late then 'NONE' else attack_type end as attack_type from (
select *, coalesce(attack_type = 'SYN_FLOOD' and label = 1 and gen_us - arg_min(gen_us, pkt_id) filter (attack_type = 'SYN_FLOOD' and label = 1)
 over (partition by capture_id) > {int(RELABEL_KEEP_S * 1e6)}, false) as late from packets) p""")
def _(spark, d):
    return labels.relabel_missed_stop(packets(spark, d), keep_seconds=RELABEL_KEEP_S).select("capture_id", "pkt_id", "label", "attack_type")


@query("chronological_prefix", "select capture_id, window_us, idle_no, is_calib from idle_ranks")
def _(spark, d):
    return ordered.chronological_prefix(quiet_windows(spark, d), 0.3).select("capture_id", "window_us", "idle_no", "is_calib")


def actions(spark: SparkSession, d: str) -> DataFrame:
    alerts = stage(alert_windows(spark, d).where("alert = 1").select("capture_id", "window_us"))
    return greedy.throttle_alerts(alerts).select("capture_id", F.col("window_us").alias("action_us"))


@query("throttle_alerts", "select capture_id, action_us from actions")
def _(spark, d):
    return actions(spark, d)


@query("attacker_list", """
select capture_id, src_mac, first_us, place from (
select *, (row_number() over (partition by capture_id order by first_us, src_mac))::int as place from (
select a.capture_id, p.src_mac, min(a.action_us) as first_us from actions a join ranked_packets p
 on a.capture_id = p.capture_id and a.action_us = p.window_us and p.rd = 1 group by 1, 2)) where place <= 16""")
def _(spark, d):
    place = F.struct("gen_us", "pkt_id")
    last = packets(spark, d).groupBy("capture_id", windows.window_of(F.col("gen_us"), S.WINDOW_US).alias("action_us")).agg(
        F.max_by("src_mac", place).alias("src_mac")
    )
    return ordered.attacker_list(actions(spark, d).join(last, ["capture_id", "action_us"]))


# ---- aggregations --------------------------------------------------------------------

@query("aggregate_windows", f"select capture_id, window_us, {FEATURES}, gw_mac_flip, label, attack_type from windows")
def _(spark, d):
    return windows_of(spark, d)


@query("density_contract", "select capture_id, window_us, total_packets, packet_density, density_source from windows")
def _(spark, d):
    return windows.density_contract(packets(spark, d))


@query("density_sources", """
select capture_id, count(*) filter (density_source = 'sensor') as sensor_windows, count(*) filter (density_source = 'rows') as row_windows,
 count(*) filter (density_source = 'sensor') = 0 and count(*) filter (density_source = 'rows') > 0 as legacy_only from windows group by 1""")
def _(spark, d):
    return windows.density_sources(windows.density_contract(packets(spark, d)))


ELASTIC_SQL = """
select capture_id, start_us, end_us, count(*)::double as total_packets,
 count(*) / ((end_us - start_us) / 1e6::double) as packet_density,
 count(*) filter (subtype = 'BEACON')::double as beacon_packets, count(*) filter (subtype in ('DEAUTH','DISASSOC'))::double as deauth_packets,
 count(*) filter (subtype like 'PROBE%')::double as probe_packets, count(*) filter (subtype = 'AUTH')::double as auth_packets,
 count(*) filter (deauth_tgt >= 1)::double as deauth_targeted, count(*) filter (seq_jump >= 1)::double as seq_jump,
 sum(rssi) / count(*) as rssi_mean, sum(snr) / count(*) as snr_mean from (
select p.*, b.t as start_us, b.nxt as end_us from (select *, lead(t) over (partition by capture_id order by t) as nxt,
 row_number() over (partition by capture_id order by t) as b_no from starts) b join packets p on p.capture_id = b.capture_id
 and p.gen_us between b.t and b.nxt
 join (select capture_id, gen_us, min(pkt_id) as head from packets group by 1, 2) h on h.capture_id = p.capture_id and h.gen_us = p.gen_us
where b.nxt is not null and (p.gen_us > b.t or p.pkt_id > h.head or b.b_no = 1) and (p.gen_us < b.nxt or p.pkt_id = h.head))
group by capture_id, start_us, end_us"""


@query("elastic_windows", ELASTIC_SQL)
def _(spark, d):
    return greedy.elastic_windows(packets(spark, d)).select(
        "capture_id", "start_us", "end_us", "total_packets", "packet_density", "beacon_packets", "deauth_packets", "probe_packets",
        "auth_packets", "deauth_targeted", "seq_jump", "rssi_mean", "snr_mean",
    )


@query("signal_moments", """
select capture_id, gen_us - gen_us % 100000 as window_us, count(*) as n, sum(rssi) / count(*) as rssi_mean,
 greatest(sum(rssi * rssi) / count(*) - (sum(rssi) / count(*)) * (sum(rssi) / count(*)), 0) as rssi_var, sum(snr) / count(*) as snr_mean
from packets group by 1, 2""")
def _(spark, d):
    return windows.signal_moments(packets(spark, d))


@query("run_summary", """
select capture_id, count(*) as n_windows, count(*) filter (label = 0) as n_normal, count(*) filter (label = 1) as n_attack,
 min(packet_density) as density_min, max(packet_density) as density_max, round(avg(packet_density), 6) as density_mean,
 count(distinct packet_density) as density_distinct from windows group by 1""")
def _(spark, d):
    return windows.run_summary(windows_of(spark, d)).withColumn("density_mean", F.round("density_mean", 6))


@query("attack_type_counts", "select capture_id, attack_type, count(*) as n_windows from windows where label = 1 group by 1, 2")
def _(spark, d):
    return windows.attack_type_counts(windows_of(spark, d))


@query("majority_type", "select capture_id, window_us, attack_type from windows")
def _(spark, d):
    return windows.majority_type(packets(spark, d))


_GATES = """
select *, bool_and(ok) over (partition by capture_id) as all_ok from (
select capture_id, 'normal_count' as gate, n::double as value, 60::double as "limit", n >= 60 as ok from c union all
select capture_id, 'attack_DEAUTH', de, 40, de >= 40 from c union all select capture_id, 'attack_SYN_FLOOD', sy, 40, sy >= 40 from c union all
select capture_id, 'attack_ARP_SPOOF', ar, 40, ar >= 40 from c union all select capture_id, 'attack_AUTH_FLOOD', au, 40, au >= 40 from c union all
select capture_id, 'not_syn_dominated_ratio', case when n > 0 then a::double / n end, 8, coalesce(a::double / nullif(n, 0) <= 8, false) from c union all
select capture_id, 'syn_share', sy::double / a, 0.7, sy::double / a <= 0.7 from c where a > 0)"""


@query("balance_gates", _GATES.replace("from c", """from (select capture_id, count(*) filter (label = 0) as n, count(*) filter (label = 1) as a,
 count(*) filter (label = 1 and attack_type = 'DEAUTH') as de, count(*) filter (label = 1 and attack_type = 'SYN_FLOOD') as sy,
 count(*) filter (label = 1 and attack_type = 'ARP_SPOOF') as ar, count(*) filter (label = 1 and attack_type = 'AUTH_FLOOD') as au from windows group by 1) c"""))
def _(spark, d):
    return quality.balance_gates(windows_of(spark, d), 60, 40, with_auth=True)


@query("feature_stats", " union all ".join(
    f"select '{f}' as feature, round(avg({f}), 6) as mean, round(stddev_samp({f}), 6) as std, min({f}) as min, max({f}) as max,"
    f" round(avg(({f} = 0)::int), 6) as frac_zero, round(quantile_cont({f}, 0.5), 6) as p50 from windows" for f in S.WINDOW_FEATURES))
def _(spark, d):
    out = quality.feature_stats(windows_of(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "frac_zero", "p50")})


@query("dataset_summary", """
select count(*) as n_windows, count(*) filter (label = 0) as n_normal, count(*) filter (label = 1) as n_attack,
 count(*) filter (label = 1) / count(*)::double as attack_fraction, min(window_us) as first_us, max(window_us) as last_us,
 count(distinct packet_density) as density_distinct,
 (select total_packets from windows group by 1 order by count(*) desc, total_packets limit 1) as total_packets_mode,
 count(distinct packet_density) <= 4 as warn_density_constant, stddev_samp(minheap) < 1e-6 as warn_minheap_constant from windows""")
def _(spark, d):
    return quality.dataset_summary(windows_of(spark, d))


@query("attack_rounds", """
select s.capture_id, s.start_us, s.end_us, s.attack_type, (s.end_us - s.start_us) / 1e6::double as duration_s, count(l.pkt_id) as n_packets
from spans s left join labelled l on s.capture_id = l.capture_id and l.label = 1 and l.arrival_us >= s.start_us and l.arrival_us < s.end_us
where s.state = 'closed' group by s.capture_id, s.start_us, s.end_us, s.attack_type""")
def _(spark, d):
    return labels.attack_rounds(labelled_packets(spark, d), spans(spark, d))


@query("visibility_report", """
select *, max(case when attack_type = 'NONE' then auth_share end) over (partition by capture_id) as idle_auth_share,
 max(case when attack_type = 'NONE' then probe_share end) over (partition by capture_id) as idle_probe_share from (
select capture_id, attack_type, count(*) as n_rows, max(gw_flip) as max_gw_flip, count(*) filter (subtype = 'AUTH') as auth_rows,
 count(*) filter (subtype = 'AUTH') / count(*)::double as auth_share, count(*) filter (subtype like 'PROBE%') / count(*)::double as probe_share
from packets group by 1, 2)""")
def _(spark, d):
    return quality.visibility_report(packets(spark, d))


_SEG = """
from (select q.*, e.p80, e.p90, f.first_us, p.peak_us from scored q
 left join (select capture_id, quantile_cont(packet_density, 0.8) as p80, quantile_cont(packet_density, 0.9) as p90 from early group by 1) e on q.capture_id = e.capture_id
 left join (select capture_id, min(window_us) as first_us from quiet where label = 1 group by 1) f on q.capture_id = f.capture_id
 left join peaks p on q.capture_id = p.capture_id)"""
_SEGMENTS = " union all ".join(
    f"select capture_id, '{n}' as segment, raw_pred, host_pred, packet_density, udpfail {_SEG} where {c}" for n, c in (
        ("all_NORMAL", "label = 0"), ("pre_attack_NORMAL", "label = 0 and window_us < first_us"),
        ("pre_dens_p80", "label = 0 and window_us < first_us and packet_density >= p80"),
        ("pre_dens_p90", "label = 0 and window_us < first_us and packet_density >= p90"),
        ("BUSY_peak_pm90s", "label = 0 and window_us < first_us and abs(window_us - peak_us) <= 90000000"),
    )) + f" union all select capture_id, attack_type, raw_pred, host_pred, packet_density, udpfail {_SEG} where label = 1"


@query("segment_rates", f"""
select capture_id, segment, count(*) as n, round(avg(raw_pred), 6) as deployed_rate, round(avg(host_pred), 6) as host_rate,
 round(quantile_cont(packet_density, 0.5), 6) as packet_density_median, round(quantile_cont(udpfail, 0.5), 6) as udpfail_median
from ({_SEGMENTS}) group by 1, 2""")
def _(spark, d):
    out = rules.segment_rates(scored_windows(spark, d), {"deployed_rate": "raw_pred", "host_rate": "host_pred"})
    return out.withColumns({c: F.round(c, 6) for c in ("deployed_rate", "host_rate", "packet_density_median", "udpfail_median")})


@query("idle_baseline", """
select capture_id, n_idle, round(total_mean, 6) as total_mean, n_calib, round(total_p90, 6) as total_p90, round(calib_p50, 6) as calib_p50,
 round(calib_p90, 6) as calib_p90, round(threshold, 6) as threshold from baseline""")
def _(spark, d):
    out = calibration.idle_baseline(quiet_windows(spark, d))
    return out.select("capture_id", "n_idle", r6("total_mean"), "n_calib", r6("total_p90"), r6("calib_p50"), r6("calib_p90"), r6("threshold"))


@query("ring_baseline", "select capture_id, armed_us, n_samples::int as n_samples, p90, greatest(2 * p90, 1)::double as threshold from rings")
def _(spark, d):
    return calibration.ring_baseline(quiet_windows(spark, d), calib_ms=CALIB_MS)


@query("class_counts", "select capture_id, count(*) as n, count(*) filter (label = 1) as n_pos, count(*) filter (label = 0) as n_neg from windows group by 1")
def _(spark, d):
    return quality.class_counts(windows_of(spark, d), "capture_id")


# ---- joins, sets, order --------------------------------------------------------------

@query("label_packets", "select capture_id, pkt_id, aligned_us, label, attack_type from labelled")
def _(spark, d):
    return labelled_packets(spark, d).select("capture_id", "pkt_id", "aligned_us", "label", "attack_type")


@query("join_thresholds", "select q.capture_id, window_us, total_packets, round(threshold, 6) as threshold from quiet q left join baseline b on q.capture_id = b.capture_id")
def _(spark, d):
    w = stage(quiet_windows(spark, d))
    return calibration.join_thresholds(w, calibration.idle_baseline(w)).select("capture_id", "window_us", "total_packets", r6("threshold"))


@query("join_fills", "select capture_id, window_us, (select coalesce(quantile_cont(heap, 0.5), 0) from windows where label = 0) as heap from windows")
def _(spark, d):
    w = windows_of(spark, d)
    return split.join_fills(w, split.normal_medians(w, ["heap"])).select("capture_id", "window_us", "heap")


@query("compare_experts", """
select capture_id, count(*) filter (raw_pred = 1 and host_pred = 1) as both_attack, count(*) filter (raw_pred = 1 and host_pred <> 1) as only_w,
 count(*) filter (raw_pred <> 1 and host_pred = 1) as only_h, count(*) as n from scored group by 1""")
def _(spark, d):
    return rules.compare_experts(scored_windows(spark, d), "raw_pred", "host_pred", "capture_id")


@query("union_captures", "select capture_id, window_us, total_packets, label from windows")
def _(spark, d):
    w = windows_of(spark, d).select("capture_id", "window_us", "total_packets", "label")
    return windows.union_captures(w.where("capture_id < 4"), w.where("capture_id >= 4"))


@query("order_windows", "select capture_id, window_us, total_packets from windows order by capture_id, window_us")
def _(spark, d):
    return windows.order_windows(windows_of(spark, d).select("capture_id", "window_us", "total_packets"))


@query("top_k", "select capture_id, attack_type, n_windows from (select capture_id, attack_type, count(*) as n_windows from windows where label = 1 group by 1, 2) order by n_windows desc, capture_id, attack_type limit 6")
def _(spark, d):
    counts = windows.attack_type_counts(windows_of(spark, d))
    return counts.orderBy(F.desc("n_windows"), "capture_id", "attack_type").limit(6)


# ---- rules ---------------------------------------------------------------------------

@query("score_tree", "select capture_id, window_us, tree, score, pred from tree_scores")
def _(spark, d):
    return tree_scores(spark, d).select("capture_id", "window_us", "tree", "score", "pred")


@query("absolute_detector", "select capture_id, window_us, absolute from detected")
def _(spark, d):
    return quiet_windows(spark, d).select("capture_id", "window_us", rules.absolute_detector().alias("absolute"))


@query("relative_detector", "select capture_id, window_us, relative from detected")
def _(spark, d):
    w = stage(quiet_windows(spark, d))
    judged = calibration.join_thresholds(w, calibration.idle_baseline(w))
    return judged.select("capture_id", "window_us", rules.relative_detector(F.col("threshold")).alias("relative"))


@query("detector_report", " union all ".join(
    f"select capture_id, '{n}' as detector, round(avg({n}) filter (label = 0), 6) as fpr_all_none, round(avg({n}) filter (held), 6) as fpr_holdout_none,"
    + ", ".join(f" round(avg({n}) filter (attack_type = '{t}'), 6) as {c}" for c, t in rules.REPORTED_TYPES.items())
    + " from detected group by capture_id" for n in ("absolute", "relative")))
def _(spark, d):
    out = rules.detector_report(quiet_windows(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("fpr_all_none", "fpr_holdout_none", *rules.REPORTED_TYPES)})


@query("calibrated_alerts", "select capture_id, window_us, raw_pred, calib, calib_thr, candidate, alert from alerts")
def _(spark, d):
    return alert_windows(spark, d).select("capture_id", "window_us", "raw_pred", "calib", "calib_thr", "candidate", "alert")


@query("veto_report", "select calib, attack_type, count(*) as n_vetoed from alerts where raw_pred = 1 and alert = 0 group by 1, 2")
def _(spark, d):
    return calibration.veto_report(alert_windows(spark, d))


@query("or_fusion", "select capture_id, window_us, or_pred, or_score from fused")
def _(spark, d):
    return fused_windows(spark, d).select("capture_id", "window_us", "or_pred", "or_score")


@query("gated_or_fusion", "select capture_id, window_us, gated_pred, gated_score from fused")
def _(spark, d):
    return fused_windows(spark, d).select("capture_id", "window_us", "gated_pred", "gated_score")


# ---- metrics and splits --------------------------------------------------------------

def _metric_sql(by: str, source: str, label: str = "label", pred: str = "pred") -> str:
    return f"""
select *, coalesce(tp / nullif(tp + fp, 0)::double, 0) as precision, coalesce(tp / nullif(tp + fn, 0)::double, 0) as recall,
 coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0) as f1, coalesce(fp / nullif(fp + tn, 0)::double, 0) as fpr,
 (tp + tn) / (tp + fp + fn + tn)::double as accuracy, coalesce(tn / nullif(tn + fn, 0)::double, 0) as precision_0,
 coalesce(tn / nullif(tn + fp, 0)::double, 0) as recall_0, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0)::double, 0) as f1_0,
 tp + fn as support_1, tn + fp as support_0 from (
select {by} count(*) filter ({label} = 1 and {pred} = 1) as tp, count(*) filter ({label} = 0 and {pred} = 1) as fp,
 count(*) filter ({label} = 1 and {pred} = 0) as fn, count(*) filter ({label} = 0 and {pred} = 0) as tn from {source} {"group by 1" if by else ""})"""


@query("binary_metrics", _metric_sql("tree,", "tree_scores"))
def _(spark, d):
    return metrics.binary_metrics(tree_scores(spark, d), by=("tree",))


@query("binary_metrics_labels", _metric_sql("", "labels", "quality", "toxic"))
def _(spark, d):
    return metrics.binary_metrics(spark.read.parquet(f"{d}/labels.parquet"), "quality", "toxic")


@query("per_attack_recall", "select tree, attack_type, count(*) as n, round(avg(pred), 6) as recall from tree_scores where attack_type not in ('', 'NONE', 'nan') group by 1, 2")
def _(spark, d):
    return metrics.per_attack_recall(tree_scores(spark, d), by=("tree",)).withColumn("recall", F.round("recall", 6))


_BELOW = """
select tree, score, pos, neg, sum(neg) over (partition by tree order by score) - neg as below, sum(pos) over (partition by tree) as p,
 sum(neg) over (partition by tree) as n, sum(pos) over (partition by tree order by score desc) as pos_up, sum(neg) over (partition by tree order by score desc) as neg_up
from (select tree, score, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg from tree_scores group by 1, 2)"""


@query("roc_auc", f"select tree, max(p)::bigint as n_pos, max(n)::bigint as n_neg, round(sum(pos * (below + neg / 2.0::double)) / (max(p) * max(n)), 6) as auc from ({_BELOW}) group by 1")
def _(spark, d):
    return metrics.roc_auc(tree_scores(spark, d), by=("tree",)).withColumn("auc", F.round("auc", 6))


@query("roc_curve", f"select tree, score as threshold, round(pos_up / p, 6) as tpr, round(neg_up / n, 6) as fpr from ({_BELOW})")
def _(spark, d):
    out = metrics.roc_curve(tree_scores(spark, d), by=("tree",))
    return out.withColumns({"tpr": F.round("tpr", 6), "fpr": F.round("fpr", 6)})


@query("stratified_split", "select capture_id, window_us, label, is_test from split")
def _(spark, d):
    return split.stratified_split(stage(windows_of(spark, d))).select("capture_id", "window_us", "label", "is_test")


@query("stratified_folds", """
select capture_id, window_us, label, case when k <= floor(n / 3.0::double + 0.5) then 0 when k <= floor(n * 2 / 3.0::double + 0.5) then 1 else 2 end as fold from (
select *, row_number() over (partition by label order by h) as k, count(*) over (partition by label) as n from split)""")
def _(spark, d):
    return split.stratified_folds(stage(windows_of(spark, d))).select("capture_id", "window_us", "label", "fold")


@query("balanced_weights", "select capture_id, window_us, label, count(*) over () / (2.0::double * count(*) over (partition by label)) as weight from windows")
def _(spark, d):
    return split.balanced_weights(windows_of(spark, d)).select("capture_id", "window_us", "label", "weight")


def shipped_rule_recall(spark: SparkSession, d: str) -> DataFrame:
    """Which attack types does the deployed rule catch?"""
    scored = rules.score_tree(windows_of(spark, d), "deployed")
    return metrics.per_attack_recall(scored, pred="raw_pred")
