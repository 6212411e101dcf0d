import re

from pyspark.sql import functions as F

from airlens import adapter, schema
from airlens.operators import windows
from airlens.plans import all_queries
from airlens.sources import captures, telemetry

HEAD = '<14>1 - node p - - [meta@45917 subtype="BEACON" rssi="-55" snr="40" ipat="812" seq="17" heap="65000"'
REST = ' minheap="1080" uptime="61000" reconn="0" qpeak="12" udpfail="0" backlog="0" dropped="0"'


def test_telemetry_forms(spark):
    lines = [
        HEAD + REST + ' host_mac="AA" attack="1" pred="0" thr="18.0" gw_flip="3"]', HEAD + REST + "]", HEAD + ' minh',
        HEAD.replace(' heap="65000"', ""), HEAD.replace('"BEACON"', '""') + REST + "]", HEAD + ' rssi="-9"', "nothing", "",
        HEAD.replace('rssi="-55"', 'rssi=""') + REST + "]",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, value string")
    got = telemetry.parse_telemetry(df).orderBy("i").collect()
    assert [r.status for r in got] == ["strict", "strict", "lenient", "reject", "strict", "lenient", "reject", "reject", "lenient"]
    assert (got[0].pred_attack, got[0].pred_raw, got[0].calib_thr, got[0].gw_flip, got[0].pen) == ("1", "0", "18.0", "3", "45917")
    assert (got[1].deauth_tgt, got[1].host_mac, got[1].gw_flip) == ("", "", "")
    assert (got[2].deauth_tgt, got[2].uptime, got[2].gw_mac, got[2].truncated) == ("0", "0", "", True)
    assert got[4].subtype == "" and got[5].rssi == "-9" and got[3].rssi is None and got[8].rssi == ""
    assert telemetry.reject_lines(telemetry.parse_telemetry(df)).count() == 3


def test_capture_files(spark, tmp_path):
    (tmp_path / "c1.csv").write_text("timestamp,subtype,rssi,label\n2024-01-01T00:00:00.05,BEACON,-40,1\n,BEACON,-40,0\nsoon,AUTH,1,0\n")
    (tmp_path / "c2.csv").write_text("subtype,timestamp,win_pkts\nAUTH,1704067200.25,7\nAUTH,1704067200.26,\n")
    (tmp_path / "c3.csv").write_text("subtype,rssi\nAUTH,-5\n")
    (tmp_path / "c4.csv").write_text("")
    typed = captures.to_typed(captures.read_packets(spark, str(tmp_path / "*.csv")))
    assert {r.capture_id for r in typed.select("capture_id").collect()} == {"c1", "c2"}
    assert {r.capture_id: (r.kept, r.dropped) for r in captures.bad_time_counts(typed).collect()} == {"c1": (1, 2), "c2": (2, 0)}
    w = {r.capture_id: r for r in windows.aggregate_windows(captures.drop_bad_time(typed), row_no="row_no").collect()}
    assert (w["c1"].total_packets, w["c1"].rssi_mean, w["c1"].label) == (1, -40, 1)
    assert (w["c2"].total_packets, w["c2"].rssi_mean) == (7, 0) and w["c2"].window_us == 1704067200200000
    assert captures.latest_capture(typed).select("capture_id").distinct().first().capture_id == "c2"


def test_time_sums_beyond_a_long(spark, tmp_path):
    # 7000 times of about 1.7e15 microseconds pass the largest long; the second capture's don't.
    events = spark.range(9900).selectExpr(
        "id as event_id", "timestamp '2024-01-01' as ts", "cast(id >= 9800 as bigint) as user_id", "'view' as event_type", "1.0D as value", "'' as props"
    )
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    time = lambda i: adapter.BASE_US + i * 2875 + i * 7919 % 5000
    want = {}
    for k, ids in enumerate((range(9800), range(9800, 9900))):
        kept = [time(i) for i in ids if i % 7 > 1]
        want[k] = (len(kept), len(ids) - len(kept), float(sum(kept)))
    assert want[0][2] > 2**63 > want[1][2]
    got = all_queries()["drop_bad_time"](spark, str(tmp_path)).collect()
    assert {r.capture_id: (r.kept, r.dropped, r.time_sum) for r in got} == want


def test_row_numbers_follow_the_file(spark, tmp_path):
    n = 4000
    text = "timestamp,pen\n" + "".join(f"2024-01-01T00:00:00,{i}\n" for i in range(n))
    (tmp_path / "one.csv").write_text(text)
    (tmp_path / "two.csv").write_text(text[: len(text) // 3].rsplit("\n", 1)[0] + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        rows = captures.read_packets(spark, str(tmp_path)).select("capture_id", "row_no", F.col("pen").cast("int").alias("i")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for c in ("one", "two"):
        mine = sorted((r.row_no, r.i) for r in rows if r.capture_id == c)
        assert [i for _, i in mine] == list(range(len(mine))) and len({a for a, _ in mine}) == len(mine)


def test_window_file_has_the_fixed_columns(spark, tmp_path):
    p = spark.createDataFrame([("c", 1, 1_704_067_200_000_000, "BEACON", -40.0)], "capture_id string, pkt_id long, gen_us long, subtype string, rssi double")
    captures.write_windows(windows.aggregate_windows(p), str(tmp_path / "w"))
    header = next((tmp_path / "w").glob("*.csv")).read_text().splitlines()[0].split(",")
    assert tuple(header) == ("capture_id", "window_start", *schema.WINDOW_FEATURES, "gw_mac_flip", "label", "attack_type")
    assert captures.read_windows(spark, str(tmp_path / "w")).first().window_us == 1_704_067_200_000_000


def test_device_state_keeps_the_last_access_point(spark):
    rows = [("m", 1, 1, "ap1", "6"), ("m", 2, 2, "", "11"), ("m", 3, 3, "", ""), ("n", 1, 4, "", "")]
    df = spark.createDataFrame(rows, "host_mac string, arrival_us long, pkt_id long, ap_bssid string, channel string")
    got = {r.host_mac: (r.ap_bssid, r.channel, r.updated_us) for r in captures.device_state(df).collect()}
    assert got == {"m": ("ap1", "11", 3), "n": (None, None, 1)}


def test_adapter_text_is_shared():
    for table in (adapter.PACKET_EXPRS, adapter.CONTROL_EXPRS, adapter.LINE_EXPRS, adapter.FRAME_EXPRS):
        for expr in table.values():
            assert not re.search(r"::", expr), "only plain casts are read alike by both engines"


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for folder, rssi in (("a", -40), ("b", -50)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "cap.csv").write_text("timestamp,rssi\n" + "".join(f"2024-01-01T00:00:00.0{i}0000,{rssi}\n" for i in (1, 2)))
    (tmp_path / "b" / "other.csv").write_text('"rssi",timestamp,"gw, mac"\n-60,2024-01-01T00:00:00.010000,"x, y"\n')
    (tmp_path / "b" / "none.csv").write_text("rssi\n-1\n")
    raw = captures.read_packets(spark, str(tmp_path))
    assert {(r.capture_id, r["count"]) for r in raw.groupBy("capture_id").count().collect()} == {("a/cap", 2), ("b/cap", 2), ("b/other", 1)}
    assert [r["gw, mac"] for r in raw.where("capture_id = 'b/other'").collect()] == ["x, y"]
    got = windows.aggregate_windows(captures.drop_bad_time(captures.to_typed(raw)), row_no="row_no").collect()
    assert {(r.capture_id, r.total_packets) for r in got} == {("a/cap", 2), ("b/cap", 2), ("b/other", 1)}
    one = captures.read_packets(spark, str(tmp_path / "a" / "cap.csv"))
    assert {r.capture_id for r in one.collect()} == {"cap"}


def test_control_with_line_breaks(spark):
    from airlens.operators import labels

    rows = [(1, 10, 0, "START\n"), (1, 20, 1, "STOP\r\n"), (1, 30, 2, "{'status':'START'}"), (1, 40, 3, '\t{"status":"START"}\n')]
    got = labels.parse_control(spark.createDataFrame(rows, "capture_id int, arrival_us long, seq_no int, payload string")).orderBy("seq_no").collect()
    assert [(r.status, r.attack_type) for r in got] == [("START", "GENERIC_ATTACK"), ("STOP", None), (None, None), ("START", "UNKNOWN")]


def test_device_state_over_batches_out_of_order(spark, tmp_path):
    from airlens.streaming import jobs

    schema = "host_mac string, source_ip string, ap_bssid string, channel string, arrival_us long, pkt_id long"
    batches = [
        [("d", "10.0.0.1", "ap1", "1", 100, 1), ("e", "10.0.0.9", "", "", 100, 1)],
        [("d", "10.0.0.3", "", "3", 300, 3)],
        [("d", "10.0.0.2", "ap2", "2", 200, 2), ("e", "10.0.0.8", "ap9", "", 50, 0)],
    ]
    sink = jobs.device_state_sink(str(tmp_path / "state"))
    for n, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, schema), n)
    got = {tuple(r) for r in jobs.latest_device_state(spark, str(tmp_path / "state")).collect()}
    assert got == {("d", "10.0.0.3", "ap2", "3", 300), ("e", "10.0.0.9", "ap9", None, 100)}
    everything = captures.device_state(spark.createDataFrame([r for b in batches for r in b], schema))
    assert {tuple(r) for r in everything.collect()} == got
    assert not (tmp_path / "state" / "version=0").exists()


def test_staged_tables_go_with_their_run(spark):
    from airlens.operators.stage import stage, staging

    with staging(spark):
        held = stage(spark.range(3))
        files = held.inputFiles()
        assert held.count() == 3
    import os
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
