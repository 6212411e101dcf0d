"""Replaying the same rows in several micro-batches gives the batch result."""

import random
import time
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlens import adapter
from airlens.operators import calibration, greedy, labels, ordered, rules, windows
from airlens.sources import captures, telemetry
from airlens.streaming import jobs, state
from airlens.streaming.queries import replay_closed


@pytest.fixture(scope="module")
def packets(spark, sf_dir):
    return adapter.packets(spark, sf_dir).persist()


def split_stream(spark, df, order, tmp_path, parts=3):
    """``df`` as a stream of ``parts`` files in order, one file per trigger."""
    path = str(tmp_path / uuid.uuid4().hex)
    rows = df.count()
    ranked = df.rdd.sortBy(lambda r: tuple(r[c] for c in order)).zipWithIndex().map(lambda x: (*x[0], x[1] * parts // rows))
    frame = spark.createDataFrame(ranked, T.StructType([*df.schema.fields, T.StructField("_part", T.LongType())]))
    for i in range(parts):
        frame.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def replay(spark, stream, tmp_path, sink=None, mode="append"):
    out = str(tmp_path / uuid.uuid4().hex)
    query = jobs.start(stream, (sink or jobs.to_table)(out), out + "-checkpoint", mode)
    query.awaitTermination()
    return out


def same(a, b, columns):
    rows = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert rows(a) == rows(b)


def test_windows_and_scores(spark, packets, tmp_path):
    stream = split_stream(spark, packets, ["gen_us", "pkt_id"], tmp_path, parts=2)
    got = replay_closed(stream, lambda p: jobs.stream_score(jobs.stream_windows(p)))
    want = rules.score_tree(windows.aggregate_windows(packets))
    same(got, want, want.columns)


def test_clock_then_labels(spark, packets, tmp_path):
    slim = packets.select("capture_id", "pkt_id", "arrival_us", (F.col("pkt_id") % 400 * 30).alias("uptime_ms"))
    control = adapter.control_of(packets).persist()
    stream = split_stream(spark, slim, ["arrival_us", "pkt_id"], tmp_path)
    out = replay(spark, jobs.stream_clock(stream), tmp_path, lambda p: jobs.label_sink(lambda: control, p))
    aligned = ordered.align_clock(slim, cell_us=500_000)
    assert aligned.agg(F.max("boot_id")).first()[0] > 1
    want = labels.label_packets(aligned, labels.control_to_spans(control))
    same(spark.read.parquet(out), want, ["capture_id", "pkt_id", "boot_id", "aligned_us", "label", "attack_type"])


def test_calibration_and_throttle(spark, packets, tmp_path):
    w = rules.score_tree(windows.aggregate_windows(packets)).withColumn("src_mac", F.concat(F.lit("m"), (F.col("window_us") / 100000 % 5).cast("int")))
    w = w.withColumn("raw_pred", F.lit(1))
    settings = {"calib_ms": 1500, "least": 8}
    stream = split_stream(spark, w, ["window_us"], tmp_path)
    out = spark.read.parquet(replay(spark, jobs.stream_calibration(stream, **settings), tmp_path))
    want = calibration.calibrated_alerts(w, **settings)
    assert want.where("alert = 1").count() > 0
    same(out, want, ["capture_id", "window_us", "calib", "calib_thr", "candidate", "alert"])

    alerts = want.where("alert = 1").select("capture_id", "window_us", "src_mac").persist()
    stream = split_stream(spark, alerts, ["window_us"], tmp_path)
    acted = spark.read.parquet(replay(spark, jobs.stream_throttle(stream, gap_us=200_000, limit=2), tmp_path)).persist()
    batch = greedy.throttle_alerts(alerts, gap_us=200_000, cell_us=300_000).withColumnRenamed("window_us", "action_us")
    same(acted, batch, ["capture_id", "action_us", "src_mac"])
    same(acted.where("newly_listed"), ordered.attacker_list(batch, limit=2), ["capture_id", "src_mac"])


def test_elastic_windows(spark, packets, tmp_path):
    stream = split_stream(spark, packets, ["gen_us", "pkt_id"], tmp_path)
    got = spark.read.parquet(replay(spark, jobs.stream_elastic_windows(stream), tmp_path))
    same(got, greedy.elastic_windows(packets, cell_us=400_000), ["capture_id", "start_us", "end_us", "total_packets", "deauth_packets", "rssi_mean"])


def test_gateway(spark, packets, tmp_path):
    p = packets.select("capture_id", "pkt_id", "arrival_us", "gw_mac", F.floor(F.col("pkt_id") / 700).alias("conn"))
    stream = split_stream(spark, p, ["arrival_us", "pkt_id"], tmp_path)
    got = spark.read.parquet(replay(spark, jobs.stream_gateway(stream), tmp_path))
    same(got, ordered.gateway_flips(p, ("capture_id", "conn"), cell_us=300_000), ["capture_id", "pkt_id", "flips"])


def test_parse_state_and_counters(spark, packets, tmp_path):
    lines = adapter.lines_of(packets)
    stream = split_stream(spark, lines, ["arrival_us", "pkt_id"], tmp_path)
    out = str(tmp_path / "parsed")
    jobs.start(jobs.stream_parse(stream), jobs.parse_sink(out + "/ok", out + "/bad"), out + "/cp").awaitTermination()
    parsed = telemetry.parse_telemetry(lines)
    same(spark.read.parquet(out + "/ok"), telemetry.accepted_lines(parsed), ["pkt_id", "status", "heap", "gw_mac"])
    same(spark.read.parquet(out + "/bad"), telemetry.reject_lines(parsed), ["pkt_id", "raw", "reason"])

    whole = telemetry.accepted_lines(parsed).where("host_mac <> ''")
    stream = split_stream(spark, whole.select("host_mac", "arrival_us", "pkt_id", "ap_bssid", "channel"), ["arrival_us", "pkt_id"], tmp_path)
    state = replay(spark, stream, tmp_path, jobs.device_state_sink)
    same(jobs.latest_device_state(spark, state), captures.device_state(whole), ["host_mac", "ap_bssid", "channel", "updated_us"])

    stream = split_stream(spark, packets.select("capture_id", "pkt_id", "label"), ["pkt_id"], tmp_path)
    counts = replay(spark, jobs.stream_counters(stream), tmp_path, jobs.counters_sink, "update")
    same(jobs.latest_counters(spark, counts), packets.groupBy("capture_id", "label").agg(F.count(F.lit(1)).alias("n")), ["capture_id", "label", "n"])


def rounds(spark, tmp_path, frames, run):
    """Each list of tables of ``frames`` is added to its sources, then ``run`` takes up what is new."""
    paths = [str(tmp_path / uuid.uuid4().hex) for _ in frames[0]]
    for tables in frames:
        for df, path in zip(tables, paths, strict=True):
            df.write.mode("append").parquet(path)
        run(*[spark.readStream.schema(df.schema).parquet(path) for df, path in zip(tables, paths, strict=True)])


def test_live_control_changes_nothing_written(spark, tmp_path):
    packet = "capture_id long, pkt_id long, arrival_us long, aligned_us long"
    message = "capture_id long, arrival_us long, seq_no long, payload string"
    start, stop = '{"status":"START","attack_type":"DEAUTH"}', '{"status":"STOP"}'
    frames = [
        ([(1, 1, 100, 90), (1, 2, 210, 205), (2, 3, 210, 205)], [(1, 200, 1, start)]),
        ([(1, 4, 300, 150), (1, 5, 310, 290)], []),  # its STOP has not come
        ([(1, 6, 420, 395), (1, 7, 421, 405)], [(1, 400, 2, stop), (2, 405, 3, "STOP")]),
        ([(1, 8, 600, 250), (1, 9, 650, 640), (1, 10, 660, 460)], [(1, 500, 4, "START"), (1, 640, 5, '{"status":"START"}')]),
    ]
    out, seen = str(tmp_path / "out"), []

    def run(packets, control):
        jobs.start(jobs.stream_live_label(packets, control), jobs.to_table(out), out + "-checkpoint").awaitTermination()
        seen.append({r.pkt_id: (r.label, r.attack_type) for r in spark.read.parquet(out).collect()})

    rounds(spark, tmp_path, [(spark.createDataFrame(p, packet), spark.createDataFrame(c, message)) for p, c in frames], run)
    assert all(a.items() <= b.items() for a, b in zip(seen, seen[1:], strict=False))
    hit = {k for k, v in seen[-1].items() if v[0]}
    assert hit == {2, 5, 6, 8, 9} and seen[-1][8] == (1, "DEAUTH") and seen[-1][9] == (1, "UNKNOWN") and seen[-1][7] == (0, "NONE")
    both = [spark.createDataFrame([r for f in frames for r in f[k]], s) for k, s in ((0, packet), (1, message))]
    batch = labels.label_packets(both[0], labels.control_to_spans(both[1]))
    assert {r.pkt_id: (r.label, r.attack_type) for r in batch.collect()} == seen[-1]


class Held:
    """State of one device between batches."""

    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def live_label_rows(batches, keep_us=None):
    """(pkt_id, label, attack_type) of batches of (id, arrival, aligned, status, kind) in one state."""
    held, step, out = Held(), state.live_labels("capture_id", keep_us), []
    for rows in batches:
        frame = pd.DataFrame(rows, columns=["pkt_id", "arrival_us", "aligned_us", "status", "kind"]).astype({"aligned_us": float, "status": object, "kind": object})
        for got in step((1,), iter([frame]), held):
            out += got[["pkt_id", "label", "attack_type"]].itertuples(index=False, name=None)
    return out


def test_live_labels_of_many_rounds():
    # A test of every packet between two messages against every round before them took minutes.
    n, rows = 6000, []
    for k in range(n):
        rows += [(k, 1000 * k, None, "STOP" if k % 2 else "START", None if k % 2 else f"t{k % 7}")]
        rows += [(4 * k + i, 1000 * k + 1 + i, 1000 * k + 1 + i - 400 * (i == 3), None, None) for i in range(4)]
    began = time.process_time()
    got = live_label_rows([rows[: len(rows) // 2], rows[len(rows) // 2 :]])
    assert time.process_time() - began < 10
    # The fourth packet after a message was generated before it, in the round before if that message is a STOP.
    want = [(4 * k + i, *((1, f"t{(k - k % 2) % 7}") if (k % 2 == 0) != (i == 3) else (0, "NONE"))) for k in range(n) for i in range(4)]
    assert sorted(got) == want


def test_live_labels_of_late_messages():
    # Batches whose times overlap, so that rounds overlap as well: the round that closed first has the last word.
    rng = random.Random(7)
    for trial in range(60):
        batches = []
        for _ in range(4):
            at = rng.sample(range(60), 30)
            batches.append([
                (t, t, None, *rng.choice([("START", rng.choice("abc")), ("STOP", None)])) if rng.random() < 0.5 else (t, t, rng.randrange(60), None, None)
                for t in at
            ])
        keep_us = rng.choice([None, 5, 20])
        want, rounds, now, newest = [], [], None, 0
        for rows in batches:
            for pkt, arrival, aligned, status, kind in sorted(rows, key=lambda r: r[1]):
                newest = max(newest, arrival)
                if status == "START":
                    now = (arrival, kind)
                elif status == "STOP" and now:
                    rounds, now = [*rounds, (now[0], arrival, now[1])], None
                elif status is None:
                    known = [*rounds, *([(now[0], 10**9, now[1])] if now else [])]
                    hit = next((kind for a, b, kind in known if a <= aligned <= b), None)
                    want.append((pkt, int(hit is not None), hit or "NONE"))
            if keep_us is not None:
                rounds = [r for r in rounds if r[1] >= newest - keep_us]
        assert live_label_rows(batches, keep_us) == want


def test_idle_devices_leave_the_store(spark, packets, tmp_path):
    import time

    slim = packets.select("capture_id", "pkt_id", "arrival_us", "uptime_ms")
    devices, out, held = slim.select("capture_id").distinct().count(), str(tmp_path / "out"), []
    path = str(tmp_path / "in")
    slim.write.parquet(path)
    come = spark.readStream.schema(slim.schema).parquet(path)
    query = jobs.start(jobs.stream_clock(come, idle_ms=1500), jobs.to_table(out), out + "-checkpoint", once=False)
    try:
        end = time.time() + 90
        while time.time() < end and not (held and held[-1] == 0 and max(held) > 0):
            time.sleep(0.2)
            held += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][len(held):]
    finally:
        query.stop()
    assert max(held) == devices and held[-1] == 0


def test_store_writes_the_buckets_of_a_batch_alone(spark, tmp_path):
    from airlens.streaming import store

    path, total = str(tmp_path / "store"), {}
    combine = lambda rows: rows.groupBy("k").agg(F.max("n").alias("n"))
    for batch, rows in enumerate([[(k, 1) for k in range(200)], [(7, 5)], [(7, 9), (8, 3)], [], [(500, 1)]]):
        frame = spark.createDataFrame(rows, "k long, n long")
        for _ in range(2):  # a batch that runs again changes nothing
            touched = store.merge(path, ["k"], frame, combine, batch)
        total.update({k: max(n, total.get(k, 0)) for k, n in rows})
        assert len(touched) <= max(len(rows), 0) and {r.k: r.n for r in store.read(spark, path).collect()} == total
    found = store.versions(spark, path)
    assert len(found) > 50 and all(len(v) <= 2 for v in found.values()) and sum(max(v) > 0 for v in found.values()) <= 3
