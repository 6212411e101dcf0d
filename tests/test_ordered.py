import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airlens.operators import ordered
from airlens.operators.quantiles import quantiles
from airlens.operators.scan import Running, cell_of, running


def test_running_across_cells(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 500), "t": np.arange(500), "v": rng.integers(-9, 9, 500).astype(float)})
    pdf["w"] = pdf["v"].where(rng.random(500) < 0.3)
    df = spark.createDataFrame(pdf.where(pdf.notna(), None).astype({"k": int, "t": int}))
    df = df.withColumn("w", F.when(~F.isnan("w"), F.col("w")))
    specs = [Running("s", "sum", F.col("v")), Running("hi", "max", F.col("v")), Running("lo", "min", F.col("w")),
             Running("p", "prev", F.col("w")), Running("l", "last", F.col("w"))]
    got = running(df, ["k"], ["t"], cell_of("t", 7), specs).toPandas().sort_values("t").reset_index(drop=True)
    g = pdf.groupby("k")
    want = {"s": g["v"].cumsum(), "hi": g["v"].cummax(), "l": g["w"].ffill(), "p": g["w"].transform(lambda x: x.ffill().shift())}
    want["lo"] = g["w"].cummin().groupby(pdf["k"]).ffill()
    for name, series in want.items():
        np.testing.assert_array_equal(got[name].to_numpy(dtype=float), series.to_numpy(dtype=float), err_msg=name)


@pytest.mark.parametrize("cell", [3, 1000])
def test_inter_arrival_and_jumps(spark, cell):
    rows = [("a", 0, 0, 10, 30), ("a", 1, 5, 100, 30), ("a", 2, 3, 4000, 10), ("a", 3, 9, 160, 30), ("a", 4, 9, 165, 24), ("a", 5, 12, 4090, 24), ("a", 6, 20, 20, 24)]
    df = spark.createDataFrame(rows, "capture_id string, pkt_id long, gen_us long, seq long, frame_len int")
    gaps = ordered.inter_arrival(df, cell_rows=cell).orderBy("pkt_id").collect()
    assert [r.ipat for r in gaps] == [0, 0, 0, 6, 0, 3, 8]
    jumps = ordered.seq_jumps(df, cell_rows=cell).orderBy("pkt_id").collect()
    assert [r.seq_jumped for r in jumps] == [0, 1, 0, 0, 0, 1, 0]


def clock_model(rows):
    """(boot, least offset) per line in arrival order."""
    out, state = {}, {}
    for k, arrival, i, up in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        up_us = int(round((up or 0) * 1000))
        last, low, boot = state.get(k, (None, None, 0))
        offset = arrival - up_us
        if last is None or up_us < last - 5_000_000:
            low, boot = offset, boot + 1
        low = min(low, offset)
        state[k] = (up_us, low, boot)
        out[k, i] = (boot, low, low + up_us)
    return out


@pytest.mark.parametrize("cell_us", [300_000, 10_000_000_000])
def test_clock_against_model(spark, cell_us):
    rng = np.random.default_rng(5)
    rows = [("edge", 1_000_000 * i, i, float(u)) for i, u in enumerate([10_000, 5_000, 20_000, 14_999, 9_998, 0])]
    for k in ("a", "b"):
        up, at = 60_000.0, 0
        for i in range(400):
            at += int(rng.integers(1, 30_000))
            up = float(rng.integers(0, 3000)) if rng.random() < 0.02 else up + float(rng.integers(0, 40))
            rows.append((k, at + int(rng.integers(0, 5_000)), i, None if rng.random() < 0.01 else up))
    df = spark.createDataFrame(rows, "capture_id string, arrival_us long, pkt_id long, uptime_ms double")
    got = {(r.capture_id, r.pkt_id): (r.boot_id, r.min_offset_us, r.aligned_us) for r in ordered.align_clock(df, cell_us=cell_us).collect()}
    assert got == clock_model(rows)


@pytest.mark.parametrize("cell_us", [2, 10_000])
def test_gateway_flips(spark, cell_us):
    macs = ["-", "A", "A", "B", "00:00:00:00:00:00", "a", "", "A", "B", "B"]
    rows = [("d", 0 if i < 8 else 1, i, i, m) for i, m in enumerate(macs)]
    df = spark.createDataFrame(rows, "capture_id string, conn int, arrival_us long, pkt_id long, gw_mac string")
    got = ordered.gateway_flips(df, ("capture_id", "conn"), cell_us=cell_us).orderBy("pkt_id").collect()
    assert [r.flips for r in got] == [0, 0, 0, 1, 1, 2, 2, 2, 0, 0]


def windows_frame(spark, label, density=None, kind=None):
    rows = [("c", i * 100_000, int(v), float((density or [1] * len(label))[i]), (kind or {}).get(i, "X" if v else "NONE")) for i, v in enumerate(label)]
    return spark.createDataFrame(rows, "capture_id string, window_us long, label int, packet_density double, attack_type string")


@pytest.mark.parametrize("cell_us", [300_000, 10**12])
def test_attack_spans(spark, cell_us):
    w = windows_frame(spark, [0, 1, 1, 0, 0, 1, 0, 1, 1])
    got = ordered.attack_spans(w, cell_us=cell_us).orderBy("start_us").collect()
    assert [(r.start_us // 100_000, r.end_us // 100_000, r.n_windows) for r in got] == [(1, 3, 2), (5, 6, 1), (7, 8, 2)]


@pytest.mark.parametrize("block", [30, 100_000])
def test_busy_peak(spark, block):
    rng = np.random.default_rng(2)
    density = [float(x) for x in rng.integers(0, 50, 120)]
    w = windows_frame(spark, [0] * 100 + [1] * 20, density)
    early = ordered.before_attack(w)
    rolled = ordered.rolling_mean(early, ["capture_id"], ["window_us"], cell_of("window_us", 700_000), "packet_density", 20, 5, "m", block)
    want = pd.Series(density[:100]).rolling(20, min_periods=5).mean()
    got = rolled.toPandas().sort_values("window_us")["m"]
    np.testing.assert_allclose(got.to_numpy(dtype=float), want.to_numpy())
    assert ordered.busy_peak(w).first().peak_us == int(want.idxmax()) * 100_000
    assert ordered.busy_peak(windows_frame(spark, [0] * 19 + [1])).count() == 0


def test_prefix_and_thin(spark):
    w = windows_frame(spark, [0, 0, 1, 0, 0])
    got = ordered.chronological_prefix(w, 0.5, cell_us=100_000).orderBy("window_us").collect()
    assert [(r.idle_no, r.is_calib) for r in got] == [(1, True), (2, True), (3, False), (4, False)]
    assert ordered.chronological_prefix(w.limit(1), 0.1).first().is_calib
    p = spark.range(25).selectExpr("'a' as capture_id", "id as pkt_id", "id * 1000 as gen_us")
    assert [r.pkt_id for r in ordered.thin(p, 10, cell_us=3000).orderBy("pkt_id").collect()] == [9, 19]


def test_attacker_list_keeps_the_first(spark):
    rows = [("a", i, f"m{i % 20:02d}") for i in range(60)]
    got = ordered.attacker_list(spark.createDataFrame(rows, "capture_id string, action_us long, src_mac string"))
    assert sorted(r.src_mac for r in got.collect()) == [f"m{i:02d}" for i in range(16)]


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": rng.integers(0, 4, 3000), "v": np.round(rng.normal(size=3000), 2)})
    pdf.loc[pdf["k"] == 3, "v"] = 7.0
    got = quantiles(spark.createDataFrame(pdf), ["k"], "v", {"p50": 0.5, "p90": 0.9, "p0": 0.0, "p100": 1.0}).toPandas().set_index("k").sort_index()
    for name, p in (("p50", 0.5), ("p90", 0.9), ("p0", 0.0), ("p100", 1.0)):
        np.testing.assert_allclose(got[name], pdf.groupby("k")["v"].quantile(p), atol=1e-12)
