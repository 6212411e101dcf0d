import numpy as np
import pytest
from pyspark.sql import functions as F

from airlens.operators import calibration
from airlens.operators.scan import cell_of

WINDOWS = "capture_id string, window_us long, total_packets double, deauth_packets double, deauth_targeted double, raw_pred int"


def latch_model(rows, clear=2):
    pos = neg = latched = 0
    out = []
    for candidate, need in rows:
        if candidate:
            pos, neg = pos + 1, 0
            if pos >= need:
                latched = 1
        else:
            pos, neg = 0, neg + 1
            if neg >= clear:
                latched = 0
        out.append(latched)
    return out


@pytest.mark.parametrize("cell", [1, 2, 5, 1000])
@pytest.mark.parametrize("p", [0.3, 0.7, 0.95])
def test_latch_against_machine(spark, cell, p):
    rng = np.random.default_rng(int(cell + 100 * p))
    groups = {k: [(int(rng.random() < p), int(rng.choice([1, 3]))) for _ in range(120)] for k in "abc"}
    rows = [(k, i, c, n) for k, g in groups.items() for i, (c, n) in enumerate(g)]
    df = spark.createDataFrame(rows, "capture_id string, window_us long, c int, n int")
    got = calibration.streak_latch(df, F.col("c") == 1, F.col("n"), cell=cell_of("window_us", cell)).orderBy("capture_id", "window_us").collect()
    for k, g in groups.items():
        assert [r.alert for r in got if r.capture_id == k] == latch_model(g)


def sensor_model(rows, calib_us, ring_size=128, least=32, k=2.0):
    start, ring, armed, thr, state, out = rows[0][0], [], False, 1.0, [], []
    for at, total, deauth, target, raw in rows:
        loud = deauth > 0.5 or target > 0.5
        if not armed:
            if not loud:
                ring = (ring + [total])[-ring_size:]
            if at - start >= calib_us and len(ring) >= least:
                armed, thr = True, max(k * sorted(ring)[int((len(ring) - 1) * 0.90)], 1.0)
        candidate = int(armed and raw and (loud or total > thr))
        if armed:
            state.append((candidate, 1 if loud else 3))
        out.append((("ARMED" if armed else "CALIB"), thr, candidate, latch_model(state)[-1] if armed else 0))
    return out


@pytest.mark.parametrize("n,calib_s,quiet", [(300, 5, 0.8), (300, 20, 0.5), (60, 3, 0.5), (400, 25, 0.9), (40, 60, 0.9)])
def test_alerts_against_machine(spark, n, calib_s, quiet):
    rng = np.random.default_rng(n + calib_s)
    rows = {}
    for key in ("a", "b"):
        at = np.cumsum(rng.integers(1, 3, n)) * 100_000
        rows[key] = [(int(t), float(rng.integers(0, 60)), float(rng.random() > quiet), float(rng.random() > 0.95), int(rng.random() < 0.6)) for t in at]
    df = spark.createDataFrame([(k, *r) for k, g in rows.items() for r in g], WINDOWS)
    out = calibration.calibrated_alerts(df, calib_ms=calib_s * 1000, cell=cell_of("window_us", 1_700_000))
    for key, g in rows.items():
        got = [(r.calib, r.calib_thr, r.candidate, r.alert) for r in out.where(F.col("capture_id") == key).orderBy("window_us").collect()]
        assert got == sensor_model(g, calib_s * 1_000_000)


@pytest.mark.parametrize("n,armed", [(31, False), (32, True), (200, True)])
def test_ring_sizes(spark, n, armed):
    rows = [("a", i * 100_000, float(i), 0.0, 0.0, 0) for i in range(n)]
    got = calibration.ring_baseline(spark.createDataFrame(rows, WINDOWS), calib_ms=100 * (n - 1)).collect()
    assert len(got) == int(armed)
    if armed:
        kept = list(range(n))[-128:]
        assert (got[0].n_samples, got[0].p90) == (len(kept), kept[int((len(kept) - 1) * 0.9)])


def test_gate_off_passes_raw(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 0.0, 0.0, 1), ("a", 1, 1.0, 0.0, 0.0, 0)], WINDOWS)
    got = calibration.calibrated_alerts(df, enabled=False).orderBy("window_us").collect()
    assert [(r.calib, r.alert) for r in got] == [("OFF", 1), ("OFF", 0)]
