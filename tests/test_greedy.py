import numpy as np
import pytest

from airlens.operators import greedy


def marks_model(times, width):
    last, out = None, []
    for t in times:
        hit = last is None or t - last >= width
        out.append((hit, -1 if last is None else last))
        if hit:
            last = t
    return out


@pytest.mark.parametrize("step", ["regular", "random", "sparse"])
@pytest.mark.parametrize("cell,block", [(100, 2), (250, 3), (10_000, 1024)])
def test_marks_against_loop(spark, step, cell, block):
    rng = np.random.default_rng(cell)
    rows, want = [], {}
    for key in ("a", "b"):
        gaps = {"regular": np.full(300, 7), "random": rng.integers(0, 40, 300), "sparse": rng.integers(0, 400, 300)}[step]
        times = np.cumsum(gaps) + int(rng.integers(0, 50))
        rows += [(key, int(t), i) for i, t in enumerate(times)]
        want.update({(key, i): m for i, m in enumerate(marks_model(times.tolist(), 100))})
    df = spark.createDataFrame(rows, "capture_id string, gen_us long, pkt_id long")
    got = greedy.greedy_marks(df, 100, cell_us=cell, block=block).collect()
    assert {(r.capture_id, r.pkt_id): (r.is_mark, r.last_mark_us) for r in got} == want


@pytest.mark.parametrize("cell", [100_000, 700_000])
def test_elastic_windows_against_loop(spark, cell):
    rng = np.random.default_rng(4)
    times = np.sort(rng.integers(0, 3_000_000, 200))
    rows = [("a", int(t), i, "DEAUTH" if i % 3 == 0 else "", float(rng.integers(-90, -20)), 30.0, i % 2, 0) for i, t in enumerate(times)]
    columns = "capture_id string, gen_us long, pkt_id long, subtype string, rssi double, snr double, deauth_tgt int, seq_jump int"
    start, held, want = rows[0][1], [], {}
    for r in rows:
        held.append(r)
        if r[1] - start >= 100_000:
            signal = [x[4] for x in held]
            want[start] = (r[1], len(held), sum(x[3] == "DEAUTH" for x in held), np.mean(signal), np.var(signal))
            start, held = r[1], []
    got = {r.start_us: r for r in greedy.elastic_windows(spark.createDataFrame(rows, columns), cell_us=cell).collect()}
    assert set(got) == set(want)
    for at, (end, n, deauth, mean, var) in want.items():
        w = got[at]
        assert (w.end_us, w.total_packets, w.deauth_packets) == (end, n, deauth)
        assert w.rssi_mean == pytest.approx(mean) and w.rssi_var == pytest.approx(var, abs=1e-6)
        assert w.packet_density == pytest.approx(n / ((end - at) / 1e6))


def test_throttle_counts_from_the_last_action(spark):
    rows = [("a", t * 100_000) for t in (0, 10, 19, 20, 39, 40, 41, 100)]
    df = spark.createDataFrame(rows, "capture_id string, window_us long")
    got = greedy.throttle_alerts(df, cell_us=2_000_000)
    assert sorted(r.window_us // 100_000 for r in got.collect()) == [0, 20, 40, 100]
