from collections import Counter

import numpy as np
import pytest

from airlens.operators import windows

COLUMNS = (
    "capture_id string, pkt_id long, gen_us long, subtype string, rssi double, snr double, deauth_tgt int, seq_jump int,"
    " gw_flip long, heap long, win_pkts double, win_dens double, label int, attack_type string"
)
T0 = 1_704_067_200_000_000


def packet(capture, i, at, **kw):
    base = dict(subtype="BEACON", rssi=-50.0, snr=40.0, deauth_tgt=0, seq_jump=0, gw_flip=i, heap=1000 + i,
                win_pkts=None, win_dens=None, label=0, attack_type="NONE")
    base.update(kw)
    return (capture, i, T0 + at, *base.values())


def run(spark, rows, **kw):
    df = windows.aggregate_windows(spark.createDataFrame(rows, COLUMNS), with_source=True, **kw)
    return {(r.capture_id, r.window_us - T0): r for r in df.collect()}


def test_edges(spark):
    got = run(spark, [
        packet("a", 1, 0), packet("a", 2, 99_999, rssi=-60.0, attack_type="X", label=1),
        packet("a", 3, 100_000),                                              # exactly on the edge
        packet("a", 4, 200_000, rssi=5.0), packet("a", 5, 200_001, rssi=-101.0),  # no valid signal
        packet("a", 6, 300_000, rssi=0.0, snr=0.0),                            # a missing signal counts as 0
        packet("a", 7, 400_000, attack_type="B"), packet("a", 8, 400_000, attack_type="A"),  # tie in type and time
        packet("b", 9, 50), packet("a", 10, 500_000, subtype=" DISASSOC "), packet("a", 11, 500_001, subtype="PROBE_X"),
    ])
    assert set(got) == {("a", i * 100_000) for i in range(6)} | {("b", 0)}
    w = got["a", 0]
    assert (w.total_packets, w.packet_density, w.rssi_mean, w.rssi_var) == (2, 20.0, -55.0, 25.0)
    assert (w.label, w.attack_type, w.heap, w.gw_mac_flip) == (1, "X", 1002, 2)
    assert got["a", 100_000].rssi_var == 0 and got["a", 100_000].total_packets == 1
    assert (got["a", 200_000].rssi_mean, got["a", 200_000].snr_mean) == (0, 0)
    assert got["a", 300_000].rssi_mean == 0 and got["a", 300_000].snr_mean == 0
    assert got["a", 400_000].attack_type == "B" and got["a", 400_000].heap == 1008
    assert got["b", 0].total_packets == 1
    assert (got["a", 500_000].deauth_packets, got["a", 500_000].probe_packets) == (1, 1)


def test_density_contract(spark):
    got = run(spark, [
        packet("a", 1, 0), packet("a", 2, 100_000, win_dens=7.0), packet("a", 3, 200_000, win_pkts=8.9),
        packet("a", 4, 200_001, win_pkts=3.0), packet("a", 5, 300_000, win_pkts=4.0, win_dens=1.0), packet("a", 6, 300_001, win_dens=9.0),
    ])
    seen = [(w.total_packets, w.packet_density, w.density_source) for _, w in sorted(got.items())]
    assert seen == [(1, 10.0, "rows"), (1, 10.0, "rows"), (8, 80.0, "sensor"), (4, 9.0, "sensor")]


@pytest.mark.parametrize("width", [100_000, 1_000_000])
def test_random_against_plain_model(spark, width):
    rng = np.random.default_rng(3)
    kinds, subs = ["NONE", "A", "B", "nan", ""], ["BEACON", "DEAUTH", "DISASSOC", "PROBE_REQ", "AUTH", ""]
    rows = [
        packet(f"c{rng.integers(3)}", i, int(rng.integers(0, 40) * 50_000), subtype=subs[rng.integers(6)],
               rssi=float(rng.integers(-110, 10)), snr=float(rng.integers(0, 60)), deauth_tgt=int(rng.integers(2)),
               label=int(rng.integers(2)), attack_type=kinds[rng.integers(5)])
        for i in range(600)
    ]
    got = run(spark, rows, width_us=width)
    groups = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        at = r[2] - T0
        groups.setdefault((r[0], at - at % width), []).append(r)
    assert set(groups) == set(got)
    for key, g in groups.items():
        w = got[key]
        ok = [r for r in g if -100 <= r[4] <= 0]
        named = [r[13] for r in g if r[13] not in ("", "NONE", "nan")]
        assert w.total_packets == len(g) and w.attack_type == (Counter(named).most_common(1)[0][0] if named else "NONE")
        assert w.deauth_packets == sum(r[3] in ("DEAUTH", "DISASSOC") for r in g) and w.heap == g[-1][9]
        assert w.deauth_targeted == sum(r[6] for r in g) and w.label == max(r[12] for r in g)
        assert w.rssi_mean == pytest.approx(np.mean([r[4] for r in ok]) if ok else 0)
        assert w.rssi_var == pytest.approx(np.var([r[4] for r in ok]) if len(ok) > 1 else 0, abs=1e-9)


def test_old_capture_without_optional_columns(spark):
    df = spark.createDataFrame([("a", 1, T0, "BEACON", -40.0), ("a", 2, T0 + 5, "AUTH", -42.0)], "capture_id string, pkt_id long, gen_us long, subtype string, rssi double")
    row = windows.aggregate_windows(df).first()
    assert (row.total_packets, row.heap, row.attack_type, row.label, row.auth_packets) == (2, 0, "NONE", 0, 1)
