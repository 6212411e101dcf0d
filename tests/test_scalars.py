import math

from pyspark.sql import functions as F

from airlens.functions import frames, scalars
from airlens.functions.trees import DEPLOYED, TREES, is_leaf, tree_pred, tree_prob, tree_rules
from airlens.sources.captures import prepare_windows


def test_to_float(spark):
    texts = ["1.5", " -3 ", "", None, "x", "1d", "2f", "1e3", "+4"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in df.orderBy("i").select(scalars.to_float(F.col("t")).alias("v")).collect()]
    assert got == [1.5, -3.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1000.0, 4.0]


def test_rf_valid_bounds(spark):
    df = spark.createDataFrame([(-100.0,), (0.0,), (-100.5,), (0.1,), (math.nan,), (None,)], "v double")
    assert [r.v for r in df.select(scalars.rf_valid(F.col("v")).alias("v")).collect()] == [True, True, False, False, False, False]


def test_time_texts(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00.000001",), ("2024-01-01 00:00:00",), ("",), ("soon",), (None,)], "t string")
    got = [r.v for r in df.select(scalars.parse_time_us(F.col("t")).alias("v")).collect()]
    assert got == [1704067200000001, 1704067200000000, None, None, None]


def test_prepare_windows_fills_and_cleans(spark):
    df = spark.createDataFrame(
        [("2", "5.0", "5.0", "3", None), ("0", "-50", "30", "1", "x"), ("bad", "-101", "7", "1", "4")],
        "label string, rssi_mean string, snr_mean string, rssi_var string, heap string",
    )
    got = prepare_windows(df).select("label", "attack_type", "rssi_mean", "rssi_var", "snr_mean", "heap", "backlog", "rf_mirror").collect()
    assert [tuple(r) for r in got] == [
        (1, "NONE", 0.0, 0.0, 0.0, 0.0, 0.0, True), (0, "NONE", -50.0, 1.0, 30.0, 0.0, 0.0, False),
        (0, "NONE", 0.0, 0.0, 7.0, 4.0, 0.0, False),
    ]


def _frame(fc0, dst, src, seq, size):
    body = bytes([fc0, 0, 0, 0]) + bytes.fromhex(dst) + bytes.fromhex(src) + bytes(6) + (seq << 4).to_bytes(2, "little")
    return bytearray(body[:size])


def test_decode_frames(spark):
    rows = [
        (_frame(0xC0, "FFFFFFFFFFFF", "0A0B0C0D0E0F", 4095, 24), 24), (_frame(0xA0, "020000000001", "0A0B0C0D0E0F", 1, 24), 30),
        (_frame(0xC0, "AAAAAAAAAAAA", "0A0B0C0D0E0F", 7, 20), 20), (_frame(0x80, "FFFFFFFFFFFF", "000000000000", 7, 12), 12),
        (_frame(0x08, "FFFFFFFFFFFF", "0A0B0C0D0E0F", 9, 24), 24), (_frame(0x10, "FFFFFFFFFFFF", "0A0B0C0D0E0F", 9, 24), 24), (bytearray(), 0),
    ]
    df = spark.createDataFrame([(i, f, n, "02:00:00:00:00:01") for i, (f, n) in enumerate(rows)], "i int, frame binary, frame_len int, host_mac string")
    got = frames.decode_frames(df).orderBy("i").select("frame_type", "subtype", "dst_mac", "seq", "deauth_tgt").collect()
    assert [tuple(r) for r in got] == [
        ("MGMT", "DEAUTH", "FF:FF:FF:FF:FF:FF", 4095, 1), ("MGMT", "DISASSOC", "02:00:00:00:00:01", 1, 1),
        ("MGMT", "DEAUTH", "AA:AA:AA:AA:AA:AA", 0, 0), ("MGMT", "BEACON", "00:00:00:00:00:00", 0, 0),
        ("DATA", "", "FF:FF:FF:FF:FF:FF", 9, 0), ("MGMT", "MGMT_OTHER", "FF:FF:FF:FF:FF:FF", 9, 0), (None, "", "00:00:00:00:00:00", 0, 0),
    ]


def _walk(node, row):
    while not is_leaf(node):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def test_tree_expressions_reach_every_leaf(spark):
    """Rows just at and just over each threshold, so that all leaves are met."""
    def paths(node, held):
        if is_leaf(node):
            yield dict(held)
            return
        name, cut, left, right = node
        yield from paths(left, {**held, name: min(held.get(name, cut), cut)})
        yield from paths(right, {**held, name: max(held.get(name, cut + 0.01), cut + 0.01)})

    for name, tree in TREES.items():
        rows = [{**dict.fromkeys(["total_packets", "packet_density", "deauth_packets", "deauth_targeted", "seq_jump", "rssi_mean",
                                  "rssi_var", "snr_mean", "heap", "udpfail"], 0.0), **p} for p in paths(tree, {})]
        got = spark.createDataFrame(rows).select("*", tree_prob(tree).alias("p"), tree_pred(tree).alias("y")).collect()
        seen = set()
        for r in got:
            leaf = _walk(tree, r.asDict())
            seen.add(leaf)
            assert r.p == leaf[1] and r.y == int(leaf[1] > leaf[0]), name
        assert len(seen) >= 5
    assert tree_rules(DEPLOYED)[0] == "|--- deauth_packets <= 0.50"
