import json

import numpy as np
import pytest

from airlens.operators import labels

CONTROL = "capture_id string, arrival_us long, seq_no long, payload string"
PACKET = "capture_id string, pkt_id long, aligned_us long, arrival_us long"


def test_control_forms(spark):
    payloads = ["START", "STOP", '{"status":"START"}', '{"status":"START","attack_type":"DEAUTH"}', '{"status":"STOP"}', "hello", '{"status":"PING"}', "{broken"]
    df = spark.createDataFrame([("c", i, i, p) for i, p in enumerate(payloads)], CONTROL)
    got = [(r.status, r.attack_type) for r in labels.parse_control(df).orderBy("seq_no").collect()]
    assert got == [("START", "GENERIC_ATTACK"), ("STOP", None), ("START", "UNKNOWN"), ("START", "DEAUTH"), ("STOP", None), (None, None), ("PING", None), (None, None)]


def model(control, packets):
    """Labels in arrival order; at the same instant control comes first."""
    done, current, out = [], None, {}
    queue = [(a, 0, s, p) for _, a, s, p in control] + [(a, 1, i, g) for _, i, g, a in packets]
    for at, kind, no, body in sorted(queue, key=lambda x: x[:3]):
        if kind == 0:
            status, name = (body, "GENERIC_ATTACK") if body in ("START", "STOP") else (json.loads(body)["status"], json.loads(body).get("attack_type", "UNKNOWN"))
            if status == "START":
                current = (at, name)
            elif status == "STOP" and current:
                done.append((current[0], at, current[1]))
                current = None
            continue
        hit = next((t for s, e, t in done if s <= body <= e), None)
        if hit is None and current and body >= current[0]:
            hit = current[1]
        out[no] = (int(hit is not None), hit or "NONE")
    return out


@pytest.mark.parametrize("cell_us", [7, 10_000])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_labels_against_model(spark, seed, cell_us):
    rng = np.random.default_rng(seed)
    control, packets = [], []
    for c in ("a", "b"):
        at = 0
        for i in range(25):
            at += int(rng.integers(0, 12))
            body = [json.dumps({"status": "START", "attack_type": f"T{i}"}), "STOP", "START", json.dumps({"status": "STOP"})][rng.integers(4)]
            control.append((c, at, i, body))
        for i in range(250):
            arrival = int(rng.integers(0, at + 20))
            packets.append((c, i, arrival - int(rng.integers(0, 6)), arrival))
    spans = labels.control_to_spans(spark.createDataFrame(control, CONTROL))
    got = labels.label_packets(spark.createDataFrame(packets, PACKET), spans, cell_us=cell_us).collect()
    assert len(got) == len(packets)
    for c in ("a", "b"):
        want = model([x for x in control if x[0] == c], [x for x in packets if x[0] == c])
        assert {r.pkt_id: (r.label, r.attack_type) for r in got if r.capture_id == c} == want


def test_ends_are_inclusive_and_rounds_count(spark):
    control = [("c", 10, 0, '{"status":"START","attack_type":"A"}'), ("c", 20, 1, "STOP"), ("c", 20, 2, '{"status":"START","attack_type":"B"}'), ("c", 30, 3, "STOP"), ("c", 40, 4, "STOP")]
    packets = [("c", i, g, g) for i, g in enumerate([9, 10, 20, 21, 30, 31])]
    spans = labels.control_to_spans(spark.createDataFrame(control, CONTROL))
    out = labels.label_packets(spark.createDataFrame(packets, PACKET), spans)
    assert [r.attack_type for r in out.orderBy("pkt_id").collect()] == ["NONE", "A", "A", "B", "B", "NONE"]
    rounds = labels.attack_rounds(out, spans).orderBy("start_us").collect()
    assert [(r.attack_type, r.n_packets) for r in rounds] == [("A", 1), ("B", 2)]


def test_relabel_missed_stop(spark):
    rows = [("c", 0, 0, "0", "NONE"), ("c", 1, 10, "1", "SYN_FLOOD"), ("c", 2, 140_000_009, "1", "SYN_FLOOD"), ("c", 3, 130_000_010, "1", "SYN_FLOOD"),
            ("c", 4, 200_000_000, "1", "DEAUTH"), ("c", 5, 200_000_000, "1.0", "SYN_FLOOD"), ("c", 6, 300_000_000, "1", "SYN_FLOOD")]
    df = spark.createDataFrame(rows, "capture_id string, pkt_id long, gen_us long, label string, attack_type string")
    got = labels.relabel_missed_stop(df).orderBy("pkt_id").collect()
    assert [(r.label, r.attack_type) for r in got] == [("0", "NONE"), ("1", "SYN_FLOOD"), ("0", "NONE"), ("1", "SYN_FLOOD"), ("1", "DEAUTH"), ("1.0", "SYN_FLOOD"), ("0", "NONE")]
