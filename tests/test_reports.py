import numpy as np
import pytest

from airlens.operators import metrics, quality, rules
from pyspark.sql import functions as F

WINDOWS = "capture_id string, label int, attack_type string"


def gates(spark, normal, attacks, **kw):
    rows = [("c", 0, "NONE")] * normal + [("c", 1, t) for t, n in attacks.items() for _ in range(n)]
    return {r.gate: r for r in quality.balance_gates(spark.createDataFrame(rows, WINDOWS), **kw).collect()}


def test_gates_at_their_limits(spark):
    got = gates(spark, 4, {"DEAUTH": 5, "SYN_FLOOD": 21, "ARP_SPOOF": 4}, min_normal=4, min_per_attack=4)
    assert got["normal_count"].ok and got["attack_ARP_SPOOF"].ok and got["not_syn_dominated_ratio"].ok
    assert got["syn_share"].ok and got["syn_share"].value == 0.7 and got["syn_share"].all_ok
    assert not gates(spark, 1, {"SYN_FLOOD": 9}, min_normal=1, min_per_attack=1)["not_syn_dominated_ratio"].ok


def test_gates_without_a_class(spark):
    no_normal = gates(spark, 0, {"DEAUTH": 2})
    assert not no_normal["not_syn_dominated_ratio"].ok and no_normal["not_syn_dominated_ratio"].value is None
    no_attack = gates(spark, 3, {}, min_normal=1, with_auth=True)
    assert "syn_share" not in no_attack and "attack_AUTH_FLOOD" in no_attack and not no_attack["normal_count"].all_ok
    with pytest.raises(ValueError):
        quality.require_both_classes(spark.createDataFrame([("c", 0, "NONE")], WINDOWS))


def auc_model(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_auc_with_ties_and_single_class(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    assert metrics.roc_auc(df).first().auc == pytest.approx(auc_model(y, s))
    assert metrics.roc_auc(df.where("label = 1")).first().auc is None
    curve = metrics.roc_curve(df).orderBy("threshold").collect()
    assert (curve[0].tpr, curve[0].fpr) == (1.0, 1.0) and len(curve) == len(set(s))
    cut = curve[4].threshold
    assert curve[4].tpr == pytest.approx(np.mean(s[y == 1] >= cut)) and curve[4].fpr == pytest.approx(np.mean(s[y == 0] >= cut))


def test_metrics_of_undefined_rates(spark):
    row = metrics.binary_metrics(spark.createDataFrame([(0, 0)], "label int, pred int")).first()
    assert (row.precision, row.recall, row.f1, row.fpr, row.accuracy) == (0, 0, 0, 0, 1)


def test_detectors_and_fusion(spark):
    df = spark.createDataFrame([(0.0, 27.5, None), (0.0, 28.0, 30.0), (1.0, 0.0, 50.0), (0.0, 1.5, None)], "deauth_packets double, total_packets double, thr double")
    got = df.select(rules.absolute_detector().alias("a"), rules.relative_detector(F.col("thr")).alias("r")).collect()
    assert [tuple(r) for r in got] == [(0, 1), (1, 0), (1, 1), (0, 1)]
    scores = spark.createDataFrame([(1, 0.6, 0.9), (0, 0.2, 0.85), (0, 0.4, 0.84)], "pw int, sw double, sh double")
    pred, score = rules.gated_or_fusion(F.col("pw"), F.col("sw"), F.col("sh"))
    assert [tuple(r) for r in scores.select(pred, score).collect()] == [(1, 0.9), (1, 0.85), (0, 0.4)]


def test_feature_stats(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 5)], "heap double")
    r = quality.feature_stats(df, ("heap",)).first()
    assert (r.mean, r.min, r.max, r.p50, r.frac_zero) == (2.0, 0.0, 5.0, 1.5, 0.25)
    assert r.std == pytest.approx(np.std([0, 1, 2, 5], ddof=1))
