"""Detectors, their reports and fused experts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens import schema as S
from airlens.functions.trees import TREES, tree_pred, tree_prob
from airlens.operators.calibration import baseline_of, join_thresholds, ranked_idle
from airlens.operators.ordered import before_attack, busy_peak, first_attack
from airlens.operators.quantiles import quantiles
from airlens.operators.stage import stage


def score_tree(windows: DataFrame, tree: str | tuple = "deployed", prob: str = "raw_prob", pred: str = "raw_pred") -> DataFrame:
    """Attack share and decision of a fixed tree."""
    node = TREES[tree] if isinstance(tree, str) else tree
    return windows.withColumns({prob: tree_prob(node), pred: tree_pred(node)})


def absolute_detector(threshold: float = S.ABSOLUTE_TOTAL_THRESHOLD) -> Column:
    """Deauth seen, or more packets than a fixed limit."""
    return ((F.col("deauth_packets") > 0.5) | (F.col("total_packets") > threshold)).cast("int")


def relative_detector(threshold: Column) -> Column:
    """Deauth seen, or more packets than the capture's own limit."""
    limit = F.coalesce(threshold, F.lit(1.0))
    return ((F.col("deauth_packets") > 0.5) | (F.col("total_packets") > limit)).cast("int")


# Attack types reported per detector.
REPORTED_TYPES = {
    "deauth_recall": "DEAUTH", "auth_flood_rate": "AUTH_FLOOD", "syn_recall": "SYN_FLOOD",
    "arp_recall": "ARP_SPOOF",
}


def detector_report(windows: DataFrame, k: float = S.CALIB_K, frac: float = 0.3, key: str = "capture_id") -> DataFrame:
    """False alerts and recall per capture, for the absolute and the relative detector.

    A rate over no windows is null.
    """
    slim = stage(windows.select(key, "window_us", "label", "attack_type", "deauth_packets", "total_packets"))
    ranked = ranked_idle(slim, frac, key)
    baseline = stage(baseline_of(ranked, k, key))  # a row a capture
    calib_end = ranked.where("is_calib").groupBy(key).agg(F.max("window_us").alias("_calib_end"))
    judged = join_thresholds(slim, baseline, key).join(calib_end, key, "left").withColumns({
        "absolute": absolute_detector(), "relative": relative_detector(F.col("threshold")),
    })
    held = (F.col("attack_type") == "NONE") & (F.col("window_us") > F.col("_calib_end"))
    both = judged.select(
        key, "label", "attack_type", held.alias("_held"),
        F.explode(F.array(
            F.struct(F.lit("absolute").alias("detector"), F.col("absolute").alias("pred")),
            F.struct(F.lit("relative").alias("detector"), F.col("relative").alias("pred")),
        )).alias("_d"),
    ).select("*", "_d.detector", "_d.pred")
    rate = lambda cond: F.avg(F.when(cond, F.col("pred").cast("double")))
    return both.groupBy(key, "detector").agg(
        rate(F.col("label") == 0).alias("fpr_all_none"), rate(F.col("_held")).alias("fpr_holdout_none"),
        *[rate(F.col("attack_type") == t).alias(n) for n, t in REPORTED_TYPES.items()],
    )


def or_fusion(pred_w: Column, pred_h: Column, score_w: Column, score_h: Column) -> tuple[Column, Column]:
    """Either expert alerts; the higher score."""
    return F.greatest(pred_w, pred_h), F.greatest(score_w, score_h)


def gated_or_fusion(pred_w: Column, score_w: Column, score_h: Column, gate: float = S.EXPERT_H_GATE) -> tuple[Column, Column]:
    """The host expert only counts from ``gate`` on."""
    sure = score_h >= gate
    pred = ((pred_w == 1) | sure).cast("int")
    score = F.when(pred_w == 1, F.greatest(score_w, score_h)).when(sure, score_h).otherwise(score_w)
    return pred, score


def compare_experts(scored: DataFrame, pred_w: str, pred_h: str, *by: str) -> DataFrame:
    """Windows both experts flag, and those only one flags."""
    a, b = F.col(pred_w) == 1, F.col(pred_h) == 1
    return scored.groupBy(*by).agg(
        F.count(F.when(a & b, 1)).alias("both_attack"), F.count(F.when(a & ~b, 1)).alias("only_w"),
        F.count(F.when(~a & b, 1)).alias("only_h"), F.count(F.lit(1)).alias("n"),
    )


def segment_rates(
    windows: DataFrame, preds: dict[str, str], medians: tuple[str, ...] = ("packet_density", "udpfail"), key: str = "capture_id"
) -> DataFrame:
    """Predicted-attack rates and medians on named segments of each capture.

    A window may lie in several segments: all normal, normal before the first attack, the
    densest 20 and 10 per cent of those, the stretch around the density peak, and its attack
    type. Segment membership is one array per row, so the windows are read once.
    """
    used = {key, "window_us", "label", "attack_type", "packet_density", *preds.values(), *medians}
    windows = stage(windows.select(*sorted(used)))
    early = before_attack(windows.select(key, "window_us", "label", "packet_density"), key)
    cuts = quantiles(early, [key], "packet_density", {"_p80": 0.8, "_p90": 0.9})
    edges = stage(first_attack(windows, key).join(cuts, key, "left").join(
        busy_peak(windows.select(key, "window_us", "label", "packet_density"), key), key, "left"
    ))
    w = windows.join(edges, key, "left")
    pre = (F.col("label") == 0) & (F.col("window_us") < F.col("first_attack_us"))
    dens = F.col("packet_density")
    names = F.array(
        F.when(F.col("label") == 0, "all_NORMAL"), F.when(pre, "pre_attack_NORMAL"),
        F.when(pre & (dens >= F.col("_p80")), "pre_dens_p80"), F.when(pre & (dens >= F.col("_p90")), "pre_dens_p90"),
        F.when(pre & (F.abs(F.col("window_us") - F.col("peak_us")) <= 90_000_000), "BUSY_peak_pm90s"),
        F.when(F.col("label") == 1, F.col("attack_type")),
    )
    rows = w.withColumn("segment", F.explode(F.filter(names, lambda s: s.isNotNull())))
    rates = rows.groupBy(key, "segment").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col(c).cast("double")).alias(name) for name, c in preds.items()],
    )
    for m in medians:
        rates = rates.join(quantiles(rows.select(key, "segment", m), [key, "segment"], m, {f"{m}_median": 0.5}), [key, "segment"])
    return rates
