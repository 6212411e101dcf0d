"""Data-quality gates and content reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlens import schema as S
from airlens.operators.quantiles import quantiles_of_counts
from airlens.operators.stage import stage


def class_counts(windows: DataFrame, *by: str) -> DataFrame:
    """Rows, positives and negatives."""
    return windows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("label") == 1, 1)).alias("n_pos"),
        F.count(F.when(F.col("label") == 0, 1)).alias("n_neg"),
    )


def require_both_classes(windows: DataFrame) -> tuple[int, int]:
    """Positives and negatives of a training set; raises where one is missing."""
    row = class_counts(windows).first()
    if not row["n_pos"] or not row["n_neg"]:
        raise ValueError("both classes are needed: collect a balanced set")
    return row["n_pos"], row["n_neg"]


def balance_gates(
    windows: DataFrame,
    min_normal: int = S.MIN_NORMAL_WINDOWS,
    min_per_attack: int = S.MIN_WINDOWS_PER_ATTACK,
    with_auth: bool = False,
    key: str = "capture_id",
) -> DataFrame:
    """One row per capture and gate: value, limit, ok, and the verdict over all gates."""
    types = list(S.REQUIRED_ATTACK_TYPES) + (list(S.OPTIONAL_ATTACK_TYPES) if with_auth else [])
    attack = F.col("label") == 1
    counts = windows.groupBy(key).agg(
        F.count(F.when(~attack, 1)).alias("_normal"), F.count(F.when(attack, 1)).alias("_attack"),
        *[F.count(F.when(attack & (F.col("attack_type") == t), 1)).alias(f"_{t}") for t in types],
    )

    def gate(name: str, value: Column, limit: float, ok: Column) -> Column:
        return F.struct(
            F.lit(name).alias("gate"), value.cast("double").alias("value"), F.lit(float(limit)).alias("limit"),
            F.coalesce(ok, F.lit(False)).alias("ok"),
        )

    ratio = F.when(F.col("_normal") > 0, F.col("_attack") / F.col("_normal"))
    share = F.when(F.col("_attack") > 0, F.col("_SYN_FLOOD") / F.col("_attack"))
    gates = [gate("normal_count", F.col("_normal"), min_normal, F.col("_normal") >= min_normal)]
    gates += [gate(f"attack_{t}", F.col(f"_{t}"), min_per_attack, F.col(f"_{t}") >= min_per_attack) for t in types]
    gates.append(gate("not_syn_dominated_ratio", ratio, S.MAX_ATTACK_OVER_NORMAL, ratio <= S.MAX_ATTACK_OVER_NORMAL))
    syn = gate("syn_share", share, S.MAX_SYN_SHARE, share <= S.MAX_SYN_SHARE)
    every = F.array(*gates, F.when(F.col("_attack") > 0, syn))
    rows = counts.select(key, F.filter(every, lambda g: g.isNotNull()).alias("_g"))
    return rows.select(
        key, F.forall("_g", lambda g: g["ok"]).alias("all_ok"), F.explode("_g").alias("_x")
    ).select(key, "_x.gate", "_x.value", "_x.limit", "_x.ok", "all_ok")


def feature_stats(windows: DataFrame, features: tuple[str, ...] = S.WINDOW_FEATURES) -> DataFrame:
    """Mean, sample deviation, range, median and share of zeros per feature.

    Windows are read once and folded to value counts per feature, from which all follows.
    """
    counts = stage(windows.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features
    ])).alias("_x")).select("_x.*").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    v, n = F.col("value"), F.col("n")
    stats = counts.groupBy("feature").agg(
        F.sum("n").alias("_n"), (F.sum(v * n) / F.sum("n")).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        (F.sum(F.when(v == 0, n).otherwise(0)) / F.sum("n")).alias("frac_zero"),
    )
    spread = counts.join(stats.select("feature", "mean", "_n"), "feature").groupBy("feature").agg(
        F.sqrt(F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))) / F.nullif(F.max("_n") - 1, F.lit(0))).alias("std")
    )
    medians = quantiles_of_counts(counts, ["feature"], "value", {"p50": 0.5})
    return stats.drop("_n").join(spread, "feature").join(medians, "feature")


def type_counts(windows: DataFrame) -> DataFrame:
    """Windows of every type, NONE included."""
    return windows.groupBy("attack_type").agg(F.count(F.lit(1)).alias("n_windows"))


def cleaning_counts(prepared: DataFrame) -> DataFrame:
    """How many windows had an impossible signal mean, and how many of those mirrored it."""
    return prepared.agg(
        F.count(F.lit(1)).alias("n_windows"), F.count(F.when(F.col("rf_bad"), 1)).alias("n_rf_bad"), F.count(F.when(F.col("rf_mirror"), 1)).alias("n_rf_mirror")
    )


def dataset_summary(windows: DataFrame) -> DataFrame:
    """Size, time range, density spread, commonest total and warnings of a set."""
    windows = stage(windows.select("label", "window_us", "total_packets", "packet_density", "minheap"))
    totals = windows.groupBy("total_packets").agg(F.count(F.lit(1)).alias("_n"))
    common = totals.agg(F.max_by("total_packets", F.struct("_n", -F.col("total_packets"))).alias("total_packets_mode"))
    mode = common.first()["total_packets_mode"]
    out = windows.agg(
        F.count(F.lit(1)).alias("n_windows"), F.count(F.when(F.col("label") == 0, 1)).alias("n_normal"),
        F.count(F.when(F.col("label") == 1, 1)).alias("n_attack"), F.min("window_us").alias("first_us"),
        F.max("window_us").alias("last_us"), F.count_distinct("packet_density").alias("density_distinct"),
        F.stddev_samp("minheap").alias("_minheap_std"),
    )
    return out.select(
        "n_windows", "n_normal", "n_attack", F.try_divide("n_attack", "n_windows").alias("attack_fraction"),
        "first_us", "last_us", "density_distinct", F.lit(mode).cast("double").alias("total_packets_mode"),
        (F.col("density_distinct") <= 4).alias("warn_density_constant"),
        F.coalesce(F.col("_minheap_std") < 1e-6, F.lit(False)).alias("warn_minheap_constant"),
    )


def visibility_report(packets: DataFrame, key: str = "capture_id") -> DataFrame:
    """What each attack type leaves visible, next to the idle part of its capture (A10)."""
    is_auth = F.col("subtype") == "AUTH"
    by_type = packets.groupBy(key, "attack_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.coalesce("gw_flip", F.lit(0))).alias("max_gw_flip"),
        F.count(F.when(is_auth, 1)).alias("auth_rows"),
        F.count(F.when(F.col("subtype").startswith("PROBE"), 1)).alias("probe_rows"),
    )
    idle = F.col("attack_type") == "NONE"
    every = Window.partitionBy(key)  # a handful of types per capture
    return by_type.select(
        key, "attack_type", "n_rows", "max_gw_flip", "auth_rows",
        (F.col("auth_rows") / F.col("n_rows")).alias("auth_share"),
        (F.col("probe_rows") / F.col("n_rows")).alias("probe_share"),
        F.max(F.when(idle, F.col("auth_rows") / F.col("n_rows"))).over(every).alias("idle_auth_share"),
        F.max(F.when(idle, F.col("probe_rows") / F.col("n_rows"))).over(every).alias("idle_probe_share"),
    )
