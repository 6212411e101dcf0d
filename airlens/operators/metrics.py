"""Scores of predictions: confusion, recall per type, exact AUC and curve (M6-M8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.functions.scalars import is_attack_type
from airlens.operators.quantiles import cumulative_counts
from airlens.operators.stage import stage


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """Confusion counts and the rates from them; a rate over nothing is 0 (M6)."""
    y, p = F.col(label), F.col(pred)
    cells = df.groupBy(*by).agg(
        F.count(F.when((y == 1) & (p == 1), 1)).alias("tp"), F.count(F.when((y == 0) & (p == 1), 1)).alias("fp"),
        F.count(F.when((y == 1) & (p == 0), 1)).alias("fn"), F.count(F.when((y == 0) & (p == 0), 1)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.withColumns({
        "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "fpr": _ratio(fp, fp + tn), "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
        "precision_0": _ratio(tn, tn + fn), "recall_0": _ratio(tn, tn + fp), "f1_0": _ratio(2 * tn, 2 * tn + fp + fn),
        "support_1": tp + fn, "support_0": tn + fp,
    })


def per_attack_recall(df: DataFrame, pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """Share of windows of each attack type that are predicted 1 (M7)."""
    return df.where(is_attack_type(F.col("attack_type"))).groupBy(*by, "attack_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(pred) == 1).cast("double")).alias("recall")
    )


def score_counts(df: DataFrame, by: tuple[str, ...], label: str = "label", score: str = "score") -> DataFrame:
    return df.groupBy(*by, score).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("pos"), F.count(F.when(F.col(label) == 0, 1)).alias("neg")
    )


def roc_auc(df: DataFrame, by: tuple[str, ...] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Exact rank AUC with ties counted half; null where a class is missing (M8)."""
    keyed, by = (df, tuple(by)) if by else (df.withColumn("_all", F.lit(0)), ("_all",))
    counts = stage(score_counts(keyed, by, label, score))
    ranked = cumulative_counts(counts, by, score, ["pos", "neg"])
    below = F.col("neg_upto") - F.col("neg")
    out = ranked.groupBy(*by).agg(
        F.sum(F.col("pos") * (below + F.col("neg") / F.lit(2.0))).alias("_u"),
        F.max("pos_all").alias("n_pos"), F.max("neg_all").alias("n_neg"),
    ).withColumn("auc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_u") / (F.col("n_pos") * F.col("n_neg"))))
    return out.drop("_u", "_all")


def roc_curve(df: DataFrame, by: tuple[str, ...] = (), label: str = "label", score: str = "score") -> DataFrame:
    """One point per distinct score: rates when everything at or above it is an alert (M8)."""
    keyed, by = (df, tuple(by)) if by else (df.withColumn("_all", F.lit(0)), ("_all",))
    counts = stage(score_counts(keyed, by, label, score))
    ranked = cumulative_counts(counts, by, score, ["pos", "neg"]).withColumnsRenamed({"pos_all": "_p", "neg_all": "_n"})
    above = lambda c, t: F.col(t) - F.col(f"{c}_upto") + F.col(c)
    return ranked.withColumns({
        "tpr": F.when(F.col("_p") > 0, above("pos", "_p") / F.col("_p")),
        "fpr": F.when(F.col("_n") > 0, above("neg", "_n") / F.col("_n")),
    }).select(*[b for b in by if b != "_all"], F.col(score).alias("threshold"), "tpr", "fpr")
