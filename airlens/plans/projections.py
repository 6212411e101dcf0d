"""Principal components and linear discriminants from distributed moment sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moment_sums(df: DataFrame, features: Sequence[str], by: str) -> dict[str, np.ndarray]:
    """Per class, the sums of products of ``[1, x]``: count, sums and cross products.

    Each task folds its rows to one small matrix per class; the matrices are added up on
    Spark, so the driver gets one matrix per class.
    """
    names, p = list(features), len(features) + 1

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[str, np.ndarray] = {}
        for pdf in batches:
            for cls, part in pdf.groupby("_cls"):
                x = np.column_stack([np.ones(len(part)), part[names].to_numpy(dtype=float)])
                acc[cls] = acc.get(cls, 0.0) + x.T @ x
        i, j = (a.ravel() for a in np.indices((p, p)))
        for cls, m in acc.items():
            yield pd.DataFrame({"cls": cls, "i": i, "j": j, "v": m.ravel()})

    sums = df.select(F.col(by).cast("string").alias("_cls"), *names).mapInPandas(
        fold, "cls string, i int, j int, v double"
    ).groupBy("cls", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for cls, part in sums.groupby("cls"):
        m = np.zeros((p, p))
        m[part["i"], part["j"]] = part["v"]
        out[cls] = m
    return out


def standardizer(train: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column keeps scale 1."""
    row = train.agg(
        *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]
    ).first()
    return {f: (row[f"m_{f}"], row[f"s_{f}"] or 1.0) for f in features}


def standardize(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f: (F.col(f).cast("double") - m) / s for f, (m, s) in scale.items()})


def _linear(features: Sequence[str], weights: np.ndarray, bias: float) -> Column:
    terms = [F.col(f) * F.lit(float(w)) for f, w in zip(features, weights)]
    return reduce(lambda a, b: a + b, terms, F.lit(float(bias)))


def _scatter(sums: dict[str, np.ndarray]):
    """Class sizes, means, grand mean and pooled within-class covariance."""
    n = {c: m[0, 0] for c, m in sums.items()}
    mean = {c: m[0, 1:] / m[0, 0] for c, m in sums.items()}
    within = sum(m[1:, 1:] - n[c] * np.outer(mean[c], mean[c]) for c, m in sums.items())
    total = sum(n.values())
    grand = sum(n[c] * mean[c] for c in sums) / total
    return n, mean, grand, within / max(total - len(sums), 1)


def lda_binary(train: DataFrame, every: DataFrame, features: Sequence[str], label: str = "label", top: int = 8):
    """One discriminant between the classes (M14): (report table, scored rows).

    Constant columns make the within-class covariance singular, so its pseudo-inverse is used.
    """
    scale = standardizer(train, features)
    z = standardize(train, scale)
    n, mean, grand, within = _scatter(moment_sums(z, features, label))
    coef = np.linalg.pinv(within, hermitian=True) @ (mean["1"] - mean["0"])
    total = n["0"] + n["1"]
    bias = -coef @ (mean["0"] + mean["1"]) / 2 + np.log(n["1"] / n["0"])
    right = z.agg(F.avg((F.when(_linear(features, coef, bias) > 0, 1).otherwise(0) == F.col(label)).cast("double"))).first()[0]
    order = sorted(range(len(features)), key=lambda i: -abs(coef[i]))
    rows = [("train_accuracy", "", float(right)), ("n_train", "", float(total))]
    rows += [("coef", features[i], float(coef[i])) for i in order[:top]]
    if "heap" in features:
        rows.append(("heap_coef", "heap", float(coef[list(features).index("heap")])))
    report = train.sparkSession.createDataFrame(rows, "name string, feature string, value double")
    length = float(np.sqrt(max(coef @ within @ coef, 1e-300)))
    score = _linear(features, coef / length, -float(coef @ grand) / length)
    return report, standardize(every, scale).withColumn("ld1", score)


def lda_multiclass(train: DataFrame, every: DataFrame, features: Sequence[str], by: str, components: int = 2):
    """Up to two discriminants between three or more types (M15): (report table, scored rows).

    The scaler is from the training rows, the discriminants from all rows.
    """
    scale = standardizer(train, features)
    z = standardize(every, scale)
    sums = moment_sums(z, features, by)
    if len(sums) < 3:
        raise ValueError("at least three types are needed")
    n, mean, grand, within = _scatter(sums)
    values, vectors = np.linalg.eigh(within)
    keep = values > 1e-10 * values.max()
    white = vectors[:, keep] / np.sqrt(values[keep])
    spread = np.array([np.sqrt(n[c]) * (mean[c] - grand) @ white for c in sorted(sums)])
    _, s, vt = np.linalg.svd(spread, full_matrices=False)
    k = min(components, len(sums) - 1)
    share = s**2 / (s**2).sum()
    axes = white @ vt.T[:, :k]
    for j in range(k):
        axes[:, j] *= np.sign(axes[np.abs(axes[:, j]).argmax(), j]) or 1.0
    rows = [("explained", f"LD{j + 1}", float(share[j])) for j in range(k)] + [("n_classes", "", float(len(sums)))]
    report = every.sparkSession.createDataFrame(rows, "name string, component string, value double")
    scored = z.withColumns({f"ld{j + 1}": _linear(features, axes[:, j], -float(grand @ axes[:, j])) for j in range(k)})
    return report, scored


def pca_report(train: DataFrame, every: DataFrame, features: Sequence[str], components: int = 10, top: int = 6):
    """Components of the standardised training rows (M13): (report table, scores of all rows).

    The sign of a component is chosen so that its largest loading is positive.
    """
    n = train.count()
    k = min(components, len(features), n)
    assembler = VectorAssembler(inputCols=list(features), outputCol="_raw")
    scaler = StandardScaler(inputCol="_raw", outputCol="_z", withMean=True, withStd=True).fit(assembler.transform(train))
    model = PCA(k=k, inputCol="_z", outputCol="_pc").fit(scaler.transform(assembler.transform(train)))
    share = model.explainedVariance.toArray()
    loads = np.array(model.pc.toArray())
    signs = np.sign(loads[np.abs(loads).argmax(axis=0), range(k)])
    signs[signs == 0] = 1.0
    loads = loads * signs
    rows = [("explained", f"PC{i + 1}", "", float(v)) for i, v in enumerate(share)]
    rows += [("cumulative", f"PC{i + 1}", "", float(v)) for i, v in enumerate(np.cumsum(share))]
    for i in range(min(2, k)):
        order = sorted(range(len(features)), key=lambda j: -abs(loads[j, i]))[:top]
        rows += [("loading", f"PC{i + 1}", features[j], float(loads[j, i])) for j in order]
    if "heap" in features:
        rows.append(("heap_loading", "PC1", "heap", float(loads[list(features).index("heap"), 0])))
    report = train.sparkSession.createDataFrame(rows, "name string, component string, feature string, value double")
    # The scaler divides by the sample deviation; scores are put on the population scale.
    to_pop = float(np.sqrt(n / max(n - 1, 1)))
    pc = vector_to_array("_pc")
    scores = model.transform(scaler.transform(assembler.transform(every))).withColumns({
        f"pc{i + 1}": pc[i] * float(signs[i] * to_pop) for i in range(k)
    }).drop("_raw", "_z", "_pc")
    return report, scores
