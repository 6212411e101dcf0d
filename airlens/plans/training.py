"""Model fits and their reports on Spark MLlib.

The window table is staged once; every fit and every evaluation reads that table. Fitted
trees are turned into column expressions, so that several models are scored in one pass
over the test rows.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens import schema as S
from airlens.functions.trees import tree_from_model, tree_node_rows, tree_pred, tree_prob, tree_rules
from airlens.operators import metrics, ordered, quality, rules
from airlens.operators.stage import stage
from airlens.plans import projections
from airlens.plans.exact_trees import Forest, Tree, TreeSpec, grow
from airlens.plans.split import (
    NEUTRAL_SETS, ROW_KEY, SEED, balanced_weights, class_weights, join_fills, neutralize, stratified_folds, stratified_split,
)
from airlens.session import ensure_checkpoint_dir

MAX_BINS = 256
PARALLEL_FITS = 8

# The column sets compared with the full one.
ABLATION_SETS: dict[str, tuple[str, ...]] = {
    "full": S.WINDOW_FEATURES,
    "wireless_only": S.NIDS_ONLY,
    "no_p0_wids": (*S.NIDS_BASELINE, *S.HIDS),
    "wireless_baseline": S.NIDS_BASELINE,
    "no_heap": S.NO_HEAP,
    "hids_sans_heap": (*S.NIDS_ONLY, *S.HIDS_NO_HEAP),
}


@dataclass
class TrainingSet:
    """A staged window table with ``is_test`` and ``weight``."""

    rows: DataFrame

    @property
    def train(self) -> DataFrame:
        return self.rows.where(~F.col("is_test"))

    @property
    def test(self) -> DataFrame:
        return self.rows.where("is_test")

    @classmethod
    def of(cls, windows: DataFrame, test_share: float = 0.3, seed: int = SEED) -> TrainingSet:
        from airlens.operators.quality import require_both_classes

        base = stage(windows)
        require_both_classes(base)
        rows = stratified_split(base, test_share, seed)
        train = rows.where(~F.col("is_test"))
        return cls(stage(balanced_weights(rows, of=train)))


def _assembled(features: Sequence[str], classifier) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), classifier])


def fit_tree(train: DataFrame, features: Sequence[str] = S.WINDOW_FEATURES, depth: int = 4, label: str = "label", leaf: int = 1):
    """Shallow decision tree on weighted rows (M3)."""
    tree = DecisionTreeClassifier(
        featuresCol="features", labelCol=label, weightCol="weight", maxDepth=depth, maxBins=MAX_BINS,
        impurity="gini", minInstancesPerNode=leaf, seed=SEED,
    )
    return _assembled(features, tree).fit(train)


def fit_forest(train: DataFrame, features: Sequence[str] = S.WINDOW_FEATURES, trees: int = 80, depth: int = 6):
    """Random forest (M4)."""
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth,
        maxBins=MAX_BINS, impurity="gini", seed=SEED,
    )
    return _assembled(features, forest).fit(train)


def fit_boosted(train: DataFrame, features: Sequence[str] = S.WINDOW_FEATURES, rounds: int = 80, depth: int = 4, step: float = 0.1):
    """Gradient-boosted trees (M5); stands for both optional boosters, which are unweighted."""
    ensure_checkpoint_dir(train.sparkSession)
    boosted = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=step,
        maxBins=MAX_BINS, seed=SEED, checkpointInterval=10,
    )
    return _assembled(features, boosted).fit(train)


def exact_tree(train: DataFrame, features: Sequence[str] = S.WINDOW_FEATURES, depth: int = 4, label: str = "label", leaf: int = 1) -> Tree:
    """Shallow tree over every threshold, classes balanced (M3)."""
    return grow(train, [TreeSpec("tree", features, depth, leaf, label)])["tree"]


# Parts of 2**32 below which a Poisson variable of mean 1 is at most 0, 1, 2, ...
DRAWS = tuple(int(x * 2**32) for x in itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(10)))


def draws(tree: int, seed: int = SEED, key: Sequence[str] = ROW_KEY) -> Column:
    """How often a row counts in a tree's sample with replacement, from a hash, so that any engine draws the same (M4)."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(str(tree)), *[F.col(c).cast("string") for c in key])
    u = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return sum([(u >= limit).cast("long") for limit in DRAWS], F.lit(0).cast("long"))


def node_features(tree: int, node: int, features: Sequence[str], n: int, seed: int = SEED) -> list[str]:
    """``n`` features of a node, the first by a hash of tree, node and the feature's place among all."""
    def key(f: str) -> str:
        return hashlib.md5(f"{seed}|{tree}|{node}|{S.WINDOW_FEATURES.index(f) + 1}".encode()).hexdigest()

    return sorted(features, key=key)[:n]


def exact_forest(train: DataFrame, trees: int = 80, depth: int = 6, features: Sequence[str] = S.WINDOW_FEATURES, seed: int = SEED) -> Forest:
    """Random forest any engine can repeat: samples and features by hashes, every threshold (M4)."""
    n = max(1, math.isqrt(len(features)))
    sizes = class_weights(train)
    weights = tuple(sizes.get(c, 0.0) for c in (0, 1))
    specs = [
        TreeSpec(str(t), features, depth, times=draws(t, seed), weights=weights, choice=lambda node, t=t: node_features(t, node, features, n, seed)) for t in range(trees)
    ]
    grown = grow(train, specs)
    return Forest([grown[s.name] for s in specs])


def model_tree(model, features: Sequence[str]) -> tuple:
    """A fitted tree as nested nodes (R2)."""
    return tree_from_model(model.stages[-1], list(features))


def predict(model, df: DataFrame) -> DataFrame:
    """``pred`` and ``score`` of any fitted model."""
    if hasattr(model, "scored"):
        return model.scored(df)
    return model.transform(df).withColumns({
        "pred": F.col("prediction").cast("int"), "score": vector_to_array("probability")[1],
    }).drop("features", "rawPrediction", "probability", "prediction")


def predict_trees(df: DataFrame, trees: dict[str, tuple]) -> DataFrame:
    """One row per input row and tree, all trees in one pass."""
    each = [F.struct(F.lit(n).alias("model"), tree_prob(t).alias("score"), tree_pred(t).alias("pred")) for n, t in trees.items()]
    keep = ["capture_id", "window_us", "label", "attack_type"]
    return df.withColumn("_x", F.explode(F.array(*each))).select(*keep, "_x.*")


def evaluate(scored: DataFrame) -> DataFrame:
    """All binary metrics and the AUC per ``model``."""
    auc = metrics.roc_auc(scored, by=("model",)).select("model", "auc")
    return metrics.binary_metrics(scored, by=("model",)).join(auc, "model", "left")


def fit_many(jobs: dict[str, callable]) -> dict:
    """Run independent fits at the same time; each is a set of Spark jobs."""
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        futures = {name: pool.submit(job) for name, job in jobs.items()}
        return {name: f.result() for name, f in futures.items()}


# ---- R2 --------------------------------------------------------------------------------

def tree_to_sql(ts: TrainingSet) -> tuple[DataFrame, list[str], tuple]:
    """Node table, readable rules and nested form of the tree fitted on all features (R2)."""
    tree = exact_tree(ts.train).nested()
    nodes = ts.rows.sparkSession.createDataFrame(
        tree_node_rows(tree), "node_id long, feature string, threshold double, p_normal double, p_attack double"
    )
    return nodes, tree_rules(tree), tree


# ---- M9-M12 ----------------------------------------------------------------------------

def feature_ablation(ts: TrainingSet) -> DataFrame:
    """The same tree on each column set, and what F1 and FPR lose or gain (M9)."""
    grown = grow(ts.train, [TreeSpec(name, f) for name, f in ABLATION_SETS.items()])
    trees = {name: grown[name].nested() for name in ABLATION_SETS}
    scored = evaluate(predict_trees(ts.test, trees))
    full = scored.where("model = 'full'").select("f1", "fpr").first()
    return scored.select(
        "model", "precision", "recall", "f1", "fpr", "auc",
        (F.lit(full["f1"]) - F.col("f1")).alias("f1_lift_of_full"), (F.col("fpr") - F.lit(full["fpr"])).alias("fpr_change"),
    )


def importance_rows(model, features: Sequence[str]) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, values)), key=lambda x: -x[1])


def feature_group(name: str) -> str:
    return "host" if name in S.HIDS else "rf_soft" if name in S.RF_SOFT else "counts"


def feature_importance(ts: TrainingSet) -> DataFrame:
    """Importances of the full and the wireless-only tree, with sums per group.

    ``heap_over_limit`` is the export gate: heap carries more than the allowed share.
    """
    sets = {"full": S.WINDOW_FEATURES, "wireless_only": S.NIDS_ONLY}
    grown = grow(ts.train, [TreeSpec(n, f) for n, f in sets.items()])
    rows = [(n, f, feature_group(f), v) for n, tree in grown.items() for f, v in tree.importances()]
    table = ts.rows.sparkSession.createDataFrame(rows, "model string, feature string, feature_group string, importance double")
    sums = table.groupBy("model", "feature_group").agg(F.sum("importance").alias("group_importance"))
    heap = F.col("feature").eqNullSafe("heap") & (F.col("importance") > S.MAX_HEAP_IMPORTANCE)
    return table.where("importance > 0").join(sums, ["model", "feature_group"]).withColumn("heap_over_limit", heap)


def neutralized_models(ts: TrainingSet) -> DataFrame:
    """Trees on the full layout with columns held constant, per variant."""
    scored, extra = None, []
    for name, columns in NEUTRAL_SETS.items():
        rows, fills = neutralize(ts.rows, columns)
        tree = exact_tree(rows.where(~F.col("is_test")))
        part = predict_trees(join_fills(ts.test, fills), {name: tree.nested()})
        scored = part if scored is None else scored.unionByName(part)
        imp = dict(tree.importances())
        extra.append((
            name, imp["heap"], sum(imp[f] for f in S.HIDS), sum(imp[f] for f in S.RF_SOFT),
            {k: float(v) for k, v in fills.items()},
        ))
    sums = ts.rows.sparkSession.createDataFrame(
        extra, "model string, heap_importance double, host_importance double, rf_soft_importance double, fills map<string,double>"
    )
    return evaluate(scored).select("model", "precision", "recall", "f1", "fpr", "auc").join(sums, "model")


def distill(ts: TrainingSet, teacher: Forest | PipelineModel | None = None) -> Tree:
    """A depth-4 tree fitted on another model's training predictions, their classes balanced."""
    teacher = exact_forest(ts.train) if teacher is None else teacher
    return exact_tree(stage(predict(teacher, ts.train)), label="pred")


# ---- M16 -------------------------------------------------------------------------------

DEPTHS = (2, 3, 4, 5, 6, 8)
LEAVES = (1, 5, 10, 20)


def grid_search(ts: TrainingSet, depths: Sequence[int] = DEPTHS, leaves: Sequence[int] = LEAVES, folds: int = 3) -> DataFrame:
    """Cross-validated F1 over depth and leaf size; test F1 of the best and the default."""
    train = stage(stratified_folds(ts.train, folds))
    fitted = grow(train, [
        TreeSpec(f"{leaf}|{fold}", depth=max(depths), leaf=leaf, times=(F.col("fold") != fold).cast("long")) for leaf in leaves for fold in range(folds)
    ])
    # Trees grow level by level, so a shallower tree is the upper part of the deepest.
    held = None
    for fold in range(folds):
        trees = {f"{d}|{leaf}|{fold}": fitted[f"{leaf}|{fold}"].nested(d) for d in depths for leaf in leaves}
        part = predict_trees(train.where(F.col("fold") == fold), trees)
        held = part if held is None else held.unionByName(part)
    f1 = {r["model"]: r["f1"] for r in metrics.binary_metrics(held, by=("model",)).collect()}
    table = []
    for d in depths:
        for leaf in leaves:
            each = [f1[f"{d}|{leaf}|{fold}"] for fold in range(folds)]
            mean = sum(each) / folds
            table.append((d, leaf, mean, math.sqrt(sum((x - mean) ** 2 for x in each) / folds)))
    # Equal means differ in their last bits by the order of the folds.
    top = max(round(m, 12) for _, _, m, _ in table)
    chosen = next(i for i, t in enumerate(table) if round(t[2], 12) == top)
    whole = grow(ts.train, [TreeSpec("best", depth=table[chosen][0], leaf=table[chosen][1]), TreeSpec("default")])
    test = {r["model"]: r["f1"] for r in metrics.binary_metrics(
        predict_trees(ts.test, {n: t.nested() for n, t in whole.items()}), by=("model",)).collect()}
    out = [(*t, i == chosen, test["best"] if i == chosen else None, test["default"]) for i, t in enumerate(table)]
    return ts.rows.sparkSession.createDataFrame(
        out, "max_depth int, min_leaf int, mean_cv_f1 double, std_cv_f1 double, is_best boolean, best_test_f1 double, default_test_f1 double"
    ).orderBy(F.desc("mean_cv_f1"), "max_depth", "min_leaf")


# ---- M17, M18 --------------------------------------------------------------------------

def dual_expert_eval(ts: TrainingSet, gate: float = S.EXPERT_H_GATE) -> DataFrame:
    """Wireless and host expert, their fusions, overlap and busy-time alert rates.

    Besides: importances of both, fills of the wireless one, types among the training rows,
    and the peak time of each capture's busy stretch.
    """
    neutral, fills = neutralize(ts.rows, (*S.HIDS, *S.RF_SOFT))
    grown = {"W": exact_tree(neutral.where(~F.col("is_test"))), "H": exact_tree(ts.train, S.HIDS)}
    fitted = {n: (tree.nested(), tree.importances()) for n, tree in grown.items()}

    def scored(df: DataFrame) -> DataFrame:
        host = df.withColumns({"host_score": tree_prob(fitted["H"][0]), "host_pred": tree_pred(fitted["H"][0])})
        w = join_fills(host, fills).withColumns({"w_score": tree_prob(fitted["W"][0]), "w_pred": tree_pred(fitted["W"][0])})
        cols = [F.col(c) for c in ("w_pred", "host_pred", "w_score", "host_score")]
        either, either_score = rules.or_fusion(*cols)
        gated, gated_score = rules.gated_or_fusion(F.col("w_pred"), F.col("w_score"), F.col("host_score"), gate)
        pairs = {"W": (cols[0], cols[2]), "H": (cols[1], cols[3]), "OR": (either, either_score), "OR_gated": (gated, gated_score)}
        return w.withColumn("_x", F.explode(F.array(*[
            F.struct(F.lit(n).alias("model"), p.cast("int").alias("pred"), s.alias("score")) for n, (p, s) in pairs.items()
        ]))).select("capture_id", "window_us", "label", "attack_type", "w_pred", "host_pred", "_x.*")

    test = scored(ts.test)
    table = _long(evaluate(test), "metric", ("precision", "recall", "f1", "fpr", "auc", "accuracy"))
    recall = metrics.per_attack_recall(test, by=("model",)).select(
        F.lit("recall").alias("section"), "model", F.col("attack_type").alias("name"), F.col("recall").alias("value")
    )
    overlap = rules.compare_experts(test.where("model = 'W'"), "w_pred", "host_pred")
    overlap = _long(overlap.withColumn("model", F.lit("W,H")), "overlap", ("both_attack", "only_w", "only_h", "n"))
    busy = scored(ordered.busy_windows(ts.rows)).groupBy("model").agg(
        F.avg(F.col("pred").cast("double")).alias("attack_rate"), F.count(F.lit(1)).alias("n")
    )
    spark, w_rows, h_rows = ts.rows.sparkSession, fitted["W"][1], fitted["H"][1]
    rows = [("importance", m, f, v) for m, found in (("W", w_rows), ("H", h_rows)) for f, v in found]
    rows += [("fill", "W", f, float(v)) for f, v in sorted(fills.items())]
    facts = spark.createDataFrame(rows, "section string, model string, name string, value double")
    types = ts.train.groupBy("attack_type").count().select(
        F.lit("train_types").alias("section"), F.lit("W,H").alias("model"), F.col("attack_type").alias("name"), F.col("count").cast("double").alias("value")
    )
    peak = ordered.busy_peak(ts.rows).select(
        F.lit("busy_peak_us").alias("section"), F.lit("").alias("model"), F.col("capture_id").cast("string").alias("name"), F.col("peak_us").cast("double").alias("value")
    )
    parts = [recall, overlap, _long(busy, "busy", ("attack_rate", "n")), facts, types, peak]
    return reduce(lambda a, b: a.unionByName(b), parts, table)


def _long(df: DataFrame, section: str, names: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(F.lit(section).alias("section"), "model", F.explode(pairs).alias("_p")).select("section", "model", "_p.*")


MODEL_ORDER = ("DecisionTree", "RandomForest", "GradientBoosted", "XGBoost", "LightGBM")


def fitted_models(ts: TrainingSet) -> dict:
    return fit_many({
        "DecisionTree": lambda: Forest([exact_tree(ts.train)]), "RandomForest": lambda: fit_forest(ts.train),
        "GradientBoosted": lambda: fit_boosted(ts.train),
    })


def model_scores(ts: TrainingSet, models: dict) -> DataFrame:
    """Test rows scored by every model, staged since each metric reads them."""
    out = None
    for name, model in models.items():
        part = predict(model, ts.test).select("capture_id", "window_us", "label", "attack_type", "score", "pred").withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return stage(out)


def eval_report(ts: TrainingSet, models: dict | None = None) -> DataFrame:
    """Metrics of all models with the best by F1 marked; the earlier model wins ties."""
    scored = model_scores(ts, models or fitted_models(ts))
    table = stage(evaluate(scored))
    rank = {r["model"]: (-r["f1"], MODEL_ORDER.index(r["model"])) for r in table.select("model", "f1").collect()}
    best = min(rank, key=rank.get)
    long = _long(table, "metric", ("precision", "recall", "f1", "fpr", "auc", "accuracy", "tp", "fp", "fn", "tn"))
    recall = metrics.per_attack_recall(scored, by=("model",)).select(
        F.lit("recall").alias("section"), "model", F.col("attack_type").alias("name"), F.col("recall").alias("value")
    )
    return long.unionByName(recall).withColumn("is_best", F.col("model") == best)


def full_report(ts: TrainingSet, models: dict | None = None, top: int = 10) -> DataFrame:
    """The whole evaluation document: models, ablation, neutralised variants, importances, dataset, projections, grid.

    Rows of (section, model, name, value, is_best); ``write_report`` makes the file.
    """
    parts = [eval_report(ts, models)]

    def add(table: DataFrame) -> None:
        parts.append(table.select("section", "model", "name", F.col("value").cast("double").alias("value"), F.lit(False).alias("is_best")))

    add(_long(feature_ablation(ts), "ablation", ("precision", "recall", "f1", "fpr", "auc", "f1_lift_of_full", "fpr_change")))
    add(_long(neutralized_models(ts), "neutralized", ("precision", "recall", "f1", "fpr", "auc", "heap_importance", "host_importance", "rf_soft_importance")))
    add(feature_importance(ts).select(F.lit("importance").alias("section"), "model", F.col("feature").alias("name"), F.col("importance").alias("value")))
    summary = quality.dataset_summary(ts.rows)
    numbers = ("n_windows", "n_normal", "n_attack", "attack_fraction", "density_distinct", "total_packets_mode")
    add(_long(summary.withColumn("model", F.lit("")), "dataset", numbers))
    add(quality.type_counts(ts.rows).select(F.lit("dataset_types").alias("section"), F.lit("").alias("model"), F.col("attack_type").alias("name"), F.col("n_windows").alias("value")))
    for section, table in (("pca", projections.pca_report(ts.train, ts.rows, S.WINDOW_FEATURES)[0]), ("lda", projections.lda_binary(ts.train, ts.rows, S.WINDOW_FEATURES)[0])):
        of = F.concat_ws(" ", *[c for c in ("component", "feature") if c in table.columns])
        add(table.select(F.lit(section).alias("section"), F.col("name").alias("model"), of.alias("name"), "value"))
    grid = grid_search(ts).orderBy(F.desc("mean_cv_f1"), "max_depth", "min_leaf").limit(top)
    add(grid.select(F.lit("grid").alias("section"), F.lit("").alias("model"), F.format_string("depth %d leaf %d", "max_depth", "min_leaf").alias("name"), F.col("mean_cv_f1").alias("value")))
    return reduce(lambda a, b: a.unionByName(b), parts)
