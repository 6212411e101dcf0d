import numpy as np
import pytest
from pyspark.sql import functions as F

from airlens import adapter, schema as S
from airlens.functions.trees import tree_prob
from airlens.operators import windows
from airlens.plans import projections, split, training


@pytest.fixture(scope="module")
def ts(spark, sf_dir):
    return training.TrainingSet.of(windows.aggregate_windows(adapter.packets(spark, sf_dir)))


def test_split_shares_and_repeat(ts):
    sizes = {(r.label, r.is_test): r["count"] for r in ts.rows.groupBy("label", "is_test").count().collect()}
    for label in (0, 1):
        n = sizes[label, True] + sizes[label, False]
        assert sizes[label, True] == int(np.floor(0.3 * n + 0.5))
    again = split.stratified_split(ts.rows.drop("is_test"))
    assert again.join(ts.rows.select("capture_id", "window_us", F.col("is_test").alias("was")), ["capture_id", "window_us"]).where("is_test <> was").count() == 0
    folds = {(r.label, r.fold): r["count"] for r in split.stratified_folds(ts.train).groupBy("label", "fold").count().collect()}
    for label in (0, 1):
        mine = [n for (k, _), n in folds.items() if k == label]
        assert len(mine) == 3 and max(mine) - min(mine) <= 1


def test_weights_balance(ts):
    sums = {r.label: r.s for r in ts.train.groupBy("label").agg(F.sum("weight").alias("s")).collect()}
    assert sums[0] == pytest.approx(sums[1]) and sum(sums.values()) == pytest.approx(ts.train.count())


def test_fitted_tree_as_expression(ts):
    model = training.fit_tree(ts.train)
    tree = training.model_tree(model, S.WINDOW_FEATURES)
    both = training.predict(model, ts.rows).withColumn("again", tree_prob(tree)).agg(F.max(F.abs(F.col("again") - F.col("score")))).first()[0]
    assert both < 1e-12


def test_neutral_columns_hold_their_median(ts):
    out, fills = split.neutralize(ts.rows, ("heap", "rssi_var"))
    heap = [r.heap for r in ts.train.where("label = 0").select("heap").collect()]
    assert fills["heap"] == np.median(heap)
    assert out.select("heap", "rssi_var").distinct().count() == 1


def test_projections_against_numpy(ts):
    names = [f for f in S.WINDOW_FEATURES]
    train, every = ts.train.toPandas(), ts.rows.toPandas()
    x = train[names].to_numpy()
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    z, za = (x - x.mean(axis=0)) / scale, (every[names].to_numpy() - x.mean(axis=0)) / scale

    report, scores = projections.pca_report(ts.train, ts.rows, names)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    share = values[::-1] / values.sum()
    got = {r.component: r.value for r in report.where("name = 'explained'").collect()}
    np.testing.assert_allclose([got[f"PC{i + 1}"] for i in range(10)], share[:10], atol=1e-8)
    pc1 = vectors[:, -1] * np.sign(vectors[np.abs(vectors[:, -1]).argmax(), -1])
    mine = scores.select("capture_id", "window_us", "pc1").toPandas().sort_values(["capture_id", "window_us"])
    want = every.assign(pc1=za @ pc1).sort_values(["capture_id", "window_us"])
    np.testing.assert_allclose(mine["pc1"], want["pc1"], atol=1e-6)

    y = train["label"].to_numpy()
    means = [z[y == c].mean(axis=0) for c in (0, 1)]
    within = sum((z[y == c] - means[c]).T @ (z[y == c] - means[c]) for c in (0, 1)) / (len(z) - 2)
    coef = np.linalg.pinv(within, hermitian=True) @ (means[1] - means[0])
    bias = -coef @ (means[0] + means[1]) / 2 + np.log((y == 1).sum() / (y == 0).sum())
    report, scored = projections.lda_binary(ts.train, ts.rows, names)
    rows = {(r.name, r.feature): r.value for r in report.collect()}
    assert rows["train_accuracy", ""] == pytest.approx(np.mean((z @ coef + bias > 0) == (y == 1)))
    assert rows["heap_coef", "heap"] == pytest.approx(coef[names.index("heap")], rel=1e-6)
    assert abs(scored.where("is_test = false").agg(F.avg("ld1")).first()[0]) < 1e-6

    report, scored = projections.lda_multiclass(ts.train, ts.rows, names, "attack_type")
    shares = [r.value for r in report.where("name = 'explained'").collect()]
    assert len(shares) == 2 and shares[0] >= shares[1] and "ld2" in scored.columns


def test_reports(ts):
    ablation = {r.model: r for r in training.feature_ablation(ts).collect()}
    assert set(ablation) == set(training.ABLATION_SETS) and ablation["full"].f1_lift_of_full == 0
    assert ablation["no_heap"].f1 == ablation["hids_sans_heap"].f1
    held = {r.model: r for r in training.neutralized_models(ts).collect()}
    assert held["no-heap"].heap_importance == 0 and held["nids-counts"].rf_soft_importance == 0 and held["nids-only"].host_importance == 0
    grid = training.grid_search(ts, depths=(2, 4), leaves=(1, 5))
    assert grid.count() == 4 and grid.where("is_best").count() == 1
    models = {"DecisionTree": training.fit_tree(ts.train), "RandomForest": training.fit_forest(ts.train, trees=5), "GradientBoosted": training.fit_boosted(ts.train, rounds=2)}
    report = training.eval_report(ts, models)
    assert report.where("is_best").select("model").distinct().count() == 1
    nodes, text, tree = training.tree_to_sql(ts)
    assert nodes.where("node_id = 1").count() == 1 and len(text) >= 1


def test_distill_learns_from_either_kind_of_teacher(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, len(S.WINDOW_FEATURES))).round(1)
    rows = [("c", k, *map(float, v), int(v[0] + 0.2 * v[1] > 0.3), "none", k % 3 == 0, 1.0) for k, v in enumerate(x)]
    columns = "capture_id string, window_us long, " + ", ".join(f"{f} double" for f in S.WINDOW_FEATURES)
    own = training.TrainingSet(spark.createDataFrame(rows, f"{columns}, label int, attack_type string, is_test boolean, weight double"))
    for teacher in (training.fit_forest(own.train, trees=3, depth=3), training.exact_forest(own.train, trees=3, depth=3)):
        tree = training.distill(own, teacher).nested()
        both = training.predict(teacher, own.train).withColumn("again", training.tree_pred(tree))
        assert both.where("pred = again").count() >= 0.9 * own.train.count()
