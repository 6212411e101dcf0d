"""Registered training and evaluation queries."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens import schema as S
from airlens.operators import metrics, quality
from airlens.plans import boosting, oracle, projections, training
from airlens.plans import tree_oracle as T
from airlens.plans.queries import quiet_windows, windows_of
from airlens.plans.registry import query
from airlens.plans.training import TrainingSet
from airlens.session import shared_dir
from airlens.sources import captures

def training_set(spark: SparkSession, d: str, quiet: bool = False) -> TrainingSet:
    """The staged split of a table folder."""
    return TrainingSet.of(quiet_windows(spark, d) if quiet else windows_of(spark, d))


def _scored(ts: TrainingSet, name: str, model) -> DataFrame:
    return training.evaluate(training.model_scores(ts, {name: model}))


oracle.CTES["quiet_split"] = oracle.CTES["split"].replace("from windows", "from quiet")
T.add_trees("tree", T.plain_rows({"DecisionTree": S.WINDOW_FEATURES}), 4)
T.add_trees("ablated", T.plain_rows(training.ABLATION_SETS), 4)
T.add_trees("weighed", T.plain_rows({"full": S.WINDOW_FEATURES, "wireless_only": S.NIDS_ONLY}), 4)


@query("fit_tree", T.evaluated(T.test_rows("tree")))
def _(spark, d):
    ts = training_set(spark, d)
    return training.evaluate(training.predict_trees(ts.test, {"DecisionTree": training.exact_tree(ts.train).nested()}))


@query("fit_forest")
def _(spark, d):
    ts = training_set(spark, d)
    return _scored(ts, "RandomForest", training.fit_forest(ts.train))


@query("fit_boosted")
def _(spark, d):
    ts = training_set(spark, d)
    return _scored(ts, "GradientBoosted", training.fit_boosted(ts.train))


@query("tree_to_sql", f"""
select node::bigint as node_id, ([{', '.join(repr(f) for f in S.WINDOW_FEATURES)}])[f] as feature, th as threshold, null::double as p_normal, null::double as p_attack from tree_splits
union all select node::bigint, null, null, p0, p1 from tree_leaf""")
def _(spark, d):
    return training.tree_to_sql(training_set(spark, d))[0]


oracle.CTES["ablated_metrics"] = T.evaluated(T.test_rows("ablated"))


@query("feature_ablation", """
select e.model, e.precision, e.recall, e.f1, e.fpr, e.auc, f.f1 - e.f1 as f1_lift_of_full, e.fpr - f.fpr as fpr_change
from ablated_metrics e, (select f1, fpr from ablated_metrics where model = 'full') f""")
def _(spark, d):
    return training.feature_ablation(training_set(spark, d))


@query("neutralized_models")
def _(spark, d):
    return training.neutralized_models(training_set(spark, d))


def _names(names) -> str:
    return ", ".join(repr(n) for n in names)


@query("feature_importance", f"""
select model, feature_group, feature, round(importance, 9) as importance, round(sum(importance) over (partition by model, feature_group), 9) as group_importance,
  feature = 'heap' and importance > {S.MAX_HEAP_IMPORTANCE} as heap_over_limit
from (select tree as model, feature, importance, case when feature in ({_names(S.HIDS)}) then 'host' when feature in ({_names(S.RF_SOFT)}) then 'rf_soft' else 'counts' end as feature_group
from ({T.importances("weighed")})) where importance > 0""")
def _(spark, d):
    table = training.feature_importance(training_set(spark, d))
    return table.withColumns({c: F.round(c, 9) for c in ("importance", "group_importance")})


SMALL_FOREST = {"trees": 3, "depth": 2}
_DRAWN = " + ".join(f"(u >= {limit})::bigint" for limit in training.DRAWS)
T.add_trees("grove", f"""
select tree, capture_id, window_us, label, attack_type, is_test, {T.VALUES} as x, label as y, case when is_test then 0 else {_DRAWN} end as c, [0] as fs, 1 as leaf, 2 as depth, w0, w1 from (
select s.*, tree, ('0x' || md5(concat('42|', tree, '|', capture_id, '|', window_us))[1:8])::bigint as u,
  (count(*) filter (not is_test) over ())::double / (2.0::double * count(*) filter (not is_test and label = 0) over ()) as w0,
  (count(*) filter (not is_test) over ())::double / (2.0::double * count(*) filter (not is_test and label = 1) over ()) as w1
from split s, (select capture_id as cap, window_us as win, unnest([0, 1, 2]) as tree from split) t where s.capture_id = cap and s.window_us = win)""", 2, """
list_transform(list_sort(list_transform(range(1, 18), lambda f: md5(concat('42|', tree, '|', node, '|', f)) || '|' || f))[1:4], lambda s: split_part(s, '|', 2)::int)""")
oracle.CTES["grove_votes"] = """
select 'RandomForest' as tree, capture_id, window_us, label, attack_type, is_test, any_value(x) as x, list_reduce(list(score order by tree), lambda a, b: a + b) / 3.0::double as score,
  (list_reduce(list(score order by tree), lambda a, b: a + b) / 3.0::double > 0.5)::int as pred from grove_scored group by capture_id, window_us, label, attack_type, is_test"""
T.add_trees("taught", T.balanced(f"""
select 'Distilled' as tree, capture_id, window_us, label, attack_type, is_test, x, pred as y, (not is_test)::int as c, {T.places(S.WINDOW_FEATURES)} as fs, 1 as leaf, 4 as depth
from grove_votes""", "y"), 4)


@query("fit_forest_exact", T.evaluated("select * from grove_votes where is_test"))
def _(spark, d):
    """A small forest whose samples and features any engine draws alike."""
    ts = training_set(spark, d)
    return _scored(ts, "RandomForest", training.exact_forest(ts.train, **SMALL_FOREST))


@query("distill", T.evaluated(T.test_rows("taught")))
def _(spark, d):
    ts = training_set(spark, d)
    tree = training.distill(ts, training.exact_forest(ts.train, **SMALL_FOREST))
    return training.evaluate(training.predict_trees(ts.test, {"Distilled": tree.nested()}))


@query("pca_report")
def _(spark, d):
    ts = training_set(spark, d)
    return projections.pca_report(ts.train, ts.rows, S.WINDOW_FEATURES)[0]


@query("pca_scores")
def _(spark, d):
    ts = training_set(spark, d)
    scores = projections.pca_report(ts.train, ts.rows, S.WINDOW_FEATURES, components=2)[1]
    return scores.select("capture_id", "window_us", "label", "attack_type", "pc1", "pc2")


@query("lda_binary")
def _(spark, d):
    ts = training_set(spark, d)
    return projections.lda_binary(ts.train, ts.rows, S.WINDOW_FEATURES)[0]


@query("lda_scores")
def _(spark, d):
    ts = training_set(spark, d)
    scored = projections.lda_binary(ts.train, ts.rows, S.WINDOW_FEATURES)[1]
    return scored.select("capture_id", "window_us", "label", "attack_type", "ld1")


@query("lda_multiclass")
def _(spark, d):
    ts = training_set(spark, d)
    return projections.lda_multiclass(ts.train, ts.rows, S.WINDOW_FEATURES, "attack_type")[0]


@query("lda_multiclass_embeddings")
def _(spark, d):
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    names = [f"e{i}" for i in range(64)]
    wide = vectors.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return projections.lda_multiclass(wide, wide, names, "label")[1].select("vec_id", "label", "ld1", "ld2")


oracle.CTES["folds"] = """
select *, case when is_test then null when k <= floor(n / 3.0::double + 0.5) then 0 when k <= floor(n * 2 / 3.0::double + 0.5) then 1 else 2 end as fold from (
select *, row_number() over (partition by label, is_test order by h) as k, count(*) over (partition by label, is_test) as n from split)"""
T.add_trees("grid", T.balanced(f"""
select leaf || '|' || hold as tree, capture_id, window_us, label, attack_type, is_test, fold, {T.VALUES} as x, label as y, (not is_test and fold <> hold)::int as c,
  {T.places(S.WINDOW_FEATURES)} as fs, leaf, {max(training.DEPTHS)} as depth, hold from folds, (select unnest({list(training.LEAVES)}) as leaf), (select unnest([0, 1, 2]) as hold)"""), max(training.DEPTHS))
# A tree of some depth is the upper part of the deepest: its leaf is the node a row has at that level.
_AT = " union all ".join(f"select tree, leaf, hold, {d} as max_depth, node, label, y, c, w0, w1, fold, is_test from grid_rows{d}" for d in training.DEPTHS)
_F1 = "coalesce(2 * count(*) filter (label = 1 and pred) / nullif(count(*) filter (label = 1) + count(*) filter (pred), 0)::double, 0)"
oracle.CTES["grid_at"] = _AT
oracle.CTES["grid_preds"] = """
select r.leaf, r.hold, r.max_depth, r.label, r.fold, r.is_test, n1 * w1 / (w0 * n0 + w1 * n1) > w0 * n0 / (w0 * n0 + w1 * n1) as pred
from (select * from grid_at where fold = hold) r join (
select tree, max_depth, node, coalesce(sum(c) filter (y = 0), 0)::double as n0, coalesce(sum(c) filter (y = 1), 0)::double as n1 from grid_at where c > 0 group by all) l
on r.tree = l.tree and r.max_depth = l.max_depth and r.node = l.node"""
oracle.CTES["grid_scores"] = f"""
select max_depth, leaf as min_leaf, avg(f1) as mean_cv_f1, stddev_pop(f1) as std_cv_f1 from (
select max_depth, leaf, hold, {_F1} as f1 from grid_preds group by all) group by all"""
T.add_trees("refit", T.balanced(f"""
select tree, capture_id, window_us, label, attack_type, is_test, {T.VALUES} as x, label as y, (not is_test)::int as c, {T.places(S.WINDOW_FEATURES)} as fs, leaf, depth from split, (
select 'best' as tree, min_leaf as leaf, max_depth as depth from grid_scores qualify row_number() over (order by round(mean_cv_f1, 12) desc, max_depth, min_leaf) = 1
union all select 'default', 1, 4)"""), max(training.DEPTHS))


oracle.CTES["refit_metrics"] = T.evaluated(T.test_rows("refit"))


@query("grid_search", """
select max_depth, min_leaf, round(mean_cv_f1, 9) as mean_cv_f1, round(std_cv_f1, 9) as std_cv_f1, k = 1 as is_best,
  case when k = 1 then (select f1 from refit_metrics where model = 'best') end as best_test_f1, (select f1 from refit_metrics where model = 'default') as default_test_f1
from (select *, row_number() over (order by round(mean_cv_f1, 12) desc, max_depth, min_leaf) as k from grid_scores)""")
def _(spark, d):
    return training.grid_search(training_set(spark, d)).withColumns({c: F.round(c, 9) for c in ("mean_cv_f1", "std_cv_f1")})


_HELD = (*S.HIDS, *S.RF_SOFT)


def _filled(names, source: str) -> tuple[str, str]:
    """VALUES with columns at their median over normal training rows, and the table to read them from."""
    of = {f: f"coalesce(m_{f}, 0)" for f in names}
    medians = ", ".join(f"quantile_cont({f}, 0.5) filter (label = 0 and not is_test) as m_{f}" for f in names)
    return f"[{', '.join(of.get(f, f + '::double') for f in S.WINDOW_FEATURES)}]", f"{source}, (select {medians} from {source})"


T.add_trees("neutral", " union all ".join(
    T.plain_rows({n: S.WINDOW_FEATURES}, 4, 1, *_filled(columns, "split")) for n, columns in training.NEUTRAL_SETS.items()
), 4)


def _summed(names) -> str:
    return f"round(coalesce(sum(importance) filter (feature in ({_names(names)})), 0), 9)"


@query("neutralized_values", f"""
select e.model, e.precision, e.recall, e.f1, e.fpr, e.auc, heap_importance, host_importance, rf_soft_importance from ({T.evaluated(T.test_rows("neutral"))}) e join (
select tree, {_summed(["heap"])} as heap_importance, {_summed(S.HIDS)} as host_importance, {_summed(S.RF_SOFT)} as rf_soft_importance
from ({T.importances("neutral")}) group by tree) i on e.model = i.tree""")
def _(spark, d):
    """Metrics and importance sums of the trees with columns held constant."""
    table = training.neutralized_models(training_set(spark, d)).drop("fills")
    return table.withColumns({c: F.round(c, 9) for c in ("heap_importance", "host_importance", "rf_soft_importance")})


T.add_trees("expert", " union all ".join([
    T.plain_rows({"W": S.WINDOW_FEATURES}, 4, 1, *_filled(_HELD, "quiet_split")), T.plain_rows({"H": S.HIDS}, source="quiet_split"),
]), 4)
oracle.CTES["experts"] = f"""
select w.label, w.attack_type, w.pred as wp, h.pred as hp, w.score as ws, h.score as hs, greatest(w.pred, h.pred) as op, greatest(w.score, h.score) as os,
  (w.pred = 1 or h.score >= {S.EXPERT_H_GATE})::int as gp, case when w.pred = 1 then greatest(w.score, h.score) when h.score >= {S.EXPERT_H_GATE} then h.score else w.score end as gs
from expert_scored w join expert_scored h on w.capture_id = h.capture_id and w.window_us = h.window_us where w.tree = 'W' and h.tree = 'H' and w.is_test"""
oracle.CTES["expert_preds"] = " union all ".join(
    f"select '{n}' as tree, label, attack_type, {p} as pred, {s} as score from experts" for n, p, s in (("W", "wp", "ws"), ("H", "hp", "hs"), ("OR", "op", "os"), ("OR_gated", "gp", "gs"))
)
oracle.CTES["expert_metrics"] = T.evaluated("select * from expert_preds")
_METRICS = ("precision", "recall", "f1", "fpr", "auc", "accuracy")
_PARTS = ("metric", "recall", "overlap", "importance", "fill", "train_types")


@query("dual_expert_values", f"""
select section, model, name, round(value, 9) as value from (
select 'metric' as section, model, unnest({list(_METRICS)}) as name, unnest([{', '.join(_METRICS)}]) as value from expert_metrics
union all select 'recall', tree, attack_type, avg(pred) from expert_preds where attack_type not in ('', 'NONE', 'nan') group by tree, attack_type
union all select 'overlap', 'W,H', unnest(['both_attack', 'only_w', 'only_h', 'n']),
  unnest([count(*) filter (wp = 1 and hp = 1), count(*) filter (wp = 1 and hp = 0), count(*) filter (wp = 0 and hp = 1), count(*)])::double from experts
union all select 'importance', m.tree, m.feature, coalesce(i.importance, 0) from (
  select 'W' as tree, unnest([{_names(S.WINDOW_FEATURES)}]) as feature union all select 'H', unnest([{_names(S.HIDS)}])) m left join ({T.importances("expert")}) i on m.tree = i.tree and m.feature = i.feature
union all select 'fill', 'W', unnest([{_names(_HELD)}]), unnest([{', '.join(f"coalesce(quantile_cont({f}, 0.5) filter (label = 0 and not is_test), 0)" for f in _HELD)}]) from quiet_split
union all select 'train_types', 'W,H', attack_type, count(*)::double from quiet_split where not is_test group by attack_type)""")
def _(spark, d):
    """Metrics, recalls, overlap, importances, fills and training types of both experts and their fusions."""
    table = training.dual_expert_eval(training_set(spark, d, quiet=True))
    return table.where(F.col("section").isin(*_PARTS)).withColumn("value", F.round("value", 9))


@query("dual_expert_eval")
def _(spark, d):
    return training.dual_expert_eval(training_set(spark, d, quiet=True))


@query("eval_report")
def _(spark, d):
    return training.eval_report(training_set(spark, d))


ROUNDS = 3  # of the boosters that SQL repeats
_ODDS = "(select ln((count(*) filter (label = 1))::double / count(*) filter (label = 0)) from split where not is_test)"
T.add_boosted("levels", "split", "0", ROUNDS, boosting.BY_LEVEL)
T.add_boosted("leaves", "split", _ODDS, ROUNDS, boosting.BY_LEAF)


@query("fit_boosted_levels", T.evaluated(T.boosted_scores("levels", ROUNDS, "XGBoost")))
def _(spark, d):
    """First rounds of the booster that grows by levels."""
    ts = training_set(spark, d)
    return _scored(ts, "XGBoost", boosting.fit(ts.train, replace(boosting.BY_LEVEL, rounds=ROUNDS)))


@query("fit_boosted_leaves", T.evaluated(T.boosted_scores("leaves", ROUNDS, "LightGBM")))
def _(spark, d):
    """First rounds of the booster that grows best leaves first."""
    ts = training_set(spark, d)
    return _scored(ts, "LightGBM", boosting.fit(ts.train, replace(boosting.BY_LEAF, rounds=ROUNDS)))


# ---- what SQL can state about a fit ------------------------------------------------------

_CLASSES = "select '{}' as model, count(*) filter (label = 1) as n_pos, count(*) filter (label = 0) as n_neg, true as in_range from split where is_test"


def _classes(table: DataFrame) -> DataFrame:
    """Per model the classes its confusion cells add up to, and whether its rates lie between 0 and 1."""
    rates = [F.col(c).between(0.0, 1.0) for c in ("precision", "recall", "f1", "fpr", "auc", "accuracy")]
    within = rates[0]
    for r in rates[1:]:
        within = within & r
    return table.select("model", (F.col("tp") + F.col("fn")).alias("n_pos"), (F.col("fp") + F.col("tn")).alias("n_neg"), within.alias("in_range"))


@query("fit_tree_classes", _CLASSES.format("DecisionTree"))
def _(spark, d):
    ts = training_set(spark, d)
    tree = training.model_tree(training.fit_tree(ts.train), S.WINDOW_FEATURES)
    return _classes(training.evaluate(training.predict_trees(ts.test, {"DecisionTree": tree})))


@query("fit_forest_classes", _CLASSES.format("RandomForest"))
def _(spark, d):
    ts = training_set(spark, d)
    return _classes(_scored(ts, "RandomForest", training.fit_forest(ts.train)))


@query("fit_boosted_classes", _CLASSES.format("GradientBoosted"))
def _(spark, d):
    ts = training_set(spark, d)
    return _classes(_scored(ts, "GradientBoosted", training.fit_boosted(ts.train)))


@query("distill_classes", _CLASSES.format("Distilled"))
def _(spark, d):
    ts = training_set(spark, d)
    tree = training.distill(ts, training.fit_forest(ts.train)).nested()
    return _classes(training.evaluate(training.predict_trees(ts.test, {"Distilled": tree})))


@query("tree_to_sql_differences", "select count(*) as n, 0::bigint as differing from split where is_test")
def _(spark, d):
    """Test rows where the tree as an expression and the fitted model disagree."""
    ts = training_set(spark, d)
    model = training.fit_tree(ts.train)
    both = training.predict(model, ts.test).withColumn("as_sql", training.tree_pred(training.model_tree(model, S.WINDOW_FEATURES)))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("pred") != F.col("as_sql"), 1)).alias("differing"))


_ABLATED = ", ".join(f"('{n}')" for n in training.ABLATION_SETS)


@query("feature_ablation_sums", f"select model, true as adds_up from (values {_ABLATED}) t(model)")
def _(spark, d):
    table = training.feature_ablation(training_set(spark, d))
    full = table.where("model = 'full'").select(F.col("f1").alias("full_f1"), F.col("fpr").alias("full_fpr"))
    adds_up = (F.abs(F.col("f1") + F.col("f1_lift_of_full") - F.col("full_f1")) < 1e-9) & (F.abs(F.col("fpr") - F.col("fpr_change") - F.col("full_fpr")) < 1e-9)
    return table.join(F.broadcast(full)).select("model", adds_up.alias("adds_up"))  # one row


def _fills_sql() -> str:
    parts = [
        f"select '{name}' as model, '{c}' as feature, round(coalesce(quantile_cont({c}::double, 0.5) filter (label = 0 and not is_test), 0), 6) as fill, 0.0::double as held_importance from split"
        for name, columns in training.NEUTRAL_SETS.items() for c in columns
    ]
    return " union all ".join(parts)


@query("neutralized_fills", _fills_sql())
def _(spark, d):
    """The constants columns are held at, and the importance those columns have left."""
    table = training.neutralized_models(training_set(spark, d))
    held = F.when(F.col("model") == "no-heap", F.col("heap_importance")).when(F.col("model") == "nids-only", F.col("host_importance")).otherwise(
        F.col("host_importance") + F.col("rf_soft_importance")
    )
    return table.select("model", F.explode("fills").alias("feature", "fill"), held.alias("held_importance")).withColumn("fill", F.round("fill", 6))


@query("feature_importance_sums", "select model, 1.0::double as importance from (values ('full'), ('wireless_only')) t(model)")
def _(spark, d):
    return training.feature_importance(training_set(spark, d)).groupBy("model").agg(F.round(F.sum("importance"), 9).alias("importance"))


@query("grid_search_rows", f"""
select max_depth::int as max_depth, min_leaf::int as min_leaf, 1::bigint as n_best, true as in_range
from (select unnest({list(training.DEPTHS)}) as max_depth), (select unnest({list(training.LEAVES)}) as min_leaf)""")
def _(spark, d):
    table = training.grid_search(training_set(spark, d))
    best = table.agg(F.count(F.when(F.col("is_best"), 1)).alias("n_best"))
    return table.join(F.broadcast(best)).select("max_depth", "min_leaf", "n_best", F.col("mean_cv_f1").between(0.0, 1.0).alias("in_range"))  # one row


_MODELS = ", ".join(f"('{m}')" for m in training.MODEL_ORDER)


@query("eval_report_classes", f"""
select model, n_pos::double as n_pos, n_neg::double as n_neg, 1::bigint as n_best from (values {_MODELS}) t(model),
 (select count(*) filter (label = 1) as n_pos, count(*) filter (label = 0) as n_neg from split where is_test)""")
def _(spark, d):
    table = training.eval_report(training_set(spark, d)).where("section = 'metric'")
    of = lambda *names: F.sum(F.when(F.col("name").isin(*names), F.col("value")))
    per = table.groupBy("model").agg(of("tp", "fn").alias("n_pos"), of("fp", "tn").alias("n_neg"), F.max(F.col("is_best").cast("int")).alias("best"))
    best = per.agg(F.sum("best").alias("n_best"))
    return per.join(F.broadcast(best)).select("model", "n_pos", "n_neg", "n_best")  # one row


def _near(value, digits: int = 6):
    return F.round(value, digits) + F.lit(0.0)  # no negative zero


@query("pca_moments", """
select count(*) as n, 0.0::double as mean_pc1, 0.0::double as mean_pc2, 0.0::double as covariance, true as ordered from split where not is_test""")
def _(spark, d):
    """Scores of the training rows are centred, uncorrelated and in falling order of variance."""
    ts = training_set(spark, d)
    scores = projections.pca_report(ts.train, ts.train, S.WINDOW_FEATURES, components=2)[1]
    return scores.agg(
        F.count(F.lit(1)).alias("n"), _near(F.avg("pc1")).alias("mean_pc1"), _near(F.avg("pc2")).alias("mean_pc2"),
        _near(F.covar_pop("pc1", "pc2")).alias("covariance"), (F.var_pop("pc1") >= F.var_pop("pc2")).alias("ordered"),
    )


def _discriminant(scored: DataFrame, by: str, axes: list[str]) -> DataFrame:
    """Overall mean and pooled variance within classes of each discriminant, by class sums."""
    groups = scored.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"m_{a}") for a in axes], *[F.var_pop(a).alias(f"v_{a}") for a in axes])
    total, classes = F.sum("n"), F.count(F.lit(1))
    out = [total.alias("n"), classes.alias("n_classes")]
    for a in axes:
        out += [_near(F.sum(F.col(f"m_{a}") * F.col("n")) / total).alias(f"mean_{a}"), _near(F.sum(F.col(f"v_{a}") * F.col("n")) / (total - classes)).alias(f"within_{a}")]
    return groups.agg(*out)


@query("lda_binary_moments", "select count(*) as n, 2::bigint as n_classes, 0.0::double as mean_ld1, 1.0::double as within_ld1 from split where not is_test")
def _(spark, d):
    ts = training_set(spark, d)
    return _discriminant(projections.lda_binary(ts.train, ts.train, S.WINDOW_FEATURES)[1], "label", ["ld1"])


_TWO_AXES = "0.0::double as mean_ld1, 1.0::double as within_ld1, 0.0::double as mean_ld2, 1.0::double as within_ld2"


@query("lda_multiclass_moments", f"select count(*) as n, count(distinct attack_type) as n_classes, {_TWO_AXES} from split")
def _(spark, d):
    ts = training_set(spark, d)
    return _discriminant(projections.lda_multiclass(ts.train, ts.rows, S.WINDOW_FEATURES, "attack_type")[1], "attack_type", ["ld1", "ld2"])


@query("lda_embeddings_moments", f"select count(*) as n, count(distinct label) as n_classes, {_TWO_AXES} from embeddings")
def _(spark, d):
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    names = [f"e{i}" for i in range(64)]
    wide = vectors.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return _discriminant(projections.lda_multiclass(wide, wide, names, "label")[1], "label", ["ld1", "ld2"])


@query("dual_expert_overlap", "select true as adds_up, 4::bigint as n_models, 1::bigint as n_sizes")
def _(spark, d):
    """The four models see the same busy rows, and the overlap cells lie within the test rows."""
    table = training.dual_expert_eval(training_set(spark, d, quiet=True))
    cell = lambda name: F.sum(F.when((F.col("section") == "overlap") & (F.col("name") == name), F.col("value")))
    busy = F.when((F.col("section") == "busy") & (F.col("name") == "n"), F.col("value"))
    return table.agg(
        (cell("both_attack") + cell("only_w") + cell("only_h") <= cell("n")).alias("adds_up"),
        F.count_distinct(F.when(F.col("section") == "metric", F.col("model"))).alias("n_models"), F.count_distinct(busy).alias("n_sizes"),
    )


@query("full_report_sections", """
select 'model' as kind, 3::bigint as n union all select 'ablation', 42 union all select 'neutralized', 24 union all select 'dataset', 6
union all select 'dataset_types', count(distinct attack_type) from windows union all select 'grid', 10 union all select 'windows', count(*) from windows""")
def _(spark, d):
    """The document by way of its file: how much each section holds."""
    path = f"{shared_dir(spark)}/reports/{uuid.uuid4().hex}"
    captures.write_report(training.full_report(training_set(spark, d)), path)
    rows = spark.read.schema("section string, model string, name string, value double, is_best boolean").json(path)
    sizes = rows.where("section in ('ablation', 'neutralized', 'dataset', 'dataset_types', 'grid')").groupBy(F.col("section").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    models = rows.where("section = 'metric'").agg(F.lit("model").alias("kind"), F.count_distinct("model").alias("n"))
    size = rows.where("section = 'dataset' and name = 'n_windows'").select(F.lit("windows").alias("kind"), F.col("value").cast("long").alias("n"))
    return sizes.unionByName(models).unionByName(size)

