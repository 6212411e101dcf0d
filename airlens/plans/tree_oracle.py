"""Trees with exact thresholds as DuckDB SQL: one table expression a level, and scores and metrics from them."""

from __future__ import annotations

from collections.abc import Sequence

from airlens import schema as S
from airlens.plans.oracle import CTES

VALUES = f"[{', '.join(f'{f}::double' for f in S.WINDOW_FEATURES)}]"


def places(features: Sequence[str]) -> str:
    """Positions of the features in VALUES."""
    return f"[{', '.join(str(S.WINDOW_FEATURES.index(f) + 1) for f in features)}]"


def add_trees(prefix: str, rows: str, depth: int, chosen: str = "fs") -> None:
    """Table expressions ``<prefix>_rows<k>``, ``_best<k>``, ``_leaf`` and ``_scored`` of all trees over ``rows``.

    ``rows`` has tree, capture_id, window_us, label, attack_type, x (values), y (class to fit),
    c (how often a row counts), fs (positions of the tree's features), w0, w1, leaf and depth.
    ``chosen`` may pick the positions by tree and node.
    """
    CTES[f"{prefix}_rows0"] = f"select *, 1 as node from ({rows})"
    for k in range(depth):
        side = "(w0 * {0} * (w0 * {0}) + w1 * {1} * (w1 * {1})) / (w0 * {0} + w1 * {1})"
        CTES[f"{prefix}_best{k}"] = f"""
select tree, node, f, case when (v + nv) / 2.0::double >= nv then v else (v + nv) / 2.0::double end as th, l0, l1, t0, t1, w0, w1 from (
select *, row_number() over (partition by tree, node order by {side.format('l0', 'l1')} + {side.format('(t0 - l0)', '(t1 - l1)')} desc, f, v) as k from (
select tree, node, f, v, w0, w1, leaf,
  (sum(n0) over (partition by tree, node, f order by v))::double as l0, (sum(n1) over (partition by tree, node, f order by v))::double as l1,
  (sum(n0) over (partition by tree, node, f))::double as t0, (sum(n1) over (partition by tree, node, f))::double as t1,
  lead(v) over (partition by tree, node, f order by v) as nv from (
select tree, node, f, x[f] as v, any_value(w0) as w0, any_value(w1) as w1, any_value(leaf) as leaf,
  coalesce(sum(c) filter (y = 0), 0) as n0, coalesce(sum(c) filter (y = 1), 0) as n1
from (select *, unnest({chosen}) as f from {prefix}_rows{k} where c > 0 and {k} < depth and node >= {1 << k}) group by tree, node, f, x[f]))
where nv is not null and t0 > 0 and t1 > 0 and l0 + l1 >= leaf and t0 + t1 - l0 - l1 >= leaf) where k = 1"""
        CTES[f"{prefix}_rows{k + 1}"] = f"""
select r.* replace (case when b.node is null then r.node when r.x[b.f] <= b.th then 2 * r.node else 2 * r.node + 1 end as node)
from {prefix}_rows{k} r left join {prefix}_best{k} b on r.tree = b.tree and r.node = b.node"""
    CTES[f"{prefix}_leaf"] = f"""
select tree, node, w0 * n0 / (w0 * n0 + w1 * n1) as p0, w1 * n1 / (w0 * n0 + w1 * n1) as p1 from (
select tree, node, any_value(w0) as w0, any_value(w1) as w1, coalesce(sum(c) filter (y = 0), 0)::double as n0, coalesce(sum(c) filter (y = 1), 0)::double as n1
from {prefix}_rows{depth} where c > 0 group by tree, node)"""
    CTES[f"{prefix}_scored"] = f"""
select r.tree, capture_id, window_us, label, attack_type, is_test, x, l.p1 as score, (l.p1 > l.p0)::int as pred
from {prefix}_rows{depth} r join {prefix}_leaf l on r.tree = l.tree and r.node = l.node"""
    CTES[f"{prefix}_splits"] = " union all ".join(f"select * from {prefix}_best{k}" for k in range(depth))


def balanced(rows: str, label: str = "label") -> str:
    """``rows`` with w0 and w1 that balance the classes of the rows that count."""
    return f"""
select *, n / (2.0::double * n0) as w0, n / (2.0::double * n1) as w1 from (
select *, (sum(c) over (partition by tree))::double as n, (sum(case when {label} = 0 then c end) over (partition by tree))::double as n0,
  (sum(case when {label} = 1 then c end) over (partition by tree))::double as n1 from ({rows}))"""


def plain_rows(sets: dict[str, Sequence[str]], depth: int = 4, leaf: int = 1, values: str = VALUES, source: str = "split") -> str:
    """Trees on the training rows, one for each named set of columns."""
    each = [
        f"select '{n}' as tree, capture_id, window_us, label, attack_type, is_test, {values} as x, label as y, (not is_test)::int as c,"
        f" {places(f)} as fs, {leaf} as leaf, {depth} as depth from {source}" for n, f in sets.items()
    ]
    return balanced(" union all ".join(each))


def evaluated(scored: str) -> str:
    """All binary metrics and the AUC of test rows per tree."""
    return f"""
select tree as model, tp, fp, fn, tn, coalesce(tp / nullif(tp + fp, 0)::double, 0) as precision, coalesce(tp / nullif(tp + fn, 0)::double, 0) as recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0) as f1, coalesce(fp / nullif(fp + tn, 0)::double, 0) as fpr,
  (tp + tn) / (tp + fp + fn + tn)::double as accuracy, coalesce(tn / nullif(tn + fn, 0)::double, 0) as precision_0,
  coalesce(tn / nullif(tn + fp, 0)::double, 0) as recall_0, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0)::double, 0) as f1_0,
  tp + fn as support_1, tn + fp as support_0, auc from (
select tree, count(*) filter (label = 1 and pred = 1) as tp, count(*) filter (label = 0 and pred = 1) as fp,
  count(*) filter (label = 1 and pred = 0) as fn, count(*) filter (label = 0 and pred = 0) as tn from ({scored}) group by tree) left join (
select tree as of, (sum(pos * (below + neg / 2.0::double)) / (max(p) * max(n)))::double as auc from (
select tree, pos, neg, sum(neg) over (partition by tree order by score) - neg as below, sum(pos) over (partition by tree) as p, sum(neg) over (partition by tree) as n
from (select tree, score, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg from ({scored}) group by tree, score)) group by tree) on tree = of"""


def test_rows(prefix: str) -> str:
    return f"select * from {prefix}_scored where is_test"


def importances(prefix: str) -> str:
    """(tree, feature, importance): what each feature's splits take from the weighted impurity, as shares."""
    impurity = "(w0 * {0} + w1 * {1}) - (w0 * {0} * (w0 * {0}) + w1 * {1} * (w1 * {1})) / (w0 * {0} + w1 * {1})"
    names = f"[{', '.join(repr(f) for f in S.WINDOW_FEATURES)}]"
    return f"""
select tree, ({names})[f] as feature, sum(lost) / sum(sum(lost)) over (partition by tree) as importance from (
select tree, f, ({impurity.format('t0', 't1')}) - ({impurity.format('l0', 'l1')}) - ({impurity.format('(t0 - l0)', '(t1 - l1)')}) as lost from {prefix}_splits) group by tree, f"""


def add_boosted(prefix: str, source: str, start: str, rounds: int, settings, label: str = "label") -> None:
    """Table expressions of a booster's rounds: ``<prefix>_m<t>`` has the margins after t rounds."""
    unit = f"{1 << 30}::double"
    CTES[f"{prefix}_m0"] = f"select capture_id, window_us, {label} as label, attack_type, is_test, {VALUES} as x, ({start})::double as m from {source}"
    side = "({0} / " + unit + ") * ({0} / " + unit + ") / ({1} / " + unit + f" + {settings.ridge!r}::double)"
    for t in range(rounds):
        p = f"{prefix}_t{t}"
        CTES[f"{p}_rows0"] = f"""
select *, 1 as node, round((chance - label) * {unit})::bigint as a, round(chance * (1.0::double - chance) * {unit})::bigint as b
from (select *, 1.0::double / (1.0::double + exp(-m)) as chance from {prefix}_m{t})"""
        for k in range(settings.depth):
            CTES[f"{p}_best{k}"] = f"""
select node, f, case when (v + nv) / 2.0::double >= nv then v else (v + nv) / 2.0::double end as th from (
select *, row_number() over (partition by node order by score desc, f, v) as k from (
select *, {side.format('la', 'lb')} + {side.format('(ta - la)', '(tb - lb)')} as score from (
select node, f, v, (sum(a) over w)::double as la, (sum(b) over w)::double as lb, sum(n) over w as ln, (sum(a) over g)::double as ta, (sum(b) over g)::double as tb,
  sum(n) over g as tn, lead(v) over w as nv from (
select node, f, x[f] as v, sum(a) as a, sum(b) as b, count(*) as n from (
select *, unnest(range(1, {len(S.WINDOW_FEATURES) + 1})) as f from {p}_rows{k} where not is_test and node >= {1 << k}) group by node, f, x[f])
window w as (partition by node, f order by v), g as (partition by node, f))
where nv is not null and ln >= {settings.least_rows} and tn - ln >= {settings.least_rows}
  and lb / {unit} >= {settings.least_bend!r}::double and (tb - lb) / {unit} >= {settings.least_bend!r}::double)
where score - {side.format('ta', 'tb')} > {settings.least_gain!r}::double) where k = 1"""
            CTES[f"{p}_rows{k + 1}"] = f"""
select r.* replace (case when b.node is null then r.node when r.x[b.f] <= b.th then 2 * r.node else 2 * r.node + 1 end as node)
from {p}_rows{k} r left join {p}_best{k} b on r.node = b.node"""
        CTES[f"{prefix}_m{t + 1}"] = f"""
select r.* exclude (node, a, b, chance) replace (m + step as m) from {p}_rows{settings.depth} r join (
select node, -(sum(a) / {unit}) / (sum(b) / {unit} + {settings.ridge!r}::double) * {settings.rate!r}::double as step from {p}_rows{settings.depth} where not is_test group by node) l on r.node = l.node"""


def boosted_scores(prefix: str, rounds: int, name: str) -> str:
    return f"select '{name}' as tree, label, attack_type, 1.0::double / (1.0::double + exp(-m)) as score, (1.0::double / (1.0::double + exp(-m)) > 0.5)::int as pred from {prefix}_m{rounds} where is_test"
