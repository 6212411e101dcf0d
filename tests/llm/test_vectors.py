"""Operators on vectors against brute force, with the awkward rows."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from airlens.llm import near_vectors, nearest, queries
from airlens.llm.components import connected_components

SCHEMA = "vec_id long, embedding array<float>, label int, n long"


def frame(spark, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0, 7) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


def clustered(seed=0, n=400, d=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[50:200] = x[:1] + 0.12 * rng.normal(size=(150, d)) * np.linalg.norm(x[0]) / np.sqrt(d)
    x[200:230] = x[5]
    return [(int(i), v.astype(np.float32)) for i, v in enumerate(x)]


AWKWARD = [(1000, None), (1001, []), (1002, [0] * 8), (1003, [1] * 7 + [None]), (1004, [float("nan")] * 8), (1005, [float("inf")] + [0] * 7), (1006, [1, 2]), (1, [1] * 8), (None, [2] * 8)]


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (250, 2))] + [(0, k) for k in range(400, 600)] + [(k, k + 1) for k in range(700, 760)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("block", [4096, 64])
def test_near_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    monkeypatch.setattr(near_vectors, "FAN", 2)
    rows = clustered() + AWKWARD
    got = near_vectors.near_duplicates(frame(spark, rows)).collect()
    good = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) == 8 and None not in list(v) and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    x = np.array([rows[k][1] for k in good], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(hit, label[None, :], len(x)).min(1))
        if (new == label).all():
            break
        label = new
    least = {}
    for k, c in enumerate(label):
        if rows[good[k]][0] is not None:
            least[c] = min(least.get(c, 1 << 60), rows[good[k]][0])
    want = [(i, 0, i, True) for k, (i, _) in enumerate(rows) if k not in good]
    want += [(rows[good[k]][0], int(hit[k].sum()), least.get(c), rows[good[k]][0] == least.get(c)) for k, c in enumerate(label)]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_near_vectors_without_rows(spark):
    assert near_vectors.near_duplicates(frame(spark, [])).count() == 0
    assert [tuple(r) for r in near_vectors.near_duplicates(frame(spark, [(4, [0, 0])])).collect()] == [(4, 0, 4, True)]


def test_near_vectors_equal_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    want = con.execute(queries.ORACLES["op4_near_vectors"]).fetchdf().sort_values("vec_id").reset_index(drop=True)
    got = queries.QUERIES["op4_near_vectors"](spark, sf_dir).toPandas().sort_values("vec_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)


def test_parts_are_balanced():
    x = np.random.default_rng(0).normal(size=(333, 6))
    sizes = np.bincount(nearest.balanced_parts(nearest._neighbours(x, 5), 8))
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 3


def exact(rows, query, k=20):
    good = [(i, np.array(v, float)) for i, v in rows]
    q = dict(good)[query]
    return sorted((-float(q @ v), i) for i, v in good if i != query)[:k]


def test_search(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 2
    rows = [(i, (centres[i % 12] + rng.normal(size=16)).astype(np.float32)) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(60)]  # copies: ties go to smaller ids
    got = nearest.search(frame(spark, rows + [(1700, None), (1720, [0] * 16), (None, rows[3][1])]), "vec_id % 20 = 0").toPandas()
    hits, total = 0, 0
    for query, found in got.groupby("query_id"):
        found = found.sort_values("rank")
        assert found["rank"].tolist() == list(range(1, 21)) and query not in set(found["vec_id"])
        assert list(zip(-found["score"], found["vec_id"], strict=True)) == sorted(zip(-found["score"], found["vec_id"], strict=True))
        hits += len(set(found["vec_id"]) & {i for _, i in exact(rows, query)})
        total += 20
    assert set(got["query_id"]) == {i for i, _ in rows if i % 20 == 0} and hits / total >= 0.9
    zero = got[got["query_id"] == 0].sort_values("rank")
    want = exact(rows, 0)
    assert zero["vec_id"].tolist() == [i for _, i in want]


def test_search_gives_all_of_few(spark):
    rows = [(20, [1.0, 0.0]), (3, [0.5, 1.0]), (4, [2.0, 0.0])]
    got = nearest.search(frame(spark, rows), "vec_id % 20 = 0").orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(20, 1, 4, 2.0), (20, 2, 3, 0.5)]
    assert nearest.search(frame(spark, []), "vec_id % 20 = 0").count() == 0


def test_equal_queries_are_ranked_once(spark, monkeypatch):
    rng, sizes, blocks = np.random.default_rng(2), {}, nearest._blocks

    def counted(rows, keys, dimension, side):
        sizes[side] = rows.count()
        return blocks(rows, keys, dimension, side)

    monkeypatch.setattr(nearest, "_blocks", counted)
    monkeypatch.setattr(nearest, "BLOCK", 16)
    same = rng.normal(size=8).astype(np.float32)
    rows = [(i, same if i % 3 else rng.normal(size=8).astype(np.float32)) for i in range(300)]
    got = nearest.search(frame(spark, rows), "vec_id % 2 = 0").toPandas()
    assert sizes["q"] == 50 + 1 and set(got["query_id"]) == set(range(0, 300, 2))
    for query, found in got.groupby("query_id"):
        assert found.sort_values("rank")["vec_id"].tolist() == [i for _, i in exact(rows, query)]


def test_each_dimension_for_itself(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4 + i % 3).astype(np.float32)) for i in range(240)]
    rows += [(300 + i, rows[i][1]) for i in range(6)]  # copies in every dimension
    got = {r.vec_id: r for r in near_vectors.near_duplicates(frame(spark, [*rows, (900, None)])).collect()}
    assert all(got[300 + i].component_id == got[i].component_id and got[300 + i].n_links >= 1 and not got[300 + i].kept for i in range(6))
    for i, v in rows:
        cosines = [float(np.dot(v.astype(float), w.astype(float)) / np.linalg.norm(v.astype(float)) / np.linalg.norm(w.astype(float))) for j, w in rows if j != i and len(w) == len(v)]
        assert got[i].n_links == sum(c >= 0.95 for c in cosines)
    found = nearest.search(frame(spark, rows), "vec_id % 20 = 0").toPandas()
    sizes = {i: len(v) for i, v in rows}
    assert set(found["query_id"]) == {i for i, _ in rows if i % 20 == 0}
    assert all(sizes[q] == sizes[v] for q, v in zip(found["query_id"], found["vec_id"], strict=True))
    assert found.groupby("query_id").size().eq(20).all()


def test_queries_in_nearly_empty_parts_go_on(spark, monkeypatch):
    """Two far clusters of very different size: a query of the small one still gets all it asks for."""
    rng = np.random.default_rng(10)
    monkeypatch.setattr(nearest, "parts_for", lambda count: 4)
    monkeypatch.setattr(nearest, "RECALL", 0.0)
    rows = [(i, (np.eye(8)[0] * 9 + rng.normal(size=8) * 0.1).astype(np.float32)) for i in range(400)]
    rows += [(1000 + 20 * i, (-np.eye(8)[i % 2 + 1] * 9 + rng.normal(size=8) * 0.1).astype(np.float32)) for i in range(7)]
    found = nearest.search(frame(spark, rows), "vec_id >= 1000").toPandas()
    assert found.groupby("query_id").size().eq(20).all() and found["query_id"].nunique() == 7
