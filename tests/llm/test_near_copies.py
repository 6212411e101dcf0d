"""Near-copies against all pairs, on planted ones and the awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from airlens.llm import near_copies


def same(got, want):
    return sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def plain(rows):
    sets = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(d, least.get(r)) for (d, _), r in zip(rows, root, strict=True)]


def test_planted_near_copies(spark, awkward, nothing):
    rng = np.random.default_rng(3)
    words, rows = [f"w{k}" for k in range(3000)], []
    for d in range(60):
        text = rng.choice(words, 200).tolist()
        rows.append((d, " ".join(text)))
        for k, changes in enumerate((2, 3, 4, 5, 8)):  # about 0.9, 0.86, 0.82, 0.78 and 0.67
            copy = list(text)
            for at in rng.choice(200, changes, replace=False):
                copy[at] = "changed"
            rows.append((1000 + 10 * d + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_copies.groups(docs).select("doc_id", "component_id").collect()
    assert same(got, plain(rows)) and len({r.component_id for r in got}) < len(rows)
    stayed = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert stayed == {r.component_id for r in got} and not stayed & {1000 + 10 * d for d in range(60)}
    got = near_copies.groups(awkward).select("doc_id", "component_id").collect()
    assert same(got, plain([(r.doc_id, r.text) for r in awkward.collect()]))
    kept = near_copies.keep_first(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id = 1").count() == 1
    assert near_copies.keep_first(nothing).count() == 0


def family(rng, n, words=160, base=True):
    """Copies of one text with up to nine words changed, a few of them alike."""
    text, rows = [f"w{k}" for k in range(words)], []
    for d in range(n):
        copy = list(text)
        for at in rng.choice(words, 0 if base and d == 0 else int(rng.integers(1, 10)), replace=False):
            copy[at] = f"n{d}" if rng.random() < 0.9 else "alike"
        rows.append((d, " ".join(copy)))
    return rows


@pytest.mark.parametrize("base", [True, False])
def test_family_equals_all_pairs_in_few_comparisons(spark, monkeypatch, base):
    seen, links = [], near_copies._links
    monkeypatch.setattr(near_copies, "_links", lambda pairs, sets: (seen.append(pairs.count()), links(pairs, sets))[1])
    taken = []
    for n in (200, 400):
        seen.clear()
        rows = family(np.random.default_rng(n), n, base=base)
        got = near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()
        assert same(got, plain(rows))
        taken.append(sum(seen))
    if base:
        assert taken[1] <= 2.5 * taken[0] and taken[1] < 20 * 400


def test_recall_of_pairs(spark):
    """Pairs a little above the similarity, planted one by one: none of them shares a pivot."""
    rows = []
    for d in range(400):
        text = [f"p{d}w{k}" for k in range(100)]
        copy = list(text)
        for at in (20, 70):  # 10 of 96 shingles: 86/106 = 0.811
            copy[at] = "changed"
        rows += [(2 * d, " ".join(text)), (2 * d + 1, " ".join(copy))]
    got = near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = sum(r.component_id == r.doc_id // 2 * 2 for r in got)
    assert want >= 0.99 * len(rows)


def test_fingerprints_meet_without_bands(spark):
    """Near-copies whose SimHash fingerprints lie within the radius are found by the covering masks alone."""
    rows, want = [], set()
    for d in range(60):
        text = [f"s{d}w{k}" for k in range(120)]
        copies = [text, [*text[:-1], "changed"], [*text[:60], "changed", *text[61:]], text[:70]]
        rows += [(4 * d + k, " ".join(words)) for k, words in enumerate(copies)]
        prints = [near_copies.simhash.of_hashes(near_copies.shingles(" ".join(words))) for words in copies]
        want |= {4 * d + k for k in (1, 2) if (prints[0] ^ prints[k]).bit_count() <= near_copies.RADIUS}
    assert len(want) > 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketched = near_copies._sketched(docs).withColumn("bands", F.array().cast("array<long>"))
    nodes = near_copies._nodes(sketched)
    tree = near_copies._components(nodes, docs)
    found = {r.component: set() for r in tree.collect()}
    for r in tree.join(nodes, "node").collect():
        found[r.component].add(r["first"])
    linked = {d: group for group in found.values() for d in group}
    assert all(d // 4 * 4 in linked.get(d, ()) for d in want)
    assert all(len({d // 4 for d in group}) == 1 and all(d % 4 != 3 for d in group) for group in found.values())
