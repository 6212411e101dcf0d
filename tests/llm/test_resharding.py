"""Bytes moved by resharding against brute force and against the flow's own value."""

import itertools

import pytest
from pyspark.sql import functions as F

from airlens.llm import resharding
from airlens.operators.stage import stage


def described(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int")
    return stage(resharding.described(docs, F.col("at")).select("doc_id", "old", "h", "size"))


@pytest.mark.parametrize("old,shards", [([6, 2, 1], 3), ([9, 0, 0], 3), ([4, 4, 1], 3), ([5, 4], 3), ([3, 3, 3], 3)])
def test_rows_of_one_size_move_as_few_as_can_be(spark, old, shards):
    rows = [(100 * s + k, f"row {s} {k}.", s) for s, n in enumerate(old) for k in range(n)]
    narrow = described(spark, rows)
    layout = resharding.solve(narrow, shards)
    at = [s for _, _, s in rows]
    best = min(
        sum(a != b for a, b in zip(at, new, strict=True)) for new in itertools.product(range(shards), repeat=len(rows)) if all(new.count(s) == len(rows) // shards for s in range(shards))
    )
    size = len("row 0 0.") + resharding.OVERHEAD
    assert resharding.moved_bytes(narrow, layout) == best * size == resharding.planned_bytes(layout)
    assert sorted(r["count"] for r in layout.of(narrow).groupBy("shard").count().collect()) == [len(rows) // shards] * shards


def test_given_tables_move_little_more_than_the_flow(spark, sf_dir):
    for sf, over in (("0.001", 0.15), ("0.01", 0.01)):
        docs = spark.read.parquet(sf_dir.replace("0.001", sf) + "/documents.parquet").select("doc_id", "text")
        narrow = stage(resharding.described(docs, resharding.by_hash(16)).select("doc_id", "old", "h", "size"))
        layout = resharding.solve(narrow)
        largest = narrow.agg(F.max("size")).first()[0]
        moved, planned = resharding.moved_bytes(narrow, layout), resharding.planned_bytes(layout)
        assert sum(n for _, _, n in layout.transfers) == layout.total
        assert moved <= planned + largest * (len(layout.transfers) + len(layout.single)) and moved <= planned + over * layout.total
        by = [r[1] for r in layout.of(narrow).groupBy("shard").sum("size").collect()]
        assert len(by) == 24 and max(by) - min(by) <= max(0.003 * layout.total / 24, 2)


def test_rows_larger_than_a_shard_and_repeated_ones(spark):
    rows = [(1, "x" * 5000, 0), (2, "y" * 4000, 0), (3, "z" * 900, 1)] + [(9, "same", 1)] * 30 + [(10 + k, "w" * 20, k % 2) for k in range(60)]
    narrow = described(spark, rows)
    layout = resharding.solve(narrow, 4)
    placed = {(r.doc_id, r.size): r.shard for r in layout.of(narrow).collect()}
    assert len(layout.of(narrow).select("doc_id", "shard").where("doc_id = 9").distinct().collect()) == 1
    assert len({placed[1, 5008], placed[2, 4008]}) == 2
    assert layout.of(narrow).count() == len(rows)


def test_evening_out_lowers_the_spread():
    sizes = [100, 10, 55, 55]
    rows = [(0, n, 0, n) for n in (10, 20, 25, 45)] + [(1, 10, 1, 99)]
    where = resharding.even_out(sizes, rows)
    after = list(sizes)
    for shard, n, old, h in rows:
        if (old, h) in where:
            after[shard] -= n
            after[where[old, h]] += n
    assert where and max(after) - min(after) < 20 and sum(after) == sum(sizes)
    assert resharding.even_out([5, 5, 5], []) == {}
