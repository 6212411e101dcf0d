"""Importance resampling against a plain version over all documents at once."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlens.llm import importance


def plain(rows, target, percent=10, least=20, grams=(1, 1)):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows, by one sort."""
    def found(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return ws, [" ".join(ws[k:k + n]) for n in range(grams[0], grams[1] + 1) for k in range(len(ws) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for text in texts for f in found(text)[1]) for texts in ([x for _, x in rows], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in range(10000)]
    out, able = [], []
    for doc_id, text in rows:
        ws, fs = found(text)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(ws) >= least:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    for k, row in enumerate(able[:len(able) * percent // 100]):
        row[4] = k + 1
    return sorted(map(repr, map(tuple, out)))


def taken(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_whole_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, wanted = [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()]
    assert taken(importance.resample(docs, target)) == plain(rows, wanted)
    assert taken(importance.resample(docs, target, percent=37, least_words=5, grams=(1, 2))) == plain(rows, wanted, 37, 5, (1, 2))
    found = importance.resample(docs, target)
    kept = importance.drawn_documents(docs, found)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in found.where("rank > 0").collect()}


def test_rows(spark, awkward, nothing):
    target = spark.createDataFrame([("The quick fox",), (None,), ("",)], "text string")
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    for percent in (0, 10, 50, 100):
        got = importance.resample(awkward, target, percent=percent, least_words=1)
        assert taken(got) == plain(rows, ["The quick fox", None, ""], percent, 1)
    assert importance.resample(nothing, target).count() == 0
    empty = target.where("false")
    assert taken(importance.resample(awkward, empty, 60, 0)) == plain(rows, [], 60, 0)


@pytest.mark.parametrize("kind", ["copies", "spread", "rising"])
def test_cutoff(spark, monkeypatch, kind):
    """The exact key in every partition order, with ties of a third of the rows, in few rounds and with small blocks."""
    monkeypatch.setattr(importance, "BLOCK", 64)
    n = 6000
    score = {"copies": F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.hash("id") % 20), "spread": F.hash("id"), "rising": F.col("id")}[kind]
    doc_id = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 7 > 0, F.col("id") % 50) if kind == "copies" else F.col("id")
    keys = spark.range(0, n, 1, 7).select(
        score.cast("long").alias("score"), doc_id.cast("long").alias("doc_id"), F.lit(1).cast("long").alias("n_features"), F.lit(2).cast("long").alias("weight"), F.col("id").alias("row")
    )
    rows = sorted((-r.score, r.doc_id is None, r.doc_id or 0, 1, 2, r.row) for r in keys.collect())
    rounds, medians = [], importance._medians
    monkeypatch.setattr(importance, "_medians", lambda pivot: (rounds.append(pivot), medians(pivot))[1])
    for wanted in (1, 600, n // 2, n):
        rounds.clear()
        assert importance.cutoff(keys, wanted).order == tuple(map(int, rows[wanted - 1]))
        assert len(rounds) <= 2 + math.log(n) / math.log(8 / 7)
    assert importance.cutoff(keys, 0) is None
    with pytest.raises(ValueError):
        importance.cutoff(keys, n + 1)


def test_weighted_median():
    rng = np.random.default_rng(1)
    for _ in range(50):
        keys, weights = rng.integers(0, 5, (30, 3)), rng.integers(1, 9, 30)
        line = sorted(tuple(k) for k, w in zip(keys.tolist(), weights.tolist(), strict=True) for _ in range(w))
        key, total = importance._middle(keys, weights)
        assert (tuple(key.tolist()), total) == (line[(len(line) + 1) // 2 - 1], len(line))
