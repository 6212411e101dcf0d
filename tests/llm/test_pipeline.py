"""The pipeline's stages in turn, each against its operator on what came before."""

import corpus_pipeline
from airlens.llm import near_copies, pii, queries
from test_near_copies import plain, same


def test_stages(spark, sf_dir, tmp_path):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, kept = documents, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == documents.columns
        if name == "near_dedup":
            want = plain([(r.doc_id, r.text) for r in docs.collect()])
            assert same(near_copies.groups(docs).select("doc_id", "component_id").collect(), want)
            assert {r.doc_id for r in after.collect()} == {d for d, first in want if d == first}
        if name == "personal_data":
            assert after.count() == docs.count() and all(not pii.base_spans(r.text) for r in after.collect())
        if name == "best_fit_packing":
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in docs.collect()}
        kept.append(after.count())
        docs = after
    assert kept[0] >= 0.97 * documents.count() and kept[0] >= kept[1] >= kept[2] == kept[3]


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
