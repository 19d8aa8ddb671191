import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from censora.llm import pairwise, perplexity, pii
from censora.session import materialise
from tests.llm.test_shingles import brute_staying


@pytest.fixture(scope="module")
def folder():
    return "/root/testdata/sf0.001"


def test_stages_in_order_take_effect(spark, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "near_dedup", "personal_data", "best_fit_packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, folder), name)
        if name != "best_fit_packing":
            assert docs.columns == columns
        seen.append({r["doc_id"]: r for r in docs.collect()} if name != "best_fit_packing" else docs.collect())
    rules, classed, single, masked, packed = seen
    # Rules: nothing that fails the simple ones stays.
    assert all(len(t.split()) >= 50 for i, t in texts.items() if i in rules)
    assert set(classed) <= set(rules) and set(single) <= set(classed) and set(masked) == set(single)
    # Near-duplicates: the smallest id of each component among what came in, five words and a similarity of 0.8.
    assert set(single) == brute_staying({i: texts[i] for i in sorted(classed)})[0]
    # Personal data is masked, the rest untouched.
    for i, r in masked.items():
        assert r["text"] == pii.masked(texts[i]) and r["n_chars"] == len(r["text"])
    assert {r["doc_id"] for r in packed} == set(masked)


def test_run_is_the_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_awkward_rows_and_clashing_columns(spark, clashing, folder):
    docs = clashing
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = materialise(stage(spark, docs, folder), name)
        assert out.columns == docs.columns, name
        kept = {str(r) for r in out.drop("text", "n_chars").collect()}
        assert kept <= {str(r) for r in docs.drop("text", "n_chars").collect()}, name
        docs = out if name in ("near_dedup", "personal_data") else docs
    empty = clashing.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_reserved_names(clashing):
    assert "_lang" in clashing.columns and "score" in clashing.columns
    assert pairwise.ACCEPT == 0.3 and "kept" in perplexity.ADDED
