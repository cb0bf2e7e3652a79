"""The pipeline's stages against plain Python on the smallest tables."""

from collections import Counter

import corpus_pipeline
from barsmith.llm import mixing, quality, simhash, toxicity
from tests.llm.test_operators import check_pieces


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash", "mixing", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = corpus_pipeline.written(stage(spark, before, data), name)
        ids = [r["doc_id"] for r in before.collect()]
        got = Counter(r["doc_id"] for r in kept.collect())
        if name == "toxicity":
            assert set(got) == {r["doc_id"] for r in toxicity.classify(before, labels).where("predicted = 0").collect()}
        if name == "quality":
            assert set(got) == {r["doc_id"] for r in quality.classify(before, labels).where("predicted = 1").collect()}
        if name == "simhash":
            assert set(got) == {r["component_id"] for r in simhash.near_duplicates(before, width=5).collect()} and max(got.values()) == 1
        if name == "mixing":
            assert got == Counter({r["doc_id"]: r["copies"] for r in mixing.mix(before).collect() if r["copies"]})
        if name != "packing":
            assert kept.columns == columns and set(got) <= set(ids)
    once = before.dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in once.collect()}
    check_pieces(corpus_pipeline.pack_sequences(spark, once, data).collect(), texts)
    assert sum(r["length"] for r in kept.collect()) >= sum(1 for _ in ids)
