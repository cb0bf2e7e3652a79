"""Rows that repeat, lengths that differ, columns that clash, tables that are empty."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barsmith.llm import lattice, mixing, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(1)
    rows = []
    for n in (1, 2, 7, 8, 9, 64, 100):
        for b in rng.normal(size=(12, n)):
            for _ in range(3):
                rows.append((b + rng.normal(size=n) * 0.12 * np.linalg.norm(b) / np.sqrt(n)).astype("f4").astype("f8").tolist())
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "vec_id bigint, embedding array<double>").withColumns({"n": F.lit(1), "rep": F.lit("x"), "cell": F.lit(0)})
    got = {r["vec_id"]: r for r in lattice.near_duplicates(df).collect()}
    links = np.zeros((len(rows), len(rows)), bool)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            links[i, j] = i != j and len(a) == len(b) and np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)) >= 0.95
    for n in (1, 2, 7, 8, 9, 64, 100):
        of = [i for i, r in enumerate(rows) if len(r) == n]
        want, found = links[of].sum(), sum(got[i]["n_links"] for i in of)
        assert want > 0 and 0.97 * want <= found <= want, n
    single = spark.createDataFrame([(1, [1.0] * 8), (2, [1.0] * 8), (3, [1.0] * 9)], "vec_id bigint, embedding array<float>")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in lattice.near_duplicates(single).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_mix_of_repeated_rows_meets_its_target(spark):
    same = spark.range(10_000, numPartitions=7).select(F.lit(3).cast("bigint").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("a").alias("source"))
    other = spark.range(500).select((F.col("id") + 10).alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"), F.when(F.col("id") % 2 == 0, "b").alias("source"))
    docs = same.unionByName(other).withColumns({"seat": F.lit("x"), "rk": F.lit(1), "copies": F.lit(2), "_part": F.lit(0)})
    rows = mixing.mix(docs).collect()
    for source in ("a", "b", None):
        mine = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 9 and all(r["taken"] <= 2 * r["size"] for r in mine)
    assert sorted(r["seat"] for r in rows if r["doc_id"] == 3) == list(range(10_000))
    key = lambda df: Counter((r["doc_id"], r["h"], r["seat"], r["taken"]) for r in df.collect())
    assert key(mixing.mix(docs)) == key(mixing.mix(docs.repartition(5)))
    taken = mixing.taken_rows(docs).select("row.*")
    assert taken.columns == docs.columns
    want = Counter()
    for r in rows:
        want[r["doc_id"]] += r["copies"]
    assert Counter({r["doc_id"]: r["count"] for r in taken.groupBy("doc_id").count().collect()}) == +want
    assert mixing.taken_rows(docs.limit(0)).count() == 0


def documents():
    words = lambda k, n=60: " ".join(f"d{k}x{i}" for i in range(n))
    rows = [(i, words(i), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(5, words(5), "en", "s2", 1)] * 20 + [(None, words(5), "en", "s2", 1), (None, None, None, None, None), (None, None, "en", "s0", 0), (7, "", "en", "s1", 0), (8, words(8) + " tail", None, None, 3), (99, words(99, 20_000), "en", "s0", 5)]
    return rows


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_with_odd_rows(spark, name):
    """Nulls, repeats, ids with two texts, a long text, clashing columns, and nothing at all."""
    data = "/root/testdata/sf0.001"
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(documents(), SCHEMA).withColumns({"row": F.lit(1), "score": F.lit("x"), "h": F.lit(2), "class": F.lit(3), "rk": F.lit(4), "vector": F.lit(5), "key": F.lit(6), "text_hash": F.lit(7), "none": F.lit(8)})
    got = corpus_pipeline.written(stage(spark, docs, data), name)
    assert stage(spark, docs.limit(0), data).count() == 0
    if name == "packing":
        assert got.agg(F.sum("length")).first()[0] >= docs.count()
        return
    assert got.columns == docs.columns
    before = Counter(map(str, docs.collect()))
    after = Counter(map(str, got.collect()))
    assert set(after) <= set(before)
    if name == "simhash":
        texts = {(r["text"] or "").replace(" tail", "") for r in docs.collect()}
        assert len(after) == len(texts) and max(after.values()) == 1
        assert got.where("doc_id = 5").count() == 1 and got.where("doc_id is null and text is not null").count() == 0
    if name == "mixing":
        sizes = {r["source"]: r for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
        for r in got.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect():
            assert r["n"] == sizes[r["source"]]["taken"]


def test_smallest_id_of_a_class(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q r s"), (None, None), (2, "")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == [(1, 1), (2, 2), (3, 1), (None, 1), (None, 2), (None, None)]


@pytest.mark.parametrize("joint", [1, 2])
def test_recall_by_blocks_in_a_key(spark, joint):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(150, 64))
    rows = np.repeat(base, 4, axis=0) + rng.normal(size=(600, 64)) * rng.uniform(0.02, 0.2, (600, 1))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id bigint, embedding array<double>")
    u = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(600, dtype=bool)
    got = lattice.near_duplicates(df, joint=joint).collect()
    found = sum(r["n_links"] for r in got)
    assert 0.9 * near.sum() <= found <= near.sum() and (joint == 2 or found >= 0.99 * near.sum())
