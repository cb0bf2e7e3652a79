"""The pipeline's classes of near copies against brute-force Jaccard."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barsmith.llm import likeness, mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def grams(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def copies(n=300):
    """Texts of 60 to 400 words, each with a copy of which up to a few words are others."""
    rng = np.random.default_rng(3)
    out = []
    for k in range(n):
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 400))]
        other = list(words)
        for j in rng.integers(0, len(words), rng.integers(0, 1 + len(words) // 40)):
            other[j] = f"new{k}-{j}"
        out += [" ".join(words), " ".join(other)]
    return out


def test_recall_and_precision_by_brute_force(spark):
    texts = copies()
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    of = {r["doc_id"]: r["class"] for r in likeness.near_copies(df).collect()}
    sets = [grams(t) for t in texts]
    like = [jaccard(sets[i], sets[i + 1]) for i in range(0, len(texts), 2)]
    near = [of[2 * k] == of[2 * k + 1] for k, x in enumerate(like) if x >= 0.8]
    assert sum(0.8 <= x < 0.9 for x in like) >= 50 and sum(near) == len(near)
    assert not any(of[2 * k] == of[2 * k + 1] for k, x in enumerate(like) if x < 0.8) and any(x < 0.8 for x in like)


@pytest.mark.parametrize("chunk", [3, 512])
def test_chain_of_near_copies_is_one_class(spark, chunk, monkeypatch):
    monkeypatch.setattr(likeness, "CHUNK", chunk)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words)]
    for k in range(20):
        words[k * 9] = f"x{k}"
        texts.append(" ".join(words))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate([*texts, None, " ", "one two"])], SCHEMA)
    rows = likeness.near_copies(df).collect()
    of = {r["doc_id"]: r["class"] for r in rows}
    assert len(rows) == len(texts) + 3 and len({of[i] for i in range(len(texts))}) == 1
    assert len(set(of.values())) == 3 and of[len(texts)] == of[len(texts) + 1]
    assert likeness.near_copies(df.limit(0)).count() == 0


def test_stage_keeps_one_of_each(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = [grams(r["text"]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and jaccard(sets[i], sets[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    want = {min(r["doc_id"] for r, y in zip(rows, label) if y == x) for x in set(label)}
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, data).collect()} == want


def test_null_and_repeated_ids_stay(spark, data):
    words = lambda k: " ".join(f"d{k}x{i}" for i in range(40))
    rows = [(None, words(0), "en", "a", 0), (None, words(1), "en", "a", 0), (None, words(2), "en", None, 0), (7, words(3), "en", "a", 0), (7, words(4), "en", "b", 0), (8, words(5), "en", "b", 0), (8, words(5), "en", "b", 0), (None, words(5), "en", "b", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.one_of_each(spark, df, data)
    assert kept.columns == df.columns
    assert sorted(r["text"] for r in kept.collect()) == sorted({r[1] for r in rows}) and kept.where(F.col("text") == words(5)).first()["doc_id"] == 8
    plan = [(r["doc_id"], r["h"]) for r in mixing.mix(kept).collect() for _ in range(r["copies"])]
    mixed = corpus_pipeline.mix_sources(spark, kept, data)
    got = [(r["doc_id"], r["h"]) for r in mixed.withColumn("h", F.xxhash64("text")).collect()]
    assert mixed.columns == df.columns and sorted(got, key=str) == sorted(plan, key=str) and {i for i, _ in got} >= {None, 7}


def slow_print(found, which, tries):
    factor, term = (x[which, 0] for x in likeness._orders(tries))
    bits = []
    for h in found:
        x = (int(factor) * int(h) + int(term)) % 2**64
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64
        bits.append(x ^ x >> 32)
    return sum(1 << k for k in range(64) if 2 * sum(b >> k & 1 for b in bits) > len(bits))


def test_candidates_are_pairs_that_a_trie_holds_near(spark, monkeypatch):
    """Every pair within the budget below one node is joined, and nothing but such pairs, by brute force; nodes dealt in chunks too."""
    rng = np.random.default_rng(8)
    top, tries, sets = 2, 3, []
    for _ in range(60):
        base = rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64)
        sets += [base, np.concatenate((base[: -(len(base) // 7) or None], rng.integers(0, 1 << 63, len(base) // 9, dtype=np.uint64)))]
    prints = np.array([likeness.fingerprints(s, tries) for s in sets])
    assert prints[:9].tolist() == [[slow_print(s, k, tries) for k in range(tries)] for s in sets[:9]]
    label = np.arange(len(sets))
    for k in range(tries):
        one, two = prints[:, k], prints[:, (k + 1) % tries]
        apart = np.bitwise_count(one[:, None] ^ one).astype(int)
        near = (apart <= likeness.BUDGET) & (apart + np.bitwise_count(two[:, None] ^ two) <= likeness.WHOLE) & (one[:, None] >> np.uint64(64 - top) == one >> np.uint64(64 - top))
        likeness.settle(label, *np.nonzero(near))
    df = spark.createDataFrame([(i, p.view(np.int64).tolist()) for i, p in enumerate(prints)], "node bigint, prints array<bigint>")
    for most in (2048, 8):
        monkeypatch.setattr(likeness, "MEET", most)
        root = {r["node"]: r["root"] for r in likeness.components(likeness.trie_links(df, top, tries)).collect()}
        got = [root.get(i, i) for i in range(len(sets))]
        assert len(set(zip(got, label.tolist()))) == len(set(got)) == len(set(label.tolist())) < 90


def test_tries_miss_few_pairs():
    for rows in (0, 500, 10**4, 10**6, 10**8):
        top, tries = likeness.tries_for(rows)
        differ = np.arccos(1.6 / 1.8) / np.pi
        rng = np.random.default_rng(2)
        found = np.mean(rng.binomial(64 - top, differ, 100_000) <= likeness.BUDGET) * (1 - differ) ** top
        assert (1 - found) ** tries < 1.2e-4 and (rows / 2**top <= likeness.NODE or top == likeness.TOP)
