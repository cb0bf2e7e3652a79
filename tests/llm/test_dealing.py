"""Dense groups of near copies: no task gets more than two chunks, and no link is lost."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barsmith.llm import components, likeness, simhash
from barsmith.llm.dealing import meetings


def test_a_task_holds_at_most_two_chunks_and_all_pairs_of_classes_meet(spark):
    rows = [(1, 7, i) for i in range(900)] + [(1, 8, 1000 + i) for i in range(120)] + [(1, 20_000 + i, 2000 + i) for i in range(150)] + [(2, 5, 1), (2, 6, 2)] + [(3, 5, 1)] + [(4, 5, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, class bigint, item bigint")
    got = meetings(df, ["g"], "item", 100).collect()
    sizes = Counter((r["g"], r["meet"]) for r in got)
    assert max(sizes.values()) <= 260  # two chunks of about 100, dealt by hash
    assert {g for g, _ in sizes} == {1, 2}
    tasks = {}
    for r in got:
        tasks.setdefault((r["g"], r["meet"]), []).append((r["class"], r["item"]))
    met = {frozenset((a[1], b[1])) for rows in tasks.values() for k, a in enumerate(rows) for b in rows[:k] if a[0] != b[0]}
    first = [r for r in rows if r[0] == 1]
    assert all(frozenset((a[2], b[2])) in met for k, a in enumerate(first) for b in first[:k] if a[1] != b[1])
    assert len(got) < 12 * len(rows)
    assert meetings(df.limit(0), ["g"], "item", 100).count() == 0


@pytest.mark.parametrize("chunk", [8, 64])
def test_one_class_of_many_fingerprints(spark, chunk, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(8)
    base = int(rng.integers(0, 1 << 63))
    values = {base}
    while len(values) < 1500:
        v = base
        for k in rng.integers(0, 64, rng.integers(0, 6)):
            v ^= 1 << int(k)
        values.add(v)
    values |= {int(x) for x in rng.integers(0, 1 << 63, 500)}
    values = np.array(sorted(values), np.uint64)
    ids = values.view(np.int64).tolist()
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    label = np.arange(len(values))
    simhash._settle(label, *np.nonzero(near))
    fps = spark.createDataFrame([(i, i) for i in ids], "fp bigint, class bigint")
    balls = components.components(simhash.ball_links(fps)).withColumnRenamed("node", "fp")
    classes = fps.drop("class").join(balls, "fp", "left").select("fp", F.coalesce("root", "fp").alias("class")).persist()
    root = {r["node"]: r["root"] for r in components.components(simhash.class_links(classes)).collect()}
    got = [root.get(r, r) for r in map({r["fp"]: r["class"] for r in classes.collect()}.get, ids)]
    classes.unpersist()
    assert len(set(zip(got, label.tolist()))) == len(set(got)) == len(set(label.tolist()))
    dealt = meetings(simhash.nodes(classes), ["path", "key"], "fp", chunk).groupBy("path", "key", "meet").count()
    # two chunks, which vary as they are dealt by hash
    assert dealt.agg(F.max("count")).first()[0] <= 2 * (chunk + 6 * chunk**0.5)


def test_large_components_by_stars_and_chunks(spark, monkeypatch):
    """Two dense groups that share keys but are not linked, by brute force."""
    monkeypatch.setattr(likeness, "CHUNK", 12)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(150)]
    texts = []
    for part in (0, 1):
        mine = [w if i < 110 or not part else f"other{i}" for i, w in enumerate(words)]
        for _ in range(40):
            t = list(mine)
            for k in rng.integers(0, 150, 2):
                t[int(k)] = f"x{rng.integers(0, 1 << 30)}"
            texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    of = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label = np.arange(len(texts))
    simhash._settle(label, *np.nonzero([[len(a & b) / len(a | b) >= 0.8 for b in grams] for a in grams]))
    assert [of[i] for i in range(len(texts))] == label.tolist()
