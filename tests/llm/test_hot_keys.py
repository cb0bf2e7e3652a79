"""Null ids, hosts that hold most captures, a top-level host above all, vectors of extreme size."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from barsmith.llm import lattice, mixing, urls


def test_rows_without_an_id_are_spread_over_the_ranks(spark):
    docs = spark.range(4000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.lit("a").alias("source"))
    other = spark.range(300).select(F.lit(7).cast("bigint").alias("doc_id"), F.concat(F.repeat(F.lit("w "), 40), F.col("id").cast("string")).alias("text"), F.lit("b").alias("source"))
    rows = mixing.mix(docs.unionByName(other), share=0.5).collect()
    for source in ("a", "b"):
        mine = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 41
    digest = F.md5(F.encode("text", "UTF-8"))
    u = docs.select(mixing.uniform(F.concat(F.lit(":"), digest), 17).alias("u"))
    most = u.groupBy(F.floor(F.col("u") * 100)).count().agg(F.max("count")).first()[0]
    assert u.distinct().count() == 4000 and most < 90
    taken = {r["h"] for r in rows if r["source"] == "a" and r["copies"]}
    assert 100 < len(taken) < 4000  # some of them, by rank


def test_taken_rows_of_a_shuffled_plan(spark):
    docs = spark.range(3000).select((F.col("id") % 50).alias("doc_id"), F.concat(F.lit("t "), (F.col("id") % 70).cast("string")).alias("text"), (F.col("id") % 3).cast("string").alias("source"), F.col("id").alias("other"))
    shuffled = docs.repartition(5, "other").withColumn("rk", F.lit(1))
    want = Counter()
    for r in mixing.mix(shuffled).collect():
        want[r["doc_id"], r["source"]] += r["copies"]
    got = Counter((r["doc_id"], r["source"]) for r in mixing.taken_rows(shuffled).select("row.*").collect())
    assert got == +want


def test_no_part_of_a_busy_host_is_large(spark):
    hosts = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".com")).alias("host"), F.when(F.col("id") == 0, 5000).otherwise(1).alias("n"))
    busy = {r["host"]: r["parts"] for r in urls.heavy(hosts, "host", "n").collect()}
    assert busy == {"h0.com": -(-5000 * urls.SHARE // 7999)}
    under = hosts.select("host", F.explode(urls.above(F.col("host"))).alias("on"))
    wide = {r["on"]: r["parts"] for r in urls.heavy(under.groupBy("on").agg(F.count(F.lit(1)).alias("n")), "on", "n").collect()}
    assert wide == {"com": urls.SHARE // 2}
    assert urls.heavy(hosts.limit(0), "host", "n").count() == 0


def test_a_listed_top_level_host_and_a_busy_one(spark):
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 2 == 0, "http://busy.example.com/a/b").otherwise(F.concat(F.lit("http://h"), "id", F.lit(".com/x"))).alias("url"), F.lit("2024-02-01").cast("date").alias("fetched"))
    rows = [("com", "all"), ("busy.example.com/a/", "path"), ("example.com", "host"), ("h5.com/x", "one"), ("org", "none"), ("h7.com/y", "other")]
    listed = spark.createDataFrame([(p, c, "2024-01-01", "add") for p, c in rows], "pattern string, category string, day string, action string").withColumn("day", F.to_date("day"))
    got = {r["page_id"]: (r["categories"], r["n_entries"]) for r in urls.judge(pages, listed).collect()}
    assert got == {i: ("all,host,path", 3) if i % 2 == 0 else ("all,one", 2) if i == 5 else ("all", 1) for i in range(6000)}
    without = {r["page_id"]: r["n_entries"] for r in urls.judge(pages, listed.where("pattern <> 'com'")).collect()}
    assert without == {i: 2 if i % 2 == 0 else int(i == 5) for i in range(6000)}


def test_vectors_of_extreme_size(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 8))
    rows, k = [], 0
    for size in (1e-300, 1e-200, 1.0, 1e200, 1e300):
        for b in base:
            rows.append((k, (b / np.abs(b).max() * size).tolist()))
            k += 1
    got = {r["vec_id"]: r for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    for i in range(k):
        assert got[i]["component_id"] <= i % 20 and got[i]["n_links"] >= 4
    pair = spark.createDataFrame([(1, [1e-200] * 8), (2, [2e-200] * 8), (3, [1e200] * 8), (4, [0.0] * 8)], "vec_id bigint, embedding array<double>")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice.near_duplicates(pair).collect()} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}
