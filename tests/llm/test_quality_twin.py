"""The ridge weights of partition sums against one plain solve, and isotonic rates against a plain pooling."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from barsmith.llm import quality


def test_weights_by_one_solve(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    stats = quality.measured(docs.select("doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), "vector")
    model = quality.fit(stats, labels, size=64)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = [(texts[r["doc_id"]], float(r["quality"])) for r in labels.collect() if r["quality"] is not None and r["doc_id"] in texts and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    x, y = np.array([quality.statistics(t) for t, _ in rows]), np.array([v for _, v in rows])
    mean, spread = x.mean(axis=0), x.std(axis=0)
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, np.where(spread > 1e-9, spread, 1.0))
    z = np.clip((x - mean) / model.scale, -6, 6)
    f = np.hstack([np.sqrt(2 / 64) * np.cos(z @ model.directions + model.phases), np.ones((len(x), 1))])
    want = np.linalg.solve(f.T @ f + 1e-3 * len(x) / 64 * np.eye(65), f.T @ y)
    assert np.allclose(f @ model.weights, f @ want, atol=1e-6)


def test_stage_learns_as_the_query_does(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    one = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    two = {r["i"]: r["score"] for r in quality.score_rows(docs, labels).select(F.col("row.doc_id").alias("i"), "score").collect()}
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-6 for i in one)


def test_isotonic_by_plain_pooling():
    rng = np.random.default_rng(2)
    n, good = rng.integers(1, 9, 40).astype(float), None
    good = np.minimum(n, rng.integers(0, 9, 40)).astype(float)
    _, rates = quality.isotonic(np.arange(40.0), n, good)
    # the least squares fit that never falls: the largest mean from the left of the smallest mean to the right
    want = [max(min(good[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    assert np.allclose(sorted(set(np.round(rates, 9))), sorted(set(np.round(want, 9))))


def plain_statistics(text):
    """STATISTICS, one by one."""
    raw = text.encode()
    words = raw.split()
    n, w = len(raw), len(words)
    if not w:
        return [np.log1p(n)] + [0.0] * (len(quality.STATISTICS) - 1)
    share = lambda test: sum(map(test, raw)) / n
    letter, digit, capital, space = (lambda c: chr(c).isalpha() and c < 128), (lambda c: 48 <= c <= 57), (lambda c: 65 <= c <= 90), (lambda c: c == 32 or 9 <= c <= 13)
    mark, beyond = (lambda c: c in b".,;:!?'\"-()"), (lambda c: c >= 128)
    lines = [x for x in raw.split(b"\n") if x]
    lengths = [len(x) for x in words]
    mean = sum(lengths) / w
    return [
        np.log1p(n), np.log1p(w), mean, (sum((x - mean) ** 2 for x in lengths) / w) ** 0.5, np.log1p(max(lengths)),
        share(letter), share(digit), share(capital), share(space), share(mark), share(lambda c: not (letter(c) or digit(c) or space(c) or mark(c) or beyond(c))), share(beyond),
        len(lines) / w, 1 - len(set(lines)) / len(lines), len(set(words)) / w, max(words.count(x) for x in set(words)) / w,
        sum(a == b for a, b in zip(words, words[1:])) / w, len(set(zip(words, words[1:]))) / w, sum(x.isupper() for x in words) / w,
        sum(not x[-1:].isalnum() and x[-1] < 128 and x[-1] not in b".,;:" for x in words) / w, -sum(raw.count(bytes([c])) / n * np.log(raw.count(bytes([c])) / n) for c in set(raw)),
    ]


def test_statistics_by_plain_counts():
    texts = ["", "   ", "a", "Zwei WÖRTER zwei wörter!", "one one two\n\none one two\nTHREE, four; (five) 66% 7-8 é汉", "x" * 300 + " y", "A\tb\x0bc\r\nd?"]
    texts += [r["text"] for r in __import__("duckdb").sql("select text from '/root/testdata/sf0.001/documents.parquet' where length(text) < 3000 limit 40").df().to_dict("records")]
    for t in texts:
        assert np.allclose(quality.statistics(t), plain_statistics(t)), t


def test_rows_to_learn_from_are_bounded(spark):
    """30,000 rows of two labelled ids: repeats count once, and no more than the bound are taken."""
    docs = spark.range(30_000, numPartitions=5).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 3000).cast("string")).alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id bigint, quality int")
    of = lambda most: quality.labelled(docs, labels, "quality", 1, 5, most)
    every = of(20_000)
    assert every.count() == every.distinct().count() == 3000 and every.columns == ["doc_id", "text", "y"]
    some = of(1000)
    assert 850 < some.count() <= 1000 and sorted(map(tuple, some.collect())) == sorted(map(tuple, of(1000).collect()))
    assert of(1).count() <= 1
    assert {(r["doc_id"], r["y"]) for r in every.collect()} == {(0, 1.0), (1, 0.0)}


def test_a_very_long_text_is_scored(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    body = " ".join(r["text"] for r in docs.limit(500).collect())
    long = spark.createDataFrame([(10**9, body)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs.select("doc_id", "text").unionByName(long), labels).collect()}
    assert len(body) > 10**6 and 0 <= got[10**9] <= 1
