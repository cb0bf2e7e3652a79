"""Overlap, medians and ranges against plain loops, with blocks so small that everything crosses them."""

import random
from statistics import median as plain_median

import pytest
from pyspark.sql import functions as F

from barsmith.operators import quantiles, ranges, similarity, simulate

H = 3_600_000
TRADES = "id string, symbol string, end_index bigint, entry_time bigint, exit_time bigint, skip_reason string"


def made(seed, n=400, symbols=("NQ", "ES")):
    r = random.Random(seed)
    rows = []
    for s in symbols:
        at = 0
        for k in range(n):
            at += r.choice((0, 0, 1, 1, 2, 30))
            rows.append((f"{s}{k:04d}", s, at, at * H, (at + r.choice((0, 1, 1, 2, 5, 40))) * H, "no_atr" if r.random() < 0.1 else None))
    return rows


def folded(rows):
    out, until = {}, {}
    for i, s, _, begins, ends, reason in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if reason is None and s in until and begins < until[s]:
            reason = "overlap"
        elif reason is None:
            until[s] = ends
        out[i] = reason
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_overlap_by_blocks(spark, block):
    rows = made(block)
    df = spark.createDataFrame(rows, TRADES)
    got = {r["id"]: r["skip_reason"] for r in simulate.without_overlap(df, block).collect()}
    assert got == folded(rows) and {"overlap", None} <= set(got.values())
    assert simulate.without_overlap(df.limit(0), block).count() == 0
    assert simulate.without_overlap(df.where("skip_reason is not null"), block).where("skip_reason = 'overlap'").count() == 0


def test_medians(spark):
    r = random.Random(1)
    for values in ([3.0], [3.0, 1.0], [2.0] * 9, [1.0, 2.0, 2.0, 9.0], [r.gauss(0, 1) for _ in range(501)], [r.gauss(0, 1) * 10 ** r.randint(-9, 9) for _ in range(500)], [float(r.randint(0, 3)) for _ in range(300)], [1.0] * 50 + [2.0] * 50, [-1e300, 0.0, 1e300, 5e-324]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
        for bins in (7, 1024) if len(values) < 400 else (32,):
            assert quantiles.median(df, "x", bins) == plain_median(values), (values[:5], bins)
        ordered = sorted(values)
        for rank in (len(values) // 3,):
            assert quantiles.nth(df, "x", rank) == (ordered[rank], sum(v <= ordered[rank] for v in values))
    assert quantiles.median(df.limit(0), "x") is None


def cells(spans):
    return {t for a, b in spans for t in range(a, b + 1)}


@pytest.mark.parametrize("seed", range(2))
def test_ranges_by_instants(spark, monkeypatch, seed):
    monkeypatch.setattr(ranges, "STRETCH", 7)
    r = random.Random(seed)
    spans = lambda n: [(s, i, a, a + r.randint(0, 6)) for s in ("NQ", "ES") for i in ("1h",) for a in (r.randint(0, 90) for _ in range(n))]
    covered, wanted = spans(12) + [("NQ", "5m", 0, 50)], spans(9) + [("YM", "1h", 5, 9), ("NQ", "1h", 0, 120), ("NQ", "1h", 0, 120), ("ES", "1h", 9, 3)]
    frame = lambda rows: spark.createDataFrame(rows, "symbol string, interval string, start bigint, end bigint")
    got = ranges.missing(frame(covered), frame(wanted)).collect()
    by = {}
    for s, i, a, b in covered:
        by.setdefault((s, i), []).append((a, b))
    want = set()
    for s, i, a, b in set(wanted):
        left = sorted(set(range(a, b + 1)) - cells(by.get((s, i), [])))
        for t in left:
            if t - 1 not in left:
                end = t
                while end + 1 in left:
                    end += 1
                want.add((s, i, t, end))
    assert {tuple(x) for x in got} == want
    for reach, name in ((0, "merge"), (3, "coalesce")):
        joined = ranges.merge(frame(covered)) if name == "merge" else ranges.coalesce(frame(covered), 1, 3)
        plain = set()
        for (s, i), v in by.items():
            start = end = None
            for a, b in sorted(v):
                if end is not None and a <= end + reach:
                    end = max(end, b)
                else:
                    if end is not None:
                        plain.add((s, i, start, end))
                    start, end = a, b
            plain.add((s, i, start, end))
        assert {tuple(x) for x in joined.collect()} == plain
    rows = frame(wanted).where("start <= end").withColumn("n", F.monotonically_increasing_id())
    free = {tuple(x) for x in ranges.outside(rows, frame(covered), "start", "end", ["symbol"]).select("symbol", "start", "end").collect()}
    all_of = {s: cells([c for (k, _), v in by.items() if k == s for c in v]) for s in ("NQ", "ES", "YM")}
    assert free == {(s, a, b) for s, _, a, b in wanted if a <= b and not all_of[s] & set(range(a, b + 1))}


def test_many_requests_against_many_ranges_of_one_key(spark):
    """10,000 requests and 100,000 ranges of one key: rows grow with their sum."""
    covered = spark.range(100_000).select(F.lit("NQ").alias("symbol"), F.lit("1h").alias("interval"), (F.col("id") * 10 * H).alias("start"), (F.col("id") * 10 * H + 7 * H).alias("end"))
    wanted = spark.range(10_000).select(F.lit("NQ").alias("symbol"), F.lit("1h").alias("interval"), (F.col("id") * 100 * H).alias("start"), (F.col("id") * 100 * H + 29 * H).alias("end"))
    got = ranges.missing(covered, wanted)
    assert got.count() == 30_000 and got.agg(F.sum(F.col("end") - F.col("start"))).first()[0] == 10_000 * (8 * H - 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_excluded_ranges_as_a_table(spark):
    r = random.Random(3)
    scored = spark.createDataFrame([(s, k, k + 4, k * H, (k + 4) * H, 0.9) for s in ("NQ", "ES") for k in range(200)], "symbol string, start_index bigint, end_index bigint, start_time bigint, end_time bigint, similarity double")
    bars = spark.createDataFrame([(s, k) for s in ("NQ", "ES") for k in range(210)], "symbol string, index bigint")
    ruled = [(s, a * H, (a + r.randint(0, 9)) * H) for s in ("NQ", "ES") for a in (r.randint(0, 200) for _ in range(8))]
    one = similarity.eligible(scored, bars, threshold=0.5, exclude_of=ruled)
    two = similarity.eligible(scored, bars, threshold=0.5, excluded=spark.createDataFrame(ruled, "symbol string, start bigint, end bigint"))
    assert 0 < one.count() < 400 and one.exceptAll(two).count() == two.exceptAll(one).count() == 0
