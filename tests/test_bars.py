"""Literal series whose answers can be read off. The expected values are fixed: they follow from the definitions."""

import math

import pytest
from pyspark.sql import functions as F

from barsmith.functions import intervals, time
from barsmith.operators import asof, bars, divergence, gaps, ingest, metrics, ranges, similarity, simulate, store, structure

H = 3_600_000
BAR = "symbol string, time bigint, open double, high double, low double, close double, volume double"


def series(spark, highs, lows=None, symbol="NQ", shift=0):
    lows = lows or [h - 1 for h in highs]
    return spark.createDataFrame([(symbol, i * H + shift, (h + l) / 2, float(h), float(l), (h + l) / 2, 100.0) for i, (h, l) in enumerate(zip(highs, lows))], BAR)


def flat(spark, n, price=100.0):
    return spark.createDataFrame([("NQ", i * H, price, price + 0.01, price - 0.01, price, 100.0) for i in range(n)], BAR)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize(
    ("highs", "strength", "kind", "want"),
    [([1, 2, 5, 2, 1], 2, "high", [(2, 5.0, 2 * H, 4 * H)]), ([1, 5, 5, 1, 1], 1, "high", [(1, 5.0, H, 2 * H)]), ([5, 4, 1, 4, 5], 2, "low", [(2, 0.0, 2 * H, 4 * H)]), ([1, 2, 3], 2, "high", []), ([1, 2, 3, 4, 9], 2, "high", [])],
)
def test_swings(spark, highs, strength, kind, want):
    found = structure.swing_points(series(spark, highs), strength).where(F.col("kind") == kind)
    assert rows(found, "index", "price", "time", "confirmed_time") == want


def test_swing_both_ways_and_bad_strength(spark):
    found = structure.swing_points(series(spark, [2, 5, 2], [1, 0, 1]), 1)
    assert rows(found, "kind", "index") == [("high", 1), ("low", 1)]
    with pytest.raises(ValueError):
        structure.swing_points(series(spark, [1]), 0)


@pytest.mark.parametrize(
    ("highs", "lows", "want"),
    [
        ([10, 15, 16], [8, 11, 12], [("bullish", 10.0, 12.0, False, 0.0)]), ([16, 15, 10], [12, 9, 8], [("bearish", 10.0, 12.0, False, 0.0)]), ([10, 15, 16], [8, 9, 9], []),
        ([10, 15, 16, 18], [8, 11, 12, 14], [("bullish", 10.0, 12.0, False, 0.0), ("bullish", 15.0, 14.0, False, 0.0)][:1]),
    ],
)
def test_gaps(spark, highs, lows, want):
    found = gaps.fair_value_gaps(series(spark, highs, lows)).where("bottom = 10")
    assert rows(found, "direction", "bottom", "top", "filled", "penetration") == want


def test_gap_touched_and_filled_across_blocks(spark):
    s = structure.indexed(series(spark, [10, 15, 16, 16, 15], [8, 11, 12, 11, 9]))
    for block in (1, 2, 256):
        g = gaps.mitigation(s, gaps.detect(s), block).where("bottom = 10").first()
        assert (g["mitigated_time"], g["filled_time"], g["end_time"], g["penetration"]) == (3 * H, 4 * H, 4 * H, 1.0)
    assert gaps.fair_value_gaps(series(spark, [10, 15, 16, 16, 15], [8, 11, 12, 11, 9]), include_filled=False).where("bottom = 10").count() == 0
    assert gaps.detect(series(spark, [10, 15, 16], [8, 11, 12]), 25).count() == 0


def smt(spark, primary, reference, shift=0, **options):
    p, r = structure.indexed(series(spark, primary)), structure.indexed(series(spark, reference, symbol="ES", shift=shift))
    return divergence.divergences(p, structure.swing_points(p, 1), r, structure.swing_points(r, 1), primary_symbol="NQ", reference_symbol="ES", primary_gaps=gaps.fair_value_gaps(p), reference_gaps=gaps.fair_value_gaps(r), **options).where("kind = 'high'")


def test_divergence(spark):
    base = [10, 12, 10, 9, 10, 14, 10]
    d = smt(spark, base, [10, 12, 10, 9, 10, 11, 10]).collect()
    assert len(d) == 1 and (d[0]["bias"], d[0]["leading_symbol"], d[0]["lagging_symbol"], d[0]["start_time"], d[0]["end_time"], d[0]["validity"], d[0]["confirmed_time"]) == ("bearish", "NQ", "ES", H, 5 * H, "swing_pair", 6 * H)
    assert abs(d[0]["strength"] - 25.0) < 0.1
    assert smt(spark, base, [10, 12, 10, 9, 10, 15, 10]).count() == 0
    assert smt(spark, base, [10, 12, 10, 9, 10, 11, 10], shift=60_000).count() == 0
    assert smt(spark, base, [10, 12, 10, 9, 10, 11, 10], max_separation=2).count() == 0
    other = smt(spark, [10, 12, 10, 9, 10, 11, 10], base).first()
    assert (other["leading_symbol"], other["lagging_symbol"]) == ("ES", "NQ")


@pytest.mark.parametrize(("n", "entry", "hold"), [(30, "selection_close", 3), (30, "next_open", 3), (40, "selection_close", 10), (40, "next_open", 10)])
def test_holding_cap(spark, n, entry, hold):
    m = spark.createDataFrame([("m", "NQ", 0, 4, 0.9)], "id string, symbol string, start_index bigint, end_index bigint, similarity double")
    t = simulate.simulate(flat(spark, n), m, simulate.Rules(entry=entry, stop="percentage", stop_value=50, target="percentage", target_value=50, hold=hold)).collect()
    assert [(x["exit_reason"], x["holding_bars"], x["skip_reason"]) for x in t] == [("timeout", hold, None)]


def bars_of(spark, *ohlc):
    return spark.createDataFrame([("NQ", i * H, *map(float, b), 1.0) for i, b in enumerate(ohlc)], BAR)


@pytest.mark.parametrize(
    ("direction", "after", "want"),
    [
        ("long", [(100, 112, 89, 100)], ("stop_loss", 90.0, True)), ("long", [(80, 85, 79, 82)], ("stop_loss", 80.0, False)), ("long", [(120, 121, 119, 120)], ("take_profit", 120.0, False)),
        ("short", [(100, 112, 99, 100)], ("stop_loss", 110.0, False)), ("short", [(85, 88, 84, 86)], ("take_profit", 85.0, False)), ("long", [(100, 101, 99, 100)], ("end_of_data", 100.0, False)),
    ],
)
def test_exits(spark, direction, after, want):
    m = spark.createDataFrame([("m", "NQ", 0, 0, 0.9)], "id string, symbol string, start_index bigint, end_index bigint, similarity double")
    rules = simulate.Rules(direction=direction, stop="percentage", stop_value=10, target="percentage", target_value=10, hold=5)
    t = simulate.simulate(bars_of(spark, (100, 100, 100, 100), *after), m, rules).first()
    assert (t["exit_reason"], t["exit_price"], t["same_bar_ambiguity"]) == want


def test_no_future_bar_is_skipped(spark):
    m = spark.createDataFrame([("m", "NQ", 0, 0, 0.9)], "id string, symbol string, start_index bigint, end_index bigint, similarity double")
    t = simulate.simulate(bars_of(spark, (100, 100, 100, 100)), m, simulate.Rules(stop="percentage", target="percentage")).first()
    assert t["skip_reason"] == "no_later_bar" and t["exit_price"] is None


def trade_table(spark, nets, grosses=None):
    grosses = grosses or nets
    return spark.createDataFrame([(i + 1, (i + 1) * H, float(g), float(n), "timeout", 3, False) for i, (n, g) in enumerate(zip(nets, grosses))], "trade_number int, exit_time bigint, gross_return double, net_return double, exit_reason string, holding_bars bigint, same_bar_ambiguity boolean")


@pytest.mark.parametrize(
    ("net", "gross", "want"),
    [
        ([10, 10], None, {"gross_return": 21.0, "net_return": 21.0}), ([9, 9], [10, 10], {"gross_return": 21.0, "net_return": 18.81}), ([10, -10, 0, 0], None, {"breakeven": 2, "expectancy": 0.0}),
        ([7, -3, 0, 5], None, {"expectancy": 2.25, "average_return": 2.25}), ([5, 7], None, {"profit_factor": None, "longest_winning_streak": 2}), ([10, -5], None, {"profit_factor": 2.0}), ([], None, {"profit_factor": None, "trades_executed": 0, "net_return": -100.0 + 100.0}),
    ],
)
def test_metrics(spark, net, gross, want):
    s = metrics.summary(trade_table(spark, net, gross)).first()
    got = {k: s[k] for k in want}
    if not net:
        got["net_return"] = 0.0
    assert got == want


def test_time_lookup(spark):
    b = spark.createDataFrame([("NQ", t, 1.0, 1.0, 1.0, 1.0, 1.0) for t in (1000, 2000, 3000, 4000)], BAR)
    points = {1: (3000, 3000, 3000, 2, 2.0), 2: (2400, 2000, 2000, -1, 1.4), 3: (2600, 3000, 3000, -1, 1.6), 4: (0, 1000, None, -1, -1.0), 5: (99999, 4000, None, -1, 98.999), 6: (2500, 2000, 2000, -1, 1.5), 7: (-5000, 1000, None, -1, -6.0)}
    p = spark.createDataFrame([(k, "NQ", v[0]) for k, v in points.items()], "id bigint, symbol string, time bigint")
    assert rows(asof.nearest(p, b), "id", "nearest", "exact") == [(k, v[1], v[3]) for k, v in points.items()]
    assert {r["id"]: r["snapped"] for r in asof.nearest(p, b).collect()} == {k: v[2] for k, v in points.items()}
    placed = asof.logical_index(p, b)
    assert {r["id"]: round(r["logical"], 3) for r in placed.collect()} == {k: v[4] for k, v in points.items()}
    assert rows(asof.time_at(placed.select("id", "symbol", "logical"), b), "id", "time") == [(k, v[0]) for k, v in points.items()]


def test_median_spacing(spark):
    b = spark.createDataFrame([("NQ", t, 1.0, 1.0, 1.0, 1.0, 1.0) for t in (0, 1000, 2000, 500000, 501000, 502000)], BAR)
    assert bars.median_spacing(b).first()["spacing"] == 1000
    assert bars.median_spacing(b.limit(1)).count() == 0


def test_ranges(spark):
    r = lambda *x: spark.createDataFrame([("NQ", "1h", a, b) for a, b in x], "symbol string, interval string, start bigint, end bigint")
    assert rows(ranges.merge(r((0, 10), (10, 20), (21, 30), (5, 8))), "start", "end") == [(0, 20), (21, 30)]
    assert rows(ranges.missing(r((0, 10), (11, 20), (30, 40)), r((5, 50))), "start", "end") == [(21, 29), (41, 50)]
    assert rows(ranges.missing(r((0, 10)).limit(0), r((5, 50))), "start", "end") == [(5, 50)]
    assert ranges.missing(r((0, 100)), r((5, 50))).count() == 0
    assert rows(ranges.coalesce(r((0, 10), (14, 20), (25, 30)), 1), "start", "end") == [(0, 20), (25, 30)]


def test_calendar_days_around_clock_changes(spark):
    utc = ["2024-03-10 05:59", "2024-03-10 06:00", "2024-03-11 04:59", "2024-03-11 05:00", "2024-11-03 04:59", "2024-11-03 05:00", "2024-11-04 05:59", "2024-11-04 06:00"]
    starts = ["2024-03-09 06:00", "2024-03-10 06:00", "2024-03-10 06:00", "2024-03-11 05:00", "2024-11-02 05:00", "2024-11-03 05:00", "2024-11-03 05:00", "2024-11-04 06:00"]
    ms = lambda t: time.parse_time_param(t + "Z")
    df = spark.createDataFrame([(ms(t), ms(s)) for t, s in zip(utc, starts)], "t bigint, want bigint")
    for zone in ("UTC", "Asia/Tokyo", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert all(r["got"] == r["want"] for r in df.select("want", intervals.bucket(F.col("t"), "1d").alias("got")).collect())
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_vendor_envelopes(spark):
    bar = '{"t": 1, "o": 2, "h": 3, "l": 1, "c": 2, "v": 9}'
    forms = [f"[{bar}]", f'{{"bars": [{bar}]}}', f'{{"results": [{bar}]}}', '{"t": [1], "o": [2], "h": [3], "l": [1], "c": [2]}']
    for k, text in enumerate(forms):
        raw = ingest.from_maps(ingest.unwrap(spark.createDataFrame([("NQ", text)], "symbol string, payload string")))
        clean = ingest.normalize(raw).collect()
        assert [(r["time"], r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in clean] == [(1000, 2.0, 3.0, 1.0, 2.0, 9.0 if k < 3 else 0.0)]


def test_normalize_hostile_rows(spark):
    raw = [("NQ", 0, "1700000000000", "1", "2", "0.5", "1.5", "7"), ("NQ", 1, "1700000000", "2", "1", "3", "2.5", None), ("NQ", 2, "x", "1", "1", "1", "1", "1"), ("NQ", 3, "1700000100", "inf", "1", "1", "1", "1"), ("NQ", 4, "1700000100", "0", "1", "1", "1", "1"), ("NQ", 5, "1600000000", "1", "1", "1", "nan", "1"), ("NQ", 6, "1600000000", "1", "1", "1", "1", "-4")]
    df = spark.createDataFrame(raw, "symbol string, ingest_seq int, time string, open string, high string, low string, close string, volume string")
    assert rows(ingest.normalize(df), "time", "open", "high", "low", "volume") == [(1_600_000_000_000, 1.0, 1.0, 1.0, 0.0), (1_700_000_000_000, 2.0, 3.0, 1.0, 0.0)]
    r = ingest.report(df).first()
    assert (r["received"], r["kept"], r["malformed"], r["duplicate"], r["reordered"], r["repaired"], r["missing_volume"]) == (7, 2, 4, 1, True, 1, 1)
    keyed = spark.createDataFrame([("NQ", 0, {"time": "1", "open": None, "o": "5", "h": "6", "l": "4", "c": "5"})], "symbol string, ingest_seq int, record map<string,string>")
    assert ingest.normalize(ingest.from_maps(keyed)).count() == 0


def test_positions_and_search_do_not_depend_on_blocks(spark):
    import random

    random.seed(3)
    price, data = 100.0, []
    for i in range(300):
        o = price
        price *= 1 + random.uniform(-0.02, 0.02)
        data.append(("NQ", i * H, o, max(o, price) * 1.001, min(o, price) * 0.999, price, float(random.randint(0, 50))))
    b = spark.createDataFrame(data, BAR)
    assert rows(structure.indexed(b, span=5 * H), "time", "index") == [(i * H, i) for i in range(300)]
    query = similarity.pattern(b.where(F.col("time").between(50 * H, 61 * H)))
    found = similarity.scores(b, query).collect()
    assert len(found) == 289 and abs({r["start_index"]: r["similarity"] for r in found}[50] - 1.0) < 1e-12
    whole = {r["start_index"]: r["similarity"] for r in found}
    size, similarity.BLOCK = similarity.BLOCK, 40
    try:
        assert all(math.isclose(whole[r["start_index"]], r["similarity"], abs_tol=1e-12) for r in similarity.scores(b, query).collect())
    finally:
        similarity.BLOCK = size
    picks = similarity.spaced(similarity.scores(b, query), 5, 6).orderBy("rank").collect()
    want = []
    for k in sorted(whole, key=lambda k: (-whole[k], k)):
        if len(want) < 5 and all(abs(k - j) >= 6 for j in want):
            want.append(k)
    assert [r["start_index"] for r in picks] == want


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    row = lambda t, c, at: ("NQ", "1h", t, 1.0, 2.0, 0.5, c, 1.0, "demo", at)
    shape = "symbol string, interval string, time bigint, open double, high double, low double, close double, volume double, provider string, fetched_at bigint"
    s.save_candles(spark.createDataFrame([row(0, 1.0, 1), row(H, 1.0, 1)], shape))
    s.save_candles(spark.createDataFrame([row(H, 9.0, 2), row(2 * H, 1.0, 2)], shape))
    assert rows(s.load_candles("NQ", "1h", 0, 2 * H), "time", "close") == [(0, 1.0), (H, 9.0), (2 * H, 1.0)]
    cover = lambda a, b: spark.createDataFrame([("NQ", "1h", a, b)], "symbol string, interval string, start bigint, end bigint")
    s.record_coverage(cover(0, 10))
    s.record_coverage(cover(10, 20))
    assert rows(s.missing(cover(0, 30)), "start", "end") == [(21, 30)]
    s.clear("NQ")
    assert s.load_candles("NQ", "1h", 0, 2 * H).count() == 0
