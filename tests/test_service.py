"""The analyses as a user calls them: limits, warnings, notes, runs, vendors' answers, prices as markets have them."""

import json

import pytest
from pyspark.sql import functions as F

from barsmith.functions import intervals
from barsmith.operators import divergence, gaps, ingest, metrics, ranges, similarity, simulate, store
from barsmith.operators.blocks import indexed, previous, running
from barsmith.plans import present, service
from barsmith.sources import catalog, files

H = 3_600_000
BAR = "symbol string, time bigint, open double, high double, low double, close double, volume double"
#: Highs that make two swings and a divergence.
SHAPE = (1, 2, 3, 4, 9, 4, 3, 2, 1, 2, 3, 4, 7, 4, 3, 2, 1, 2, 3, 4)


def wave(spark, symbol, highs=SHAPE, provider="demo"):
    return spark.createDataFrame([(symbol, i * H, h - 0.5, float(h), h - 1.0, h - 0.5, 100.0) for i, h in enumerate(highs)], BAR).withColumn("provider", F.lit(provider))


def test_requests_that_cost_too_much():
    assert intervals.checked_request("60", 0, 10 * H) == "1h"
    for name, start, end in (("1h", 5, 5), ("5m", 0, 20_001 * 300_000), ("6h", 0, 731 * intervals.DAY)):
        with pytest.raises(ValueError):
            intervals.checked_request(name, start, end)
    assert intervals.checked_request("1d", 0, 5000 * intervals.DAY) == "1d" and intervals.align_range(5, 11, 10) == (0, 20)
    with pytest.raises(KeyError):
        intervals.fetch_interval("1h", {"15m"})
    assert intervals.fetch_interval("1d", {"5m"}) == "5m" and intervals.fetch_interval("4h", {"1h", "5m"}) == "1h"


def test_bars_read_one_stored_interval(spark):
    rows = [("NQ", "1h", k * H, 1.0, 2.0, 0.5, 1.5, 12.0) for k in range(8)] + [("NQ", "5m", k * 300_000, 1.0, 9.0, 0.1, 1.5, 1.0) for k in range(96)]
    stored = spark.createDataFrame(rows, "symbol string, interval string, time bigint, open double, high double, low double, close double, volume double")
    got = service.bars(stored, "NQ", "4h", 0, 8 * H).orderBy("time").collect()
    assert [(r["time"], r["high"], r["volume"]) for r in got] == [(0, 2.0, 48.0), (4 * H, 2.0, 48.0)]
    assert service.bars(stored, "NQ", "5m", H, 2 * H).count() == 13


def test_warnings(spark):
    mixed = service.structure_of(wave(spark, "NQ").unionByName(wave(spark, "ES", provider="yahoo")), "NQ", ["ES"])["warnings"].collect()
    assert [r["code"] for r in mixed] == ["mixed_source"] and all(w in mixed[0]["warning"] for w in ("mixed-source", "demo", "yahoo"))
    assert service.structure_of(wave(spark, "NQ").unionByName(wave(spark, "ES")), "NQ", ["ES"])["warnings"].count() == 0
    late = wave(spark, "ES").withColumn("time", F.col("time") + 60_000)
    out = service.structure_of(wave(spark, "NQ").unionByName(late).unionByName(wave(spark, "YM", (1, 2))), "NQ", ["ES", "YM", "ZZ"])
    assert {r["reference_symbol"]: r["code"] for r in out["warnings"].collect()} == {"ES": "no_shared_bars", "YM": "too_few_bars"}
    assert out["divergences"].count() == 0
    with pytest.raises(ValueError):
        service.structure_of(late, "ES", [], strength=0)


def test_prices_close_to_an_edge(spark):
    gap = spark.createDataFrame([("ES", 5, 20000.00001, 20010.0), ("ES", 9, 0.5, 3.0), ("NQ", 1, 7.0, 8.0)], "symbol string, time bigint, bottom double, top double")
    cases = [("ES", 6, 20000.0, True), ("ES", 4, 20000.0, False), ("ES", 6, 20000.0001, False), ("ES", 9, 0.5 + 9e-10, True), ("ES", 9, 0.5 + 2e-9, False), ("ES", 9, 7.0, False), ("NQ", 9, 7.0, True), ("NQ", 9, -7.0, False)]
    points = spark.createDataFrame([(s, t, p, k) for k, (s, t, p, _) in enumerate(cases)], "symbol string, time bigint, price double, k int")
    assert {r["k"]: r["on_edge"] for r in divergence.on_edges(points, gap).collect()} == {k: c[3] for k, c in enumerate(cases)}


def test_containing_by_brute_force(spark):
    import random

    random.seed(5)
    gap = []
    for _ in range(300):
        bottom, at = random.uniform(-50, 20_000), random.randint(0, 400) * H
        gap.append((random.choice("AB"), at, bottom, bottom + random.choice([1e-6, 0.3, 40.0, 5000.0]), random.choice([None, at, at + H, at + 900 * H, at + 30_000 * H])))
    points = [(k, random.choice("AB"), random.randint(0, 2000) * H, random.choice(gap)[2] + random.uniform(0, 30)) for k in range(400)]
    want = {k: min((g[1] for g in gap if g[0] == s and g[1] <= t and (g[4] is None or g[4] >= t) and g[2] <= p <= g[3]), default=None) for k, s, t, p in points}
    g = spark.createDataFrame(gap, "symbol string, time bigint, bottom double, top double, filled_time bigint")
    got = gaps.containing(spark.createDataFrame(points, "k int, symbol string, time bigint, price double"), g)
    assert {r["k"]: r["gap_time"] for r in got.collect()} == want and got.count() == len(points) and any(want.values())


@pytest.mark.parametrize("fan", [2, 3, 256])
def test_first_touch_by_brute_force(spark, fan):
    import random

    random.seed(7)
    price, bars = 100.0, []
    for i in range(150):
        price += random.uniform(-3, 3)
        bars.append(("NQ", i * H, price, price + random.uniform(0, 1), price - random.uniform(0, 1), price, 1.0))
    rows = indexed(spark.createDataFrame(bars, BAR))
    got = gaps.mitigation(rows, gaps.detect(rows), fan).collect()
    assert len(got) > 20
    for g in got:
        later = bars[g["index"] + 1 :]
        bull = g["direction"] == "bullish"
        touch = [b[1] for b in later if (b[4] <= g["top"] if bull else b[3] >= g["bottom"])]
        fill = [b[1] for b in later if (b[4] <= g["bottom"] if bull else b[3] >= g["top"])]
        depth = max([(g["top"] - b[4] if bull else b[3] - g["bottom"]) / g["size"] for b in later], default=0.0)
        assert (g["mitigated_time"], g["filled_time"]) == (touch[0] if touch else None, fill[0] if fill else None)
        assert g["penetration"] == pytest.approx(min(1.0, max(0.0, depth)))


def test_running_values_and_rows_before_across_blocks(spark):
    df = spark.createDataFrame([("a", k, float(k % 5)) for k in range(50)] + [("b", 7, 1.0)], "s string, k int, v double")
    got = {(r["s"], r["k"]): r for r in running(df, ["s"], F.floor(F.col("k") / 7), ["k"], {"total": ("sum", F.col("v")), "top": ("max", F.col("v")), "times": ("product", F.col("v") + 1)}).collect()}
    product = 1.0
    for k in range(50):
        product *= k % 5 + 1
        assert (got["a", k]["total"], got["a", k]["top"]) == (sum(j % 5 for j in range(k + 1)), min(k, 4)) and got["a", k]["times"] == pytest.approx(product)
    before = {r["k"]: r["_prev"] for r in previous(df.where("s = 'a' and k <> 20"), ["s"], F.floor(F.col("k") / 7), ["k"], ["v"]).collect()}
    assert before[0] is None and all(before[k]["v"] == (k - (2 if k == 21 else 1)) % 5 for k in range(1, 50) if k != 20)


def test_vendor_records_of_every_form(spark):
    forms = ['[[1700000000,1,2,0.5,1.5,9]]', '{"bars": [[1700000000,1,2,0.5,1.5,9]]}', '\n[{"t":1700000000,"o":1,"h":2,"l":0.5,"c":1.5,"v":9}]', '{"bars": 5, "data": [[1700000000,1,2,0.5,1.5]]}', '{"t":[1700000000],"o":[1],"h":[2],"l":[0.5],"c":[1.5],"v":[]}', "{}", "nonsense", None, "[[1,2]]", "[3]"]
    raw = ingest.from_payloads(spark.createDataFrame([(f"S{k}", t) for k, t in enumerate(forms)], "symbol string, payload string"))
    got = {r["symbol"]: (r["time"], r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in ingest.normalize(raw).collect()}
    want = (1_700_000_000_000, 1.0, 2.0, 0.5, 1.5)
    assert got == {**{f"S{k}": (*want, 9.0) for k in range(3)}, **{f"S{k}": (*want, 0.0) for k in (3, 4)}}


def test_errors_of_a_vendor():
    kinds = {k: type(files.by_status(k)) for k in (200, 401, 403, 404, 429, 500, 503)}
    assert kinds == {200: type(None), 401: files.Refused, 403: files.Refused, 404: files.BadData, 429: files.TooMany, 500: ConnectionError, 503: ConnectionError}
    assert [files.pause(files.by_status(429, "", s), 1) for s in ("0", "12", "90", "soon", None)] == [0.5, 12.0, 30.0, 1.0, 1.0] and files.pause(ConnectionError(), 9) == 8.0
    reader = files.PagedReader({"symbol": "NQ", "interval": "1h", "start": 0, "end": 10, "page": 4, "oldest": 3})
    assert [(p.start, p.end) for p in reader.partitions()] == [(3, 7), (7, 10)] and list(files.PagedReader({"symbol": "NQ", "interval": "1h", "start": 0, "end": 10, "page": 4, "oldest": 12}).read(files.Page("NQ", 12, 12))) == []


def test_overlap_keeps_an_entry_at_the_exit(spark):
    rows = [(f"m{k}", "NQ", k, e, x, None) for k, (e, x) in enumerate([(0, 5), (3, 9), (5, 6), (6, 20), (7, 8), (20, 21)])] + [("s", "NQ", 9, 1, 2, "no_atr")]
    df = spark.createDataFrame(rows, "id string, symbol string, end_index bigint, entry_time bigint, exit_time bigint, skip_reason string")
    got = {r["id"]: r["skip_reason"] for r in simulate.without_overlap(df).collect()}
    assert got == {"m0": None, "m1": "overlap", "m2": None, "m3": None, "m4": "overlap", "m5": None, "s": "no_atr"}


def test_runs(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    for k in range(3):
        header = spark.createDataFrame([(1000 * k, "NQ", "1h", "done", "{}", json.dumps({"trades_executed": k, "win_rate": 50.0, "net_return": None}), f"r{k}")], store.RUNS)
        s.save_run(header, spark.createDataFrame([(f"m{k}", f"r{k}")], "id string, run string"), spark.createDataFrame([(1.0, f"r{k}")] * k, "net double, run string"))
    assert [(r["run"], r["trades_executed"], r["win_rate"], r["net_return"]) for r in s.list_runs(2).collect()] == [("r2", 2, 50.0, None), ("r1", 1, 50.0, None)]
    assert {r["run"]: (r["matches"], r["trades"]) for r in s.delete_runs(1500).collect()} == {"r0": (1, 0), "r1": (1, 1)} and s.runs().count() == 3
    s.delete_runs(1500, dry_run=False)
    assert [r["run"] for r in s.list_runs().collect()] == ["r2"] and s.load_run("r2")[2].count() == 2 and s.load_run("r1")[1].count() == 0


def test_search_guard_and_json(spark):
    rows = indexed(wave(spark, "NQ"))
    similarity.guarded(rows, 5, 16)
    with pytest.raises(ValueError):
        similarity.guarded(rows, 5, 15)
    request = service.Request("NQ", ("ES", "NQ"), (0, 6 * H), (0, 99 * H), rules=simulate.Rules(hold=3))
    assert json.loads(present.configuration(request))["rules"]["hold"] == 3 and request.searched == ("NQ", "ES")
    for bad in ({"selection": (0, 4 * H)}, {"length": 3}, {"matches": 26}, {"separation": 0}):
        with pytest.raises(ValueError):
            service.Request(**({"primary": "NQ", "symbols": (), "selection": (0, 6 * H), "lookback": (0, 9 * H)} | bad))
    one = present.as_json(metrics.summary(spark.createDataFrame([], "trade_number int, exit_time bigint, gross_return double, net_return double, exit_reason string, holding_bars bigint, same_bar_ambiguity boolean"), 4, 4), "s").first()["s"]
    assert json.loads(one)["total_matches"] == 4 and json.loads(one)["profit_factor"] is None


def test_several_requests_of_one_key(spark):
    r = lambda *x: spark.createDataFrame([("NQ", "1h", a, b) for a, b in x], "symbol string, interval string, start bigint, end bigint")
    assert sorted((g["start"], g["end"]) for g in ranges.missing(r((0, 10), (30, 40)), r((5, 20), (25, 50))).collect()) == [(11, 20), (25, 29), (41, 50)]


def test_nearest_vectors_with_ties_nulls_and_many_queries(spark, monkeypatch):
    monkeypatch.setattr(similarity, "QUERIES", 3)
    monkeypatch.setattr(similarity, "VECTORS", 4)
    rows = [(k, [1.0, 0.0]) for k in range(20)] + [(30 + k, [0.0, 1.0 + k]) for k in range(5)] + [(50, None), (None, [1.0, 1.0]), (51, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = similarity.nearest_vectors(df.where("vec_id < 7 or vec_id >= 30"), df, 4).collect()
    of = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        of.setdefault(r["query_id"], []).append(r["vec_id"])
    assert of[0] == [1, 2, 3, 4] and of[5] == [0, 1, 2, 3] and of[30] == [31, 32, 33, 34] and 50 not in of and len(of) == 13
    assert similarity.nearest_vectors(df.limit(0), df, 4).count() == 0


def test_pattern_of_another_length(spark):
    import numpy as np

    b = wave(spark, "NQ")
    p = similarity.pattern(b, 12)
    closes = np.array([h - 0.5 for h in SHAPE])
    assert (p.length, p.selected) == (12, 20) and np.allclose(p.bars[3], np.interp(np.linspace(0, 1, 12), np.linspace(0, 1, 20), closes)) and len(p.normalized) == 20
    with pytest.raises(ValueError):
        similarity.pattern(b.limit(4))


def test_texts(spark):
    from barsmith.plans import present

    values = [0.0, 0.25, 999.9, 999.96, 1000.0, -1234.5, 12_345.0, 999_950.0, 1e9, 2.34e13, None, float("nan")]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    shown = [r[0] for r in df.orderBy("k").select(present.compact_text(F.col("v"))).collect()]
    assert shown == ["0", "0.3", "999.9", "1K", "1K", "-1.2K", "12.3K", "1M", "1B", "23.4T", "-", "-"]
    assert [r[0] for r in df.orderBy("k").select(present.ratio_text(F.col("v"))).collect()][-3:] == ["23400000000000.00x", "-", "-"]
    at = spark.createDataFrame([(1_704_204_300_000,), (None,)], "t bigint")
    assert [r[0] for r in at.select(present.moment_text(F.col("t"), "1h", "America/Chicago")).collect()] == ["02 Jan 2024, 08:05", "-"]
    assert [r[0] for r in at.select(present.moment_text(F.col("t"), "1d")).collect()] == ["02 Jan 2024", "-"]
    ago = lambda ms: F.lit(10**12 - ms)
    row = at.limit(1).select(*(present.ago_text(ago(x), F.lit(10**12)).alias(str(k)) for k, x in enumerate((5, 61_000, 3_700_000, 200_000_000))), present.duration_text(F.lit(1), "1h"), present.duration_text(F.lit(24), "5m"), present.ago_text(F.lit(None).cast("bigint"), F.lit(1))).first()
    assert list(row) == ["just now", "1m ago", "1h ago", "2d ago", "1 bar (1h)", "24 bars (5m)", "never"]


def test_a_saved_run_and_the_reasons_of_a_read(spark, tmp_path):
    rows = wave(spark, "NQ").unionByName(wave(spark, "ES"))
    times = [r["time"] for r in rows.where("symbol = 'NQ'").orderBy("time").collect()]
    request = service.Request("NQ", ("ES",), (times[2], times[9]), (times[0], times[-1]), threshold=0.0, matches=3, rules=simulate.Rules(hold=2))
    state = spark.createDataFrame([("ES", "first: lost"), ("NQ", None), ("YM", "not searched")], "symbol string, reason string")
    out = service.backtest(rows, request, state)
    notes = [r["note"] for r in out["notes"].orderBy("place", "note").collect()]
    assert "ES: first: lost" in notes and set(service.ASSUMPTIONS) <= set(notes) and not any("YM" in n for n in notes)
    s = store.Store(spark, str(tmp_path))
    service.save(s, request, out, "r", 5)
    header, matches, trades = s.load_run("r")
    assert json.loads(header.first()["configuration"])["primary"] == "NQ" and json.loads(header.first()["summary"])["trades_executed"] == trades.count() == out["trades"].count()
    assert matches.count() == out["matches"].count() and s.list_runs().first()["trades_executed"] == trades.count()


def test_nearest_vectors_of_two_lengths(spark):
    rows = [(k, [float(k), 1.0]) for k in range(6)] + [(k, [1.0, float(k), 2.0]) for k in range(6, 9)] + [(9, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in similarity.nearest_vectors(df.where("vec_id in (0, 6)"), df, 10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert got == {0: {1, 2, 3, 4, 5}, 6: {7, 8}}
