"""Fetching: pages, fallback while a job runs, the cache in between, filters that reach the source."""

import json
import os

import pytest
from pyspark.sql import functions as F

from barsmith.functions.intervals import CHUNK_DAYS, DAY, HISTORY_DAYS, HOUR
from barsmith.operators import ranges
from barsmith.operators.bars import resample
from barsmith.operators.store import RUNS, Store, escaped
from barsmith.plans import service
from barsmith.sources import chain, files

#: Times of the tests count from here; numbers under 1e11 would be read as seconds.
T = 20_000 * DAY
NOW = T + 200 * DAY


def hours(symbol, interval, start, end, log=None, down=(), error="lost"):
    """A vendor: a bar an hour. It writes down which pages it was asked for."""
    if log:
        with open(f"{log}/{os.getpid()}-{start}-{symbol}", "a") as f:
            f.write("x")
    if any(a <= start - T <= b for a, b in down):
        raise {"lost": files.BadData("lost"), "refused": files.Refused("who are you")}[error]
    first = start + -start % HOUR
    return [(t, 10.0 + t // HOUR % 5, 20.0, 5.0, 12.0 + t // HOUR % 3, 1.0) for t in range(first, end, HOUR)]


def nothing(*_, **__):
    return []


def vendor(name, **options):
    page = options.pop("page", DAY)
    native = options.pop("native", frozenset({"1h"}))
    rest = {k: options.pop(k) for k in ("quality", "limited", "needs_rows") if k in options}
    return chain.Vendor(name, "tests.test_fetch.hours", native, options=options, page=page, **rest)


def ask(spark, *rows):
    return spark.createDataFrame([(s, T + a, T + b) for s, a, b in rows], "symbol string, start bigint, end bigint")


def asked_pages(log):
    return len(os.listdir(log))


def test_pages_do_not_overlap_and_cover(spark):
    got = sorted((r["start"] - T, r["end"] - T) for r in chain.pages_of(ask(spark, ("NQ", 5, 5 + 2 * DAY)), "1h", page=DAY).collect())
    assert got == [(5, 4 + DAY), (5 + DAY, 4 + 2 * DAY), (5 + 2 * DAY, 5 + 2 * DAY)]
    for name in CHUNK_DAYS:
        end = 40_000 * DAY
        cut = sorted((r["start"] - T, r["end"] - T) for r in chain.pages_of(ask(spark, ("NQ", end - 2 * HISTORY_DAYS[name] * DAY, end)), name, now=T + end).collect())
        assert cut[0][0] == end - HISTORY_DAYS[name] * DAY and cut[-1][1] == end and all(b - a < CHUNK_DAYS[name] * DAY for a, b in cut)
    gone = chain.pages_of(ask(spark, ("NQ", 0, DAY)), "1h", now=T + 5000 * DAY).collect()
    assert len(gone) == 1 and gone[0]["start"] > gone[0]["end"]


def test_what_one_source_loses_the_next_one_gives(spark, tmp_path):
    """Three of ten pages fail on the executors."""
    down = [(d * DAY, d * DAY) for d in (2, 5, 9)]
    first, second = vendor("first", down=down), vendor("second", quality="live", log=str(tmp_path))
    c = chain.Chain([first, chain.Table("days", spark.createDataFrame([], "symbol string, time bigint, open double, high double, low double, close double, volume double"), "1d"), second])
    got = c.fetch(ask(spark, ("NQ", 0, 10 * DAY - 1)), "1h", NOW)
    rows = {r["time"] - T: r["provider"] for r in got.rows.collect()}
    assert sorted(rows) == list(range(0, 10 * DAY, HOUR))
    assert all(p == ("second" if t // DAY in (2, 5, 9) else "first") for t, p in rows.items())
    out = got.outcomes.collect()
    assert len(out) == 10 and not any(r["failed"] for r in out)
    assert {(r["start"] - T) // DAY: (r["quality"], r["reason"]) for r in out if r["provider"] == "second"} == dict.fromkeys((2, 5, 9), ("live", "first: lost"))
    assert asked_pages(tmp_path) == 3
    assert [(r["source"], r["pages"], r["failed"]) for r in got.health.orderBy("place").collect()] == [("first", 10, 3), ("days", 0, 0), ("second", 3, 0)]
    assert [(h["source"], h["to"]) for h in c.health.history] == [("days", "second"), ("first", "days")]
    assert all(s["usable"] for s in c.health.status(["first", "second"]))


def test_a_source_that_gives_nothing_rests(spark):
    now = [0.0]
    all_down = [(-DAY, 200 * DAY)]
    c = chain.Chain([vendor("dead", down=all_down), vendor("alive")], health=chain.Health(clock=lambda: now[0]))
    wanted = ask(spark, ("NQ", 0, 2 * DAY - 1), ("ES", 0, DAY - 1))
    assert c.fetch(wanted, "1h", NOW).rows.count() == 72
    assert c.health.status(["dead"]) == [{"source": "dead", "usable": False, "probing": False, "seconds": 120.0, "reason": "lost"}]
    again = c.fetch(wanted, "1h", NOW)
    assert {r["reason"] for r in again.outcomes.collect()} == {"dead unavailable: lost"}
    assert again.health.where("source = 'dead'").first()["pages"] == 0
    now[0] = 121.0
    assert c.health.status(["dead"])[0]["probing"] and c.fetch(wanted, "1h", NOW).health.where("source = 'dead'").first()["failed"] == 3
    refused = chain.Chain([vendor("paid", down=all_down, error="refused")], health=chain.Health(clock=lambda: now[0]))
    left = refused.fetch(wanted, "1h", NOW)
    assert left.rows.count() == 0 and {(r["failed"], r["reason"]) for r in left.outcomes.collect()} == {(True, "paid: who are you")}
    assert refused.health.status(["paid"])[0]["seconds"] == 900.0
    for _ in range(30):
        refused.health.fell_back("paid", None, "x")
    assert len(refused.health.history) == 25


def test_the_nearest_finer_interval_is_fetched(spark):
    wanted = ask(spark, ("NQ", 0, 4 * DAY - 1))
    four = chain.Chain([vendor("v")]).fetch(wanted, "4h", NOW)
    one = chain.Chain([vendor("v")]).fetch(wanted, "1h", NOW)
    want = {tuple(r) for r in resample(one.rows.drop("provider"), "4h").collect()}
    assert {tuple(r) for r in four.rows.drop("provider").collect()} == want and {r["provider"] for r in four.rows.collect()} == {"v"}
    none = chain.Chain([vendor("v", native=frozenset({"1d"}))]).fetch(wanted, "1h", NOW)
    assert none.rows.count() == 0 and none.outcomes.first()["reason"] == "v cannot serve 1h"


def test_limits_and_empty_answers(spark):
    c = chain.Chain([vendor("v", limited=True, page=None)])
    got = c.fetch(ask(spark, ("NQ", 0, DAY)), "1h", T + 5000 * DAY)
    assert got.rows.count() == 0 and not got.outcomes.first()["failed"]
    empty = chain.Vendor("v", "tests.test_fetch.nothing", frozenset({"1h"}), needs_rows=True)
    assert chain.Chain([empty]).fetch(ask(spark, ("NQ", 0, DAY)), "1h", NOW).outcomes.first()["reason"] == "v: no bars"
    assert chain.Chain([vendor("v")]).fetch(ask(spark), "1h", NOW).rows.count() == 0


@pytest.mark.parametrize("name", ["1h", "4h"])
def test_any_state_of_the_cache_gives_the_same_bars(spark, tmp_path, name):
    log = tmp_path / "log"
    log.mkdir()
    sources = chain.Chain([vendor("v", log=str(log))])
    whole = resample(sources.fetch(ask(spark, ("NQ", 0, 30 * DAY), ("ES", 0, 30 * DAY)), "1h", NOW).rows.drop("provider"), name)
    wanted = ask(spark, ("NQ", 2 * DAY, 12 * DAY), ("ES", 3 * DAY + 5, 9 * DAY))
    want = {tuple(r) for r in whole.join(wanted, "symbol").where(F.col("time").between(F.col("start"), F.col("end"))).select(whole.columns).collect()}
    for state in ("empty", "half", "full"):
        s = Store(spark, str(tmp_path / state))
        if state == "half":
            service.read_through(s, ask(spark, ("NQ", 5 * DAY, 7 * DAY)), "1h", sources, NOW)
        if state == "full":
            service.read_through(s, ask(spark, ("NQ", 0, 20 * DAY), ("ES", 0, 20 * DAY)), "1h", sources, NOW)
        before = asked_pages(log)
        got = service.read_through(s, wanted, name, sources, NOW)
        assert {tuple(r) for r in got.bars.select(whole.columns).collect()} == want, state
        assert (asked_pages(log) == before) == (state == "full")
        told = {r["symbol"]: r for r in got.state.collect()}
        assert {r["quality"] for r in told.values()} == ({"cached"} if state == "full" else {"delayed"}) and {r["provider"] for r in told.values()} == {"v"}
        assert not any(r["fallback"] or r["failed"] or r["reason"] for r in told.values())
        before = asked_pages(log)
        assert {tuple(r) for r in service.read_through(s, wanted, name, sources, NOW).bars.select(whole.columns).collect()} == want
        assert asked_pages(log) == before  # a second call reads no source
    service.read_through(s, wanted, name, sources, NOW, refresh=True)
    assert asked_pages(log) > before or log.exists()


def test_bars_that_are_still_forming_are_never_covered(spark, tmp_path):
    s, now = Store(spark, str(tmp_path)), T + 10 * DAY + 5
    service.read_through(s, ask(spark, ("NQ", 9 * DAY, 10 * DAY)), "1h", chain.Chain([vendor("v")]), now)
    assert s.coverage().agg(F.max("end")).first()[0] == now - 2 * HOUR
    left = ranges.missing(s.coverage(), ask(spark, ("NQ", 9 * DAY, 10 * DAY)).withColumn("interval", F.lit("1h"))).collect()
    assert [(r["start"], r["end"]) for r in left] == [(now - 2 * HOUR + 1, T + 10 * DAY)]


def test_a_failed_range_degrades(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    sources = chain.Chain([vendor("v", down=[(4 * DAY - HOUR, 5 * DAY - 2 * HOUR)])])
    got = service.read_through(s, ask(spark, ("NQ", 2 * DAY, 6 * DAY)), "1h", sources, NOW)
    state = got.state.first()
    assert (state["quality"], state["failed"], state["trusted"], state["fallback"]) == ("partial", 1, False, True)
    assert state["reason"] == f"1 of {state['ranges']} missing ranges could not be fetched: v: lost"
    times = {r["time"] - T for r in got.bars.collect()}
    assert 2 * DAY in times and not any(4 * DAY <= t < 5 * DAY - HOUR for t in times)
    healed = service.read_through(s, ask(spark, ("NQ", 2 * DAY, 6 * DAY)), "1h", chain.Chain([vendor("w")]), NOW)
    assert {r["time"] - T for r in healed.bars.collect()} == set(range(2 * DAY, 6 * DAY + 1, HOUR))
    assert healed.state.first()["ranges"] == 1
    dead = service.read_through(Store(spark, str(tmp_path / "new")), ask(spark, ("NQ", 0, DAY)), "1h", chain.Chain([vendor("v", down=[(-DAY, 200 * DAY)])]), NOW)
    assert dead.bars.count() == 0 and (dead.state.first()["quality"], dead.state.first()["cached"]) == ("partial", True)


def test_filters_reach_the_source(spark, tmp_path):
    spark.dataSource.register(files.PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def read(k):
        log = tmp_path / str(k)
        log.mkdir()
        options = {"symbol": "NQ, ES,YM", "interval": "1h", "start": T, "end": T + 20 * DAY, "page": DAY, "fetch": "tests.test_fetch.hours", "vendor.log": str(log)}
        return spark.read.format("paged_bars").options(**options).load(), log

    for k, (condition, pages, rows) in enumerate((
        ("true", 60, 60 * 24),
        (f"time between {T + 3 * DAY} and {T + 5 * DAY - 1} and symbol = 'ES'", 2, 48),
        (f"time > {T + 3 * DAY} and time < {T + 4 * DAY}", 3, 3 * 23),
        (f"symbol in ('ES', 'XX') and time >= {T + 19 * DAY + HOUR}", 1, 23),
        (f"time = {T + 7 * DAY + HOUR}", 3, 3),
        (f"time > {T + 50 * DAY}", 0, 0),
        ("symbol = 'XX'", 0, 0),
        (f"time < {T + DAY} or symbol = 'NQ'", 60, 2 * 24 + 20 * 24),  # no conjunction: nothing to push
    )):
        df, log = read(k)
        assert df.where(condition).count() == rows, condition
        assert asked_pages(log) == pages, condition
    df, log = read("limit")
    assert df.rdd.getNumPartitions() == 60
    options = {"symbol": "NQ", "interval": "5m", "start": 0, "end": 100 * DAY, "fetch": "x.y", "now": 100 * DAY}
    reader = files.PagedReader(options)
    assert [(p.start // DAY, p.end // DAY) for p in reader.partitions()] == [(42, 97), (97, 100)]


def test_an_archive_asks_for_its_token(spark, tmp_path):
    spark.createDataFrame([("NQ", t, 1.0, 2.0, 0.5, 1.5, 3.0) for t in range(0, 10 * HOUR, HOUR)], "symbol string, time bigint, open double, high double, low double, close double, volume double").write.partitionBy("symbol").parquet(str(tmp_path / "a"))
    assert len(files.archive("NQ", "1h", HOUR, 4 * HOUR, str(tmp_path / "a"), token="t", needs="t")) == 3
    with pytest.raises(files.Refused):
        files.archive("NQ", "1h", 0, HOUR, str(tmp_path / "a"), needs="t")


def saved(s, spark, run, at=1000):
    header = spark.createDataFrame([(at, "NQ", "1h", "done", "{}", json.dumps({"trades_executed": 1}), run)], RUNS)
    s.save_run(header, spark.createDataFrame([("m", run)], "id string, run string"), spark.createDataFrame([(1.0, run)], "net double, run string"))


def test_an_empty_store_and_a_half_deleted_run(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path))
    assert s.delete_runs(10, dry_run=False).count() == 0 and s.counted_runs().count() == 0 and s.list_runs().count() == 0
    s.clear()
    s.clear("NQ")
    for k, run in enumerate(("a", "b=1/2", "c")):
        saved(s, spark, run, 1000 * k)
    files_of = lambda run: sorted(str(p) for p in tmp_path.rglob("*.parquet") if f"run={escaped(run)}/" in str(p))
    before = files_of("c")
    assert len(files_of("b=1/2")) == 3 and len(before) == 3

    class Crash(Exception):
        pass

    forget = s._forget
    done = []

    def once(path):
        if done:
            raise Crash
        done.append(path)
        return forget(path)

    monkeypatch.setattr(s, "_forget", once)
    with pytest.raises(Crash):  # between the header and its children
        s.delete_runs(500, dry_run=False)
    assert sorted(r["run"] for r in s.list_runs().collect()) == ["b=1/2", "c"] and all(t.count() == 0 for t in s.load_run("a"))
    monkeypatch.undo()
    assert [r["run"] for r in s.delete_runs(1500, dry_run=False).collect()] == ["b=1/2"]
    assert files_of("c") == before and not files_of("a") and not files_of("b=1/2")
    assert [t.count() for t in s.load_run("c")] == [1, 1, 1]


def test_a_write_makes_one_file_a_folder(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = spark.range(0, 90 * 24).repartition(7).select(F.explode(F.array(F.lit("NQ"), F.lit("ES"))).alias("symbol"), F.lit("1h").alias("interval"), (F.col("id") * HOUR).alias("time"), *(F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "volume")), F.lit("p").alias("provider"), F.lit(1).cast("bigint").alias("fetched_at"))
    s.save_candles(rows)
    folders = {}
    for p in (tmp_path / "candles").rglob("*.parquet"):
        folders.setdefault(p.parent, []).append(p)
    assert len(folders) == 2 * 3 and {len(v) for v in folders.values()} == {1}
    s.clear("NQ")
    assert s.candles().select("symbol").distinct().collect()[0][0] == "ES" and s.candles().count() == 90 * 24
