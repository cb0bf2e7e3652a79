"""The queries of the bar operators. Bars are made of ``events``: a symbol for each event type, a price for each value."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.functions import intervals, numbers, time
from barsmith.operators import asof, bars, divergence, gaps, ingest, metrics, ranges, similarity, simulate, store, structure
from barsmith.operators.blocks import indexed
from barsmith.operators.tables import kept
from barsmith.operators.tables import shared_folder
from barsmith.plans import present, service
from barsmith.sources import catalog, chain, demo, files
from barsmith.streaming import cache
from barsmith.streaming import structure as live
from barsmith.streaming.bars import stream_bars

HOUR = intervals.HOUR
PRIMARY = "click"
#: The pattern of the search queries: bars 100 to 111 of the primary symbol; threshold, matches, distance.
PATTERN_AT, PATTERN_LENGTH, THRESHOLD, MATCHES, SEPARATION, FUTURE = 100, 12, 0.3, 10, 6, 26


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def ticks(spark, sf_dir):
    return bars.ticks(events(spark, sf_dir))


def hourly(spark, sf_dir):
    return bars.from_ticks(ticks(spark, sf_dir), "1h")


def placed(spark, sf_dir):
    """Hourly bars with their positions, kept for plans that read them several times."""
    return kept(indexed(hourly(spark, sf_dir)))


def ohlcv(name):
    return lambda spark, sf_dir: bars.from_ticks(ticks(spark, sf_dir), name)


def resampled(name, **options):
    return lambda spark, sf_dir: bars.resample(hourly(spark, sf_dir), name, **options)


def dirty(spark, sf_dir):
    """Raw rows with what vendors get wrong: prices of zero and less, highs and lows swapped, no volume, seconds for milliseconds, minutes repeated."""
    e = bars.ticks(events(spark, sf_dir))
    minute = F.col("time") - F.pmod("time", F.lit(60_000))
    price = F.col("price") - 5
    t = F.when(F.col("seq") % 7 == 0, (minute / 1000).cast("bigint")).otherwise(minute)
    return e.select("symbol", F.col("seq").alias("ingest_seq"), t.cast("string").alias("time"), price.cast("string").alias("open"), (price - 1).cast("string").alias("high"), (price + 1).cast("string").alias("low"), F.when(F.col("seq") % 11 == 0, "n/a").otherwise((price + 0.5).cast("string")).alias("close"), F.when(F.col("seq") % 5 == 0, None).otherwise((F.col("seq") % 13 - 2).cast("string")).alias("volume"))


def session_calendar(spark, sf_dir):
    t = ticks(spark, sf_dir)
    return t.withColumn("session_day", F.date_format(time.session_day(F.col("time")), "yyyy-MM-dd")).withColumn("open", time.in_session(F.col("time"))).groupBy("session_day").agg(F.count_if("open").alias("in_session"), F.count_if(~F.col("open")).alias("outside"))


def aligned(spark, sf_dir):
    return ticks(spark, sf_dir).select("seq", *(f(F.col("time"), intervals.LENGTH[n]).alias(f"{way}_{n}") for way, f in (("down", intervals.align_down), ("up", intervals.align_up)) for n in ("5m", "4h", "1d")))


def swings(strength):
    return lambda spark, sf_dir: structure.swing_points(hourly(spark, sf_dir), strength)


def unit_times(spark, sf_dir):
    raw = F.when(F.col("seq") % 2 == 0, F.floor(F.col("time") / 1000)).otherwise(F.col("time")).cast("double")
    return ticks(spark, sf_dir).select("seq", time.unit_to_ms(raw).alias("time"), time.iso(F.col("time")).alias("iso"))


def tick_rounding(spark, sf_dir):
    return ticks(spark, sf_dir).select("seq", numbers.round_tick(F.col("price"), 0.25, 2).alias("quarter"), numbers.round_tick(F.col("price"), 1.0, 0).alias("whole"), numbers.percent_change(F.lit(50.0), F.col("price")).alias("change"))


def gaps_of(spark, sf_dir, **options):
    return gaps.fair_value_gaps(placed(spark, sf_dir), **options)


def gap_containing(spark, sf_dir):
    rows = placed(spark, sf_dir)
    return gaps.containing(structure.swing_points(rows, 2).select("symbol", "kind", "time", "price"), gaps.fair_value_gaps(rows))


REFERENCES = ["view", "signup", "purchase", "error"]


def smt(include_invalid):
    """The primary symbol against all others."""

    def query(spark, sf_dir):
        rows = placed(spark, sf_dir)
        found = kept(gaps.fair_value_gaps(rows), "gaps")
        swings_ = kept(structure.swing_points(rows, 1), "swings")
        return divergence.between(rows, swings_, found, PRIMARY, REFERENCES, include_invalid=include_invalid)

    return query


def shared(spark, sf_dir):
    return divergence.shared_bars(hourly(spark, sf_dir), PRIMARY, REFERENCES)


def tail_n(spark, sf_dir):
    return bars.tail(structure.swing_points(hourly(spark, sf_dir), 2).select("symbol", "kind", "time", "price"), 20, ["symbol"], [F.desc("time"), F.desc("kind")])


def _search(spark, sf_dir):
    rows = placed(spark, sf_dir)
    selection = rows.where((F.col("symbol") == PRIMARY) & F.col("index").between(PATTERN_AT, PATTERN_AT + PATTERN_LENGTH - 1))
    return rows, selection, similarity.scores(rows, similarity.pattern(selection))


def pattern_scores(spark, sf_dir):
    return _search(spark, sf_dir)[2].select("symbol", "start_index", "end_index", "start_time", "end_time", "entry_price", F.round("similarity", 8).alias("similarity"), F.round("distance", 8).alias("distance"))


def _picked(spark, sf_dir):
    rows, _, scored = _search(spark, sf_dir)
    # rounded scores make the order of near ties the same everywhere
    found = similarity.eligible(scored.withColumn("similarity", F.round("similarity", 8)), rows, threshold=THRESHOLD, future=FUTURE)
    return similarity.spaced(found, MATCHES, SEPARATION)


def pattern_topk_spaced(spark, sf_dir):
    return _picked(spark, sf_dir).select("symbol", "start_index", "similarity", "rank")


def pattern_topk_global(spark, sf_dir):
    return similarity.overall(_picked(spark, sf_dir).drop("rank"), 25).select("symbol", "start_index", "similarity", "rank")


def resample_linear(spark, sf_dir):
    """The closes of every stretch of 30 bars interpolated at 12 points (the last stretch may be shorter)."""

    def points(part: pd.DataFrame) -> pd.DataFrame:
        values = similarity.resample(part.sort_values("index")["close"].to_numpy(), 12)
        return pd.DataFrame({"symbol": part["symbol"].iloc[0], "stretch": part["stretch"].iloc[0], "point": range(12), "value": values})

    rows = indexed(hourly(spark, sf_dir)).select("symbol", F.floor(F.col("index") / 30).alias("stretch"), "index", "close")
    return rows.groupBy("symbol", "stretch").applyInPandas(points, "symbol string, stretch bigint, point int, value double").withColumn("value", F.round("value", 8))


def all_windows(rows: DataFrame) -> DataFrame:
    """Every window of twelve bars as a match."""
    return rows.where("index >= 11").select(F.concat_ws(":", "symbol", "index").alias("id"), "symbol", (F.col("index") - 11).alias("start_index"), F.col("index").alias("end_index"), F.lit(0.5).alias("similarity"))


#: The rules of each trade query; the SQL is made from the same table.
TRADES = {
    "trades_long_pct": simulate.Rules(stop="percentage", stop_value=20.0, target="percentage", target_value=30.0, hold=8, overlap=True),
    "trades_short_pct": simulate.Rules(direction="short", stop="percentage", stop_value=25.0, target="percentage", target_value=30.0, hold=8, fee_percent=0.1, slippage_percent=0.05, overlap=True),
    "trades_long_atr": simulate.Rules(stop="atr_multiple", stop_value=0.5, target="risk_reward", target_value=1.5, hold=12, overlap=True),
    "trades_short_extreme": simulate.Rules(direction="short", stop="pattern_extreme", target="risk_reward", target_value=0.5, hold=12, overlap=True),
    "trades_long_extreme": simulate.Rules(stop="pattern_extreme", target="risk_reward", target_value=0.5, hold=12, overlap=True),
    "trades_long_fixed": simulate.Rules(stop="fixed_price", stop_value=20.0, target="fixed_price", target_value=80.0, hold=10, overlap=True),
    "trades_short_fixed": simulate.Rules(direction="short", stop="fixed_price", stop_value=80.0, target="fixed_price", target_value=20.0, hold=10, overlap=True),
    "trades_next_open": simulate.Rules(entry="next_open", stop="percentage", stop_value=30.0, target="risk_reward", target_value=1.0, hold=8, overlap=True),
    "trades_no_overlap": simulate.Rules(stop="percentage", stop_value=90.0, target="percentage", target_value=90.0, hold=48, overlap=False),
}


def trades(rules):
    def query(spark, sf_dir):
        rows = placed(spark, sf_dir)
        return simulate.simulate(rows, all_windows(rows), rules)

    return query


def _numbered(spark, sf_dir, name="trades_no_overlap"):
    return kept(simulate.numbered(trades(TRADES[name])(spark, sf_dir)))


def outcomes(spark, sf_dir):
    rows = placed(spark, sf_dir)
    found = all_windows(rows)
    return simulate.outcomes(found, simulate.simulate(rows, found, TRADES["trades_no_overlap"])).select("id", "symbol", "end_index", "outcome", "net_return")


def _coverage(spark, sf_dir):
    """Ranges that hours with ticks cover, as fetches of one to three hours."""
    h = hourly(spark, sf_dir).where(F.pmod(F.floor(F.col("time") / HOUR), F.lit(10)) < 6)
    return h.select("symbol", F.lit("1h").alias("interval"), F.col("time").alias("start"), (F.col("time") + HOUR * (1 + F.pmod(F.floor(F.col("time") / HOUR), F.lit(3))) - F.when(F.pmod(F.floor(F.col("time") / HOUR), F.lit(2)) == 0, 1).otherwise(0)).alias("end"))


def coverage_missing(spark, sf_dir):
    covered = _coverage(spark, sf_dir)
    wanted = covered.groupBy("symbol", "interval").agg((F.min("start") - HOUR).alias("start"), (F.max("end") + HOUR).alias("end"))
    return ranges.missing(covered, wanted)


def _candles(spark, sf_dir):
    """Two fetches of the same bars: the second, later, has other closes for every third hour."""
    h = hourly(spark, sf_dir).withColumns({"interval": F.lit("1h"), "provider": F.lit("alpha"), "fetched_at": F.lit(1000).cast("bigint")})
    later = h.where(F.pmod(F.floor(F.col("time") / HOUR), F.lit(3)) == 0).withColumns({"close": F.col("close") + 1, "provider": F.when(F.col("symbol") == "click", "zeta").otherwise("aaron"), "fetched_at": F.lit(2000).cast("bigint")})
    return h, later


def upsert(spark, sf_dir):
    return store.latest(*_candles(spark, sf_dir))


def provider_priority(spark, sf_dir):
    a, b = _candles(spark, sf_dir)
    return catalog.by_priority(a.withColumn("priority", F.lit(2)).unionByName(b.withColumn("priority", F.lit(1))), ["symbol", "interval", "time"]).select("symbol", "time", "close", "provider")


def quality(spark, sf_dir):
    h = hourly(spark, sf_dir)
    return h.select("symbol", "time", catalog.quality(F.col("volume") > 5, F.col("volume") > 2, F.lit("delayed")).alias("quality"))


def _points(spark, sf_dir):
    """Times between bars, some on a bar and some outside the series."""
    h = hourly(spark, sf_dir)
    t = ticks(spark, sf_dir).select(F.col("seq").alias("id"), "symbol", F.when(F.col("seq") % 20 == 3, F.col("time") - F.pmod("time", F.lit(HOUR // 2))).when(F.col("seq") % 50 == 13, F.col("time") - 40 * 24 * HOUR).when(F.col("seq") % 50 == 33, F.col("time") + 40 * 24 * HOUR).otherwise(F.col("time")).alias("time"))
    return t, kept(indexed(h))


def nearest_bar(spark, sf_dir):
    return asof.nearest(*_points(spark, sf_dir))


def logical_index(spark, sf_dir):
    return asof.logical_index(*_points(spark, sf_dir)).withColumn("logical", F.round("logical", 8))


def time_round_trip(spark, sf_dir):
    points, h = _points(spark, sf_dir)
    back = asof.time_at(asof.logical_index(points, h).select("id", "symbol", "logical"), h)
    return back.select("id", "symbol", "time")


def regime_days(spark, sf_dir):
    days = ticks(spark, sf_dir).select(F.datediff(time.session_day(F.col("time")), F.lit("1970-01-01").cast("date")).alias("day_index")).distinct()
    return demo.regime_of(days, demo.regimes(spark))


def request_chunks(spark, sf_dir):
    wanted = hourly(spark, sf_dir).groupBy("symbol").agg(F.lit("1h").alias("interval"), F.min("time").alias("start"), F.max("time").alias("end"))
    return ranges.chunks(wanted, 55 * HOUR)


def knn_embeddings(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return similarity.nearest_vectors(vectors.where("vec_id % 50 = 0"), vectors, 10).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def daily_benchmark(spark, sf_dir):
    """Daily bars of unit prices by return flag, from ``lineitem``."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 0")
    order = F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return rows.groupBy(F.col("l_returnflag").alias("symbol"), day.alias("day")).agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum("l_quantity").alias("volume"))


def vendor_rows(spark, sf_dir):
    """Hourly bars as vendors send them, a payload a day in one of four forms, read again and cleaned."""
    h = hourly(spark, sf_dir).withColumn("day", F.floor(F.col("time") / intervals.DAY))
    bar = F.struct("time", "open", "high", "low", "close", "volume")
    days = h.groupBy("symbol", "day").agg(F.array_sort(F.collect_list(bar)).alias("b"))
    items = lambda n: F.transform("b", lambda x: F.array(*(x[c].cast("string") for c in ("time", "open", "high", "low", "close", "volume")[:n])))
    columns = F.struct(*(F.transform("b", lambda x: x[c]).alias(k) for c, k in (("time", "t"), ("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"), ("volume", "v"))))  # noqa: B023
    form = F.pmod("day", F.lit(4))
    payload = F.when(form == 0, F.to_json(items(6))).when(form == 1, F.to_json(F.struct(F.col("b").alias("bars")))).when(form == 2, F.to_json(F.struct(items(5).alias("data")))).otherwise(F.to_json(columns))
    return ingest.normalize(ingest.from_payloads(days.select("symbol", payload.alias("payload"))).withColumn("ingest_seq", F.col("ingest_seq") + F.lit(0)))


def edge_at_price(spark, sf_dir):
    """Swing prices, a thousandfold and some of them moved a little, against edges of gaps at such prices."""
    rows = placed(spark, sf_dir)
    gap = gaps.detect(rows).select("symbol", "time", (F.col("bottom") * 1000).alias("bottom"), (F.col("top") * 1000).alias("top"))
    points = structure.swing_points(rows, 1).select("symbol", "kind", "index", "time", (F.col("price") * 1000 * (1 + F.pmod("index", F.lit(4)) * 4e-10)).alias("price"))
    return divergence.on_edges(points, gap).select("symbol", "kind", "index", "time", "on_edge")


def _stored(spark, sf_dir):
    """A cache with five-minute and hourly rows of all symbols."""
    t = ticks(spark, sf_dir)
    five, hour = (bars.from_ticks(t, n).withColumns({"interval": F.lit(n), "provider": F.lit("alpha"), "fetched_at": F.lit(1).cast("bigint")}) for n in ("5m", "1h"))
    return five.unionByName(hour)


#: The range of the cache queries, in the first days of 2024.
FROM, TO = 1_704_205_800_000, 1_705_199_400_000


def _fresh(spark):
    return store.Store(spark, f"{shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}")


def cached_range(spark, sf_dir):
    """A range of a cache that was written twice, the second time with other closes for some hours."""
    first, second = _candles(spark, sf_dir)
    s = _fresh(spark)
    s.save_candles(first)
    s.save_candles(second)
    return s.load_candles(PRIMARY, "1h", FROM, TO)


def cache_cleared(spark, sf_dir):
    """What a cache and its coverage hold after one symbol was forgotten."""
    s = _fresh(spark)
    s.save_candles(_candles(spark, sf_dir)[0])
    s.record_coverage(_coverage(spark, sf_dir))
    s.clear(PRIMARY)
    return s.candles().groupBy("symbol").agg(F.count(F.lit(1)).alias("bars")).join(s.coverage().groupBy("symbol").agg(F.sum(F.col("end") - F.col("start")).alias("covered")), "symbol", "full")


def missing_of_many(spark, sf_dir):
    """Two requests of each symbol against one coverage."""
    covered = _coverage(spark, sf_dir)
    ends = covered.groupBy("symbol", "interval").agg(F.min("start").alias("a"), F.max("end").alias("z"))
    half = F.floor((F.col("a") + F.col("z")) / 2)
    wanted = ends.select("symbol", "interval", F.explode(F.array(F.struct(F.col("a").alias("start"), half.alias("end")), F.struct((half + HOUR).alias("start"), F.col("z").alias("end")))).alias("r")).select("symbol", "interval", "r.start", "r.end")
    return ranges.missing(covered, wanted)


RUN_REFERENCES = ["view", "signup"]


def structure_part(part, **options):
    return lambda spark, sf_dir: service.structure_of(hourly(spark, sf_dir), PRIMARY, RUN_REFERENCES, **options)[part]


def structure_warnings(spark, sf_dir):
    """One reference from another source, one whose bars are a minute late."""
    h = hourly(spark, sf_dir).withColumn("provider", F.when(F.col("symbol") == "view", "demo").otherwise("vendor"))
    h = h.withColumn("time", F.when(F.col("symbol") == "signup", F.col("time") + 60_000).otherwise(F.col("time")))
    return service.structure_of(h, PRIMARY, RUN_REFERENCES)["warnings"]


RUN_RULES = simulate.Rules(stop="percentage", stop_value=20.0, target="percentage", target_value=30.0, hold=8)


def _run(spark, sf_dir, provider=None):
    h = kept(hourly(spark, sf_dir), "hourly")
    edge = indexed(h.where(F.col("symbol") == PRIMARY)).where(F.col("index").isin(PATTERN_AT, PATTERN_AT + PATTERN_LENGTH - 1)).agg(F.min("time"), F.max("time")).first()
    ends = h.agg(F.min("time"), F.max("time")).first()
    request = service.Request(PRIMARY, tuple(RUN_REFERENCES), (edge[0], edge[1]), (ends[0], ends[1]), threshold=THRESHOLD, matches=MATCHES, separation=SEPARATION, rules=RUN_RULES)
    return service.backtest(h if provider is None else h.withColumn("provider", provider), request), request


def run_matches(spark, sf_dir):
    out = _run(spark, sf_dir)[0]["matches"]
    return out.select("id", "symbol", "start_index", "end_index", F.round("similarity", 8).alias("similarity"), "rank", "outcome", "net_return", F.round(F.aggregate("normalized", F.lit(0.0), lambda a, x: a + x), 4).alias("path"))


def run_trades(spark, sf_dir):
    return _run(spark, sf_dir)[0]["trades"].select("trade_number", "id", "symbol", "entry_time", "exit_time", "entry_price", "exit_price", "net_return", "exit_reason")


def run_saved(spark, sf_dir):
    """The trades of a run that was persisted, loaded again."""
    out, request = _run(spark, sf_dir)
    s = _fresh(spark)
    service.save(s, request, out, "one", 1000)
    return s.load_run("one")[2].select("trade_number", "id", "symbol", "entry_time", "exit_time", "entry_price", "exit_price", "net_return", "exit_reason")


def run_summary(spark, sf_dir):
    return _run(spark, sf_dir)[0]["summary"]


def run_notes(spark, sf_dir):
    return _run(spark, sf_dir, F.when(F.col("symbol") == "view", "demo").otherwise("vendor"))[0]["notes"]


def _runs(spark, sf_dir):
    """A store with three runs."""
    rows = placed(spark, sf_dir)
    s, found = _fresh(spark), all_windows(rows)
    for k, name in enumerate(("trades_long_pct", "trades_short_pct", "trades_long_fixed")):
        done = kept(simulate.numbered(simulate.simulate(rows, found, TRADES[name])), "trades")
        run = F.lit(name).alias("run")
        summary = present.as_json(done.agg(F.count(F.lit(1)).alias("trades_executed"), F.round(F.count_if(F.col("net_return") > 0) * 100.0 / F.count(F.lit(1)), 4).alias("win_rate"), F.round(F.avg("net_return"), 4).alias("net_return")), "summary")
        header = summary.select(F.lit(1000 * (k + 1)).cast("bigint").alias("created_at"), F.lit(PRIMARY).alias("primary_symbol"), F.lit("1h").alias("interval"), F.lit("done").alias("status"), F.lit("{}").alias("configuration"), "summary", run)
        s.save_run(header, found.withColumn("run", run), done.withColumn("run", run))
    return s


def runs_listed(spark, sf_dir):
    """Three runs persisted, one forgotten, the rest listed with figures from their JSON."""
    s = _runs(spark, sf_dir)
    s.delete_runs(1500, dry_run=False)
    return s.list_runs()


def runs_counted(spark, sf_dir):
    """Three runs persisted, those forgotten that would be by a dry run too, with the number of their matches and trades."""
    s = _runs(spark, sf_dir)
    old = s.delete_runs(2500)
    s.delete_runs(1500, dry_run=False)
    return old.withColumn("gone", F.lit(True)).unionByName(s.counted_runs().withColumn("gone", F.lit(False)))


def interval_table(spark, sf_dir):
    """What is known of each interval, beside how many bars of it the ticks make and how many a request for their range may hold."""
    t = ticks(spark, sf_dir)
    made = None
    for n in intervals.LENGTH:
        one = t.select("symbol", intervals.bucket(F.col("time"), n).alias("bar"), "time").groupBy("symbol").agg(F.count_distinct("bar").alias("bars"), F.floor((F.max("time") - F.min("time")) / intervals.LENGTH[n]).alias("estimate")).agg(F.sum("bars").alias("bars"), F.sum("estimate").alias("estimate")).withColumn("interval", F.lit(n))
        made = one if made is None else made.unionByName(one)
    rows = [(n, intervals.LENGTH[n], intervals.storage_interval(n), intervals.is_intraday(n), intervals.fetch_interval(n, {"5m", "1h"}), intervals.fetch_interval(n, {"5m"})) for n in intervals.LENGTH]
    return spark.createDataFrame(rows, "interval string, length bigint, stored_as string, intraday boolean, from_two string, from_five string").join(made, "interval")


#: The instruments that the symbols of the ticks stand for in the queries, as users may write them.
WRITTEN = {"click": " nq ", "view": "Es", "signup": "YM", "purchase": "btc"}


def instruments(spark, sf_dir):
    """Symbols written in any way, what is known of their instruments, and their last price on the grid of its ticks."""
    label = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in WRITTEN.items() for x in kv)), F.col("symbol")), F.lit(""))
    last = hourly(spark, sf_dir).withColumn("label", label).groupBy("symbol", "label").agg(F.max_by("close", "time").alias("last"))
    return catalog.with_instruments(last, "label").select("symbol", "label", "known", "name", "tick", "digits", "zone", (F.rint(F.col("last") / F.col("tick")) * F.col("tick")).alias("last"))


def instruments_upsert(spark, sf_dir):
    """An instrument for each symbol of the ticks, one of which takes the place of a known one."""
    e = ticks(spark, sf_dir).groupBy("symbol").agg(F.max("price").alias("most"))
    new = e.select(F.when(F.col("symbol") == PRIMARY, "YM").otherwise(F.upper("symbol")).alias("symbol"), F.concat(F.lit("ticks of "), "symbol").alias("name"), F.when(F.col("most") > 99, 0.01).otherwise(0.25).alias("tick"), F.lit(2).alias("digits"), F.lit("UTC").alias("zone"))
    return store.upsert(catalog.instruments(spark), new, ["symbol"])


def parse_times(spark, sf_dir):
    """Times written in six ways."""
    t = ticks(spark, sf_dir)
    whole = F.col("time") - F.pmod("time", F.lit(1000))
    iso = F.date_format(time.to_ntz(whole), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.get(F.array(whole.cast("string"), (whole / 1000).cast("bigint").cast("string"), F.concat(iso, F.lit("Z")), F.concat(iso, F.lit("+02:00")), iso, F.lit("soon")), F.pmod("seq", F.lit(6)).cast("int"))
    return t.select("seq", time.parse_time(text).alias("time"))


def trust(spark, sf_dir):
    """Quality of a serve, whether to trust it, and whether it is a fallback."""
    h = hourly(spark, sf_dir)
    state = catalog.quality(F.col("volume") > 5, F.col("volume") > 2, F.when(F.col("symbol") == "view", "demo").otherwise("delayed"))
    return h.select("symbol", "time", state.alias("quality"), present.trusted(state).alias("trusted"), present.fallback(F.col("volume") > 5, F.col("symbol"), F.lit(PRIMARY)).alias("fallback"))


def more_texts(spark, sf_dir):
    """Moments, compact numbers, ratios and durations of hourly bars as they are shown."""
    h = hourly(spark, sf_dir)
    value, ratio = F.col("close") * F.pow(F.lit(10.0), F.pmod(F.floor(F.col("time") / HOUR), F.lit(13))), F.when(F.col("volume") > 1, F.round(F.col("close") / F.col("open"), 1))
    return h.select("symbol", "time", present.moment_text(F.col("time"), "1h", time.EXCHANGE_ZONE).alias("moment"), present.moment_text(F.col("time"), "1d").alias("day"), present.compact_text(F.round(value, 2)).alias("compact"), present.number_text(F.round(value, 2), 1).alias("number"), present.ratio_text(ratio).alias("ratio"), present.duration_text(F.col("volume").cast("bigint"), "1h").alias("duration"), present.ago_text(F.when(F.col("volume") < 9, F.col("time")), F.lit(TO)).alias("ago"))


def texts(spark, sf_dir):
    return hourly(spark, sf_dir).select("symbol", "time", present.price_text(F.col("close") * 1000, 2).alias("price"), present.percent_text(F.round(F.when(F.col("volume") > 1, numbers.percent_change(F.col("open"), F.col("close"))), 1)).alias("change"))


def _folder(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def column_list_json(spark, sf_dir):
    """Hourly bars written as a JSON file of columns and rows for each symbol, and read again."""
    path = _folder(spark, "json")
    files.write_column_list(hourly(spark, sf_dir), path)
    return store.union_all([files.read_column_list(spark, f"{path}/symbol={s}", s) for s in SYMBOLS])


def _archive(spark, sf_dir):
    """Five-minute bars of the ticks as a vendor's folder."""
    path = _folder(spark, "archive")
    bars.from_ticks(ticks(spark, sf_dir), "5m").repartition("symbol").sortWithinPartitions("symbol", "time").write.partitionBy("symbol").parquet(path)
    return path


PAGE = 3 * intervals.DAY
#: Digits of the pages that the first vendor of the queries has lost: three in ten.
LOST = "147"
SYMBOLS = ("click", "error", "purchase", "signup", "view")


def paged_scan(spark, sf_dir):
    """A vendor read in pages, one task each, and cleaned; a filter on time and symbol leaves out pages."""
    spark.dataSource.register(files.PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"symbol": ",".join(SYMBOLS), "interval": "5m", "start": FROM - 30 * intervals.DAY, "end": TO + 30 * intervals.DAY, "page": 5 * intervals.DAY, "fetch": "barsmith.sources.files.archive", "vendor.folder": _archive(spark, sf_dir), "vendor.token": "t", "vendor.needs": "t"}
    raw = spark.read.format("paged_bars").options(**options).load()
    return ingest.normalize(raw.where(F.col("time").between(FROM, TO) & F.col("symbol").isin(*SYMBOLS[:4])))


def _chain(spark, sf_dir, second=True):
    """A vendor of five-minute bars that lost pages, one that has only days, and a table of hourly bars."""
    first = chain.Vendor("first", "barsmith.sources.demo.flaky", frozenset({"5m"}), options={"folder": _archive(spark, sf_dir), "page": PAGE, "lost": LOST}, page=PAGE)
    daily = chain.Table("daily", bars.from_ticks(ticks(spark, sf_dir), "1d"), "1d")
    third = chain.Table("third", hourly(spark, sf_dir), "1h", quality="live")
    return chain.Chain([first, daily, third] if second else [first])


def _whole(spark, sf_dir):
    """A request for all there is of each symbol, and the time of the last tick (one number) as now."""
    t = ticks(spark, sf_dir)
    now = t.agg(F.max("time")).first()[0]
    return t.groupBy("symbol").agg((F.min("time") - F.pmod(F.min("time"), F.lit(HOUR))).alias("start"), F.max("time").alias("end")), now


def chain_fallback(spark, sf_dir):
    """Hourly bars of all symbols; what the first source fails to give while the job runs is the third one's."""
    wanted, now = _whole(spark, sf_dir)
    return _chain(spark, sf_dir).fetch(wanted, "1h", now).rows.select("symbol", "time", "close", "volume", "provider")


def chain_outcomes(spark, sf_dir):
    """How each page of that fetch went."""
    wanted, now = _whole(spark, sf_dir)
    return _chain(spark, sf_dir).fetch(wanted, "1h", now).outcomes


def _half_full(spark, sf_dir):
    """A cache that holds hourly bars of the days whose number is 2 to 4 modulo 5."""
    s = _fresh(spark)
    day = F.floor(F.col("time") / intervals.DAY)
    h = hourly(spark, sf_dir).where(F.pmod(day, F.lit(5)).between(2, 4))
    s.save_candles(h.withColumns({"interval": F.lit("1h"), "provider": F.lit("old"), "fetched_at": F.lit(1).cast("bigint")}))
    s.record_coverage(h.select("symbol", F.lit("1h").alias("interval"), (day * intervals.DAY).alias("start"), ((day + 1) * intervals.DAY - 1).alias("end")).distinct())
    return s


def bars_read_through(spark, sf_dir):
    """Bars of four hours, of which a half-full cache has a part; the rest is fetched."""
    wanted, now = _whole(spark, sf_dir)
    return service.read_through(_half_full(spark, sf_dir), wanted, "4h", _chain(spark, sf_dir), now).bars


def read_through_state(spark, sf_dir):
    """Where those bars came from if only the vendor that lost pages is there, and the cache was empty."""
    wanted, now = _whole(spark, sf_dir)
    return service.read_through(_fresh(spark), wanted, "4h", _chain(spark, sf_dir, False), now).state


def read_through_coverage(spark, sf_dir):
    """What a cache covers after two such requests: all but the pages that are lost and the last two hours."""
    wanted, now = _whole(spark, sf_dir)
    s, sources = _fresh(spark), _chain(spark, sf_dir, False)
    for _ in range(2):
        service.read_through(s, wanted, "4h", sources, now)
    return s.coverage()


def bars_recent(spark, sf_dir):
    """The last ten days of hourly bars, to the bar that is running, through an empty cache."""
    _, now = _whole(spark, sf_dir)
    start, end = intervals.build_range(now, "1h", 10)
    wanted = ticks(spark, sf_dir).select("symbol", F.lit(start).alias("start"), F.lit(end).alias("end")).distinct()
    return service.read_through(_fresh(spark), wanted, "1h", _chain(spark, sf_dir), now).bars


def demo_checked(spark, sf_dir):
    """Synthetic bars at the five minutes that have ticks: how many there are, and whether each is sound and in the session."""
    times = ticks(spark, sf_dir).select(intervals.align_down(F.col("time"), intervals.LENGTH["5m"]).alias("time")).distinct()
    made = demo.demo_at(times, {"ES": (5000.0, 1.0, 0.25, 2), "NQ": (17000.0, 1.2, 0.25, 2)})
    sound = F.col("low").between(0.25, F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close")) & (F.col("volume") > 0) & time.in_session(F.col("time"))
    return made.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.count_distinct("time").alias("times"), F.min(sound).alias("sound"))


def stream_closed_bars(spark, sf_dir):
    """Bars that a stream of the ticks has closed: those that end two hours before the last tick."""
    source, sink, state = (_folder(spark, n) for n in ("ticks", "closed", "state"))
    rows = ticks(spark, sf_dir).withColumn("ts", F.timestamp_millis("time")).select("symbol", "ts", "seq", "price")
    rows.write.parquet(source)
    stream = stream_bars(spark.readStream.schema(rows.schema).parquet(source))
    stream.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink)


def _deliveries(spark, sf_dir, n=3):
    """Ticks in ``n`` deliveries in order of time, but every tenth tick comes one delivery late."""
    rows = ticks(spark, sf_dir).withColumn("ts", F.timestamp_millis("time")).select("symbol", "ts", "seq", "price")
    low, high = rows.agg(F.min(F.unix_millis("ts")), F.max(F.unix_millis("ts"))).first()  # two numbers
    at = F.floor((F.unix_millis("ts") - low) * n / (high - low + 1)) + F.when(F.col("seq") % 10 == 3, 1).otherwise(0)
    dealt = rows.withColumn("at", F.least(at, F.lit(n - 1)))
    return [dealt.where(F.col("at") == k).drop("at") for k in range(n)]


def stream_cached(spark, sf_dir):
    """A cache that a stream of late ticks kept, stopped after two deliveries and started again for the third."""
    source, state, s = _folder(spark, "ticks"), _folder(spark, "state"), _fresh(spark)
    parts = _deliveries(spark, sf_dir)
    for some in (parts[:2], parts[2:]):
        for part in some:
            part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 2).parquet(source)
        cache.into_cache(s, stream, "1h", state, late="3650 days", availableNow=True).awaitTermination()
    return s.candles().where(F.col("provider") == "stream").select("symbol", "time", "open", "high", "low", "close", "volume")


def _live(spark, sf_dir, make, schema):
    """Ticks come in three deliveries; after each, one stream closes bars and another one reads them. (rows of the second, bars)."""
    source, sink, out, first, second = (_folder(spark, n) for n in ("ticks", "closed", "live", "state", "state"))
    rows = ticks(spark, sf_dir).withColumn("ts", F.timestamp_millis("time")).select("symbol", "ts", "seq", "price")
    low, high = rows.agg(F.min(F.unix_millis("ts")), F.max(F.unix_millis("ts"))).first()  # two numbers
    into = lambda stream, path, state: stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    for k in range(3):
        rows.where(F.floor((F.unix_millis("ts") - low) * 3 / (high - low + 1)) == k).coalesce(1).write.mode("append").parquet(source)
        into(stream_bars(spark.readStream.schema(rows.schema).parquet(source)), sink, first)
        into(make(spark.readStream.schema("symbol string, time bigint, open double, high double, low double, close double, volume double").parquet(sink)), out, second)
    return spark.read.schema(schema).parquet(out), spark.read.parquet(sink)


def stream_swings(spark, sf_dir):
    """Swing points of a stream of closed bars, which is stopped and goes on twice."""
    return _live(spark, sf_dir, lambda b: live.swings(b, 2), live.SWINGS)[0]


def stream_gaps(spark, sf_dir):
    """What became of the gaps of such a stream."""
    return live.latest(*_live(spark, sf_dir, live.gaps, live.GAPS))


QUERIES = {
    **{f"ohlcv_{n}": ohlcv(n) for n in intervals.LENGTH},
    "resample_4h": resampled("4h"),
    "resample_6h": resampled("6h"),
    "resample_1d": resampled("1d"),
    "drop_incomplete_last": resampled("4h", source="1h", drop_incomplete=True),
    "daily_benchmark": daily_benchmark,
    "normalize_candles": lambda s, d: ingest.normalize(dirty(s, d)),
    "normalize_report": lambda s, d: ingest.report(dirty(s, d)),
    "unit_infer_timestamp": unit_times,
    "session_calendar": session_calendar,
    "align_grid": aligned,
    "tick_rounding": tick_rounding,
    "selection_summary": lambda s, d: bars.selection_summary(hourly(s, d)),
    "median_spacing": lambda s, d: bars.median_spacing(hourly(s, d)),
    **{f"swing_points_s{k}": swings(k) for k in (1, 2, 5)},
    "true_range": lambda s, d: structure.true_range(hourly(s, d)).select("symbol", "index", "time", "true_range"),
    "atr14": lambda s, d: structure.true_range(hourly(s, d), 14).select("symbol", "index", F.round("atr", 8).alias("atr")),
    "fvg_detect": lambda s, d: gaps.detect(hourly(s, d)),
    "fvg_mitigation": gaps_of,
    "fvg_open_only": lambda s, d: gaps_of(s, d, include_filled=False),
    "fvg_min_size": lambda s, d: gaps_of(s, d, min_size_percent=50.0),
    "gap_containing": gap_containing,
    "smt_all": smt(True),
    "smt_valid": smt(False),
    "shared_bars": shared,
    "tail_n": tail_n,
    "pattern_scores": pattern_scores,
    "pattern_topk_spaced": pattern_topk_spaced,
    "pattern_topk_global": pattern_topk_global,
    "resample_linear": resample_linear,
    **{name: trades(rules) for name, rules in TRADES.items()},
    "match_outcomes": outcomes,
    # equity has many digits here, more than a double
    "equity_curve": lambda s, d: metrics.equity_curve(_numbered(s, d)).select("trade_number", "time", F.round(F.log10(F.col("equity") + 1), 6).alias("log10_equity"), F.round("drawdown", 4).alias("drawdown")),
    "max_drawdown": lambda s, d: metrics.maximum_drawdown(metrics.equity_curve(_numbered(s, d))),
    "streaks": lambda s, d: metrics.streaks(_numbered(s, d)),
    "backtest_summary": lambda s, d: metrics.summary(_numbered(s, d)),
    "coverage_merge": lambda s, d: ranges.merge(_coverage(s, d)),
    "coverage_missing": coverage_missing,
    "ranges_coalesced": lambda s, d: ranges.coalesce(_coverage(s, d), HOUR // 2),
    "request_chunks": request_chunks,
    "upsert_latest": upsert,
    "latest_provider": lambda s, d: store.latest_provider(upsert(s, d)),
    "cache_stats": lambda s, d: store.statistics(upsert(s, d)),
    "provider_priority": provider_priority,
    "quality_flags": quality,
    "nearest_bar": nearest_bar,
    "logical_index": logical_index,
    "time_round_trip": time_round_trip,
    "regime_days": regime_days,
    "knn_embeddings": knn_embeddings,
    "vendor_rows": vendor_rows,
    "edge_at_price": edge_at_price,
    "bars_range": lambda s, d: service.bars(_stored(s, d), PRIMARY, "4h", FROM, TO),
    "bars_range_5m": lambda s, d: service.bars(_stored(s, d), PRIMARY, "5m", FROM, TO),
    "cached_range": cached_range,
    "cache_cleared": cache_cleared,
    "missing_of_many": missing_of_many,
    "structure_swings": structure_part("swings", kind="high"),
    "structure_gaps": structure_part("gaps"),
    "structure_divergences": structure_part("divergences"),
    "structure_open_gaps": structure_part("gaps", include_filled=False),
    "structure_warnings": structure_warnings,
    "run_matches": run_matches,
    "run_trades": run_trades,
    "run_summary": run_summary,
    "run_saved": run_saved,
    "run_notes": run_notes,
    "runs_listed": runs_listed,
    "runs_counted": runs_counted,
    "interval_table": interval_table,
    "instruments": instruments,
    "instruments_upsert": instruments_upsert,
    "parse_times": parse_times,
    "trust_flags": trust,
    "chart_series": lambda s, d: present.chart(hourly(s, d)),
    "display_texts": texts,
    "display_more": more_texts,
    "column_list_json": column_list_json,
    "paged_scan": paged_scan,
    "chain_fallback": chain_fallback,
    "chain_outcomes": chain_outcomes,
    "bars_read_through": bars_read_through,
    "bars_recent": bars_recent,
    "read_through_state": read_through_state,
    "read_through_coverage": read_through_coverage,
    "demo_checked": demo_checked,
    "stream_closed_bars": stream_closed_bars,
    "stream_cached": stream_cached,
    "stream_swings": stream_swings,
    "stream_gaps": stream_gaps,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks to hourly bars to confirmed swing points."""
    return structure.swing_points(hourly(spark, sf_dir), 2)
