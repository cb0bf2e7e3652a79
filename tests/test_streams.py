"""Streams against their batch twins: bars cut into batches at random, streams stopped and started, batches played twice."""

import numpy as np
from pyspark.sql import functions as F

from barsmith.functions.intervals import HOUR
from barsmith.operators import gaps as batch_gaps
from barsmith.operators import structure as batch
from barsmith.operators.bars import from_ticks
from barsmith.operators.store import Store
from barsmith.streaming import cache, structure

BARS = "symbol string, time bigint, open double, high double, low double, close double, volume double"
T = 20_000 * 86_400_000


def walk(seed, n=400, symbols=("NQ", "ES", "YM")):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        price = 100.0
        for k in range(n):
            o, c = price, price + float(rng.integers(-6, 7))
            rows.append((s, T + k * HOUR, o, max(o, c) + float(rng.integers(0, 3)), min(o, c) - float(rng.integers(0, 3)), c, 1.0))
            price = c + float(rng.integers(-3, 4))
    return rows


def streamed(spark, tmp_path, rows, make, schema, cuts, restart=True):
    """What the stream writes for bars delivered up to each of ``cuts``, in any order within a delivery."""
    source, out, state = (str(tmp_path / n) for n in ("source", "out", "state"))
    low = -1
    for cut in cuts:
        part = [r for r in rows if low < (r[1] - T) // HOUR <= cut]
        np.random.default_rng(cut).shuffle(part)
        low = cut
        spark.createDataFrame([tuple(r) for r in part], BARS).coalesce(1).write.mode("append").parquet(source)
        if restart or cut == cuts[-1]:
            stream = make(spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(source))
            stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(out)


def same(a, b):
    columns = sorted(a.columns)
    plain = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in columns)]) for r in df.collect())
    return plain(a) == plain(b)


def test_swings(spark, tmp_path):
    rows = walk(1)
    bars = spark.createDataFrame(rows, BARS)
    for strength, cuts in ((1, [0, 1, 2, 50, 399]), (3, [2, 90, 399])):
        got = streamed(spark, tmp_path / str(strength), rows, lambda b: structure.swings(b, strength), structure.SWINGS, cuts)  # noqa: B023
        want = batch.swing_points(bars, strength)
        assert want.count() > 50 and same(got, want)


def test_gaps(spark, tmp_path):
    rows = walk(2)
    bars = spark.createDataFrame(rows, BARS)
    got = structure.latest(streamed(spark, tmp_path, rows, structure.gaps, structure.GAPS, [1, 2, 30, 200, 399]), bars)
    want = batch_gaps.fair_value_gaps(bars)
    assert want.where("filled").count() > 20 and want.where("mitigated and not filled").count() > 0 and same(got, want)


def test_gaps_at_every_time_of_the_stream(spark, tmp_path):
    """After each delivery the log says what the batch operator says of the bars so far."""
    rows = walk(3, 60)
    updates = streamed(spark, tmp_path, rows, structure.gaps, structure.GAPS, [9, 19, 39, 59])
    for upto in (9, 19, 39):
        bars = spark.createDataFrame([r for r in rows if r[1] <= T + upto * HOUR], BARS)
        assert same(structure.latest(updates.where(F.col("as_of") <= T + upto * HOUR), bars), batch_gaps.fair_value_gaps(bars))


def test_late_bars_and_small_gaps(spark, tmp_path):
    rows = walk(4, 50, ("NQ",))
    late = [("NQ", rows[10][1], 1.0, 1e9, 0.1, 1.0, 1.0)]
    source = str(tmp_path / "s")
    for k, part in enumerate((rows[:30], late, rows[30:])):
        spark.createDataFrame(part, BARS).coalesce(1).write.mode("append").parquet(source)
    made = []
    for name, make, schema in (("a", lambda b: structure.swings(b, 2), structure.SWINGS), ("b", lambda b: structure.gaps(b, 3.0), structure.GAPS)):
        stream = make(spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(source))
        stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
        made.append(spark.read.schema(schema).parquet(str(tmp_path / name)))
    bars = spark.createDataFrame(rows, BARS)
    assert same(made[0], batch.swing_points(bars, 2))
    assert same(structure.latest(made[1], bars), batch_gaps.fair_value_gaps(bars, 3.0))


def test_a_bar_touches_only_gaps_that_it_changes():
    rng = np.random.default_rng(7)
    side, plain, changed = structure.Side([]), [], 0
    for k in range(3000):
        reach = float(rng.normal() * 10 + 100 * np.sin(k / 200))
        got = sorted(g["index"] for g in side.bar(reach, k))
        want = []
        for g in plain:
            if g["end"] is None and (reach <= g["touch"] if g["level"] is None else reach < g["level"]):
                g["level"] = reach
                g["end"] = k if reach <= g["fill"] else None
                want.append(g["index"])
        assert got == sorted(want)
        changed += len(want)
        touch = reach + float(rng.random() * 4)
        plain.append({"index": k, "touch": touch, "fill": touch - 5, "level": None, "end": None})
        side.add({"index": k, "touch": touch, "fill": touch - 5, "level": touch, "mitigated_time": None, "filled_time": None})
    assert side.touched == changed and len(side.gaps) == sum(g["end"] is None for g in plain) == len(side.order)


def ticks(seed, n=3000):
    rng = np.random.default_rng(seed)
    return [(str(rng.choice(["NQ", "ES"])), T + int(rng.integers(0, 72 * HOUR)), k, float(rng.integers(1, 1000))) for k in range(n)]


def test_cache_of_a_stream_equals_that_of_a_batch(spark, tmp_path):
    """Deliveries with late ticks, the stream stopped between them, and one batch played again."""
    rows = sorted(ticks(1), key=lambda r: r[1])
    rng = np.random.default_rng(2)
    at = [min(3, k * 4 // len(rows) + int(rng.random() < 0.2)) for k in range(len(rows))]
    s, source, state = Store(spark, str(tmp_path / "store")), str(tmp_path / "ticks"), str(tmp_path / "state")
    schema = "symbol string, ts timestamp, seq bigint, price double"
    frame = lambda part: spark.createDataFrame(part, "symbol string, time bigint, seq bigint, price double").select("symbol", F.timestamp_millis("time").alias("ts"), "seq", "price")
    for k in range(4):
        frame([r for r, a in zip(rows, at) if a == k]).coalesce(1).write.mode("append").parquet(source)
        if k != 1:  # two deliveries come while the stream is down
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            cache.into_cache(s, stream, "1h", state, late="365 days", availableNow=True).awaitTermination()
    want = {tuple(r) for r in from_ticks(spark.createDataFrame(rows, "symbol string, time bigint, seq bigint, price double"), "1h").collect()}
    bars = ("symbol", "time", "open", "high", "low", "close", "volume")
    read = lambda: {tuple(r) for r in s.candles().select(*bars).collect()}
    assert read() == want
    covered = {r["symbol"]: (r["start"], r["end"]) for r in s.coverage().collect()}
    for symbol in ("NQ", "ES"):
        times = [w[1] for w in want if w[0] == symbol]
        assert covered[symbol] == (min(times), max(times) - HOUR - 1)  # not the last two bars
    cache.absorb(s, s.candles().select(*bars).limit(0), 9, "1h")  # a batch without changes
    old = spark.createDataFrame([("NQ", min(w[1] for w in want if w[0] == "NQ"), 1.0, 1.0, 1.0, 1.0, 1.0)], BARS)
    newest = s.candles().agg(F.max("fetched_at")).first()[0]
    stamp = s.candles().where((F.col("symbol") == "NQ") & (F.col("time") == old.first()["time"])).first()["fetched_at"]
    cache.absorb(s, old, stamp - 1, "1h")  # one that is older than what is there
    assert read() == want
    last = spark.createDataFrame([r for r in want if r[1] >= T + 70 * HOUR], BARS)
    for _ in range(2):  # one that is played twice
        cache.absorb(s, last, newest, "1h")
    assert read() == want
