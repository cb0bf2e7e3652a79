"""Synthetic bars in exchange hours, made on the executors.

Every symbol follows one market factor and its own noise; both are sums of hashed normal steps, so any
part can be made again without state. Volatility is U-shaped over a session and changes by regime.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barsmith.functions.intervals import HOUR, LENGTH, MINUTE
from barsmith.functions.numbers import round_tick
from barsmith.functions.time import in_session, session_day
from barsmith.sources.files import BadData, archive

#: Fixed values of this generator: days and volatility of each regime, in a cycle.
REGIMES = ((12, 0.6), (5, 1.8), (20, 0.9), (8, 1.3), (15, 0.7))


def regimes(spark: SparkSession) -> DataFrame:
    """from_day, to_day (exclusive), volatility within one cycle."""
    rows, at = [], 0
    for days, volatility in REGIMES:
        rows.append((at, at + days, volatility))
        at += days
    return spark.createDataFrame(rows, "from_day int, to_day int, volatility double")


def regime_of(days: DataFrame, table: DataFrame, day: str = "day_index") -> DataFrame:
    """Adds the volatility of the regime in which a day lies, by a range join with the few regimes."""
    cycle = sum(d for d, _ in REGIMES)
    at = F.pmod(F.col(day), F.lit(cycle))
    return days.join(F.broadcast(table), (at >= F.col("from_day")) & (at < F.col("to_day"))).drop("from_day", "to_day")


def _normal(seed: int, *keys):
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), *keys), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * 3.141592653589793 * u(1))


def demo_bars(spark: SparkSession, symbols: dict[str, tuple[float, float, float, int]], start: int, end: int, seed: int = 1) -> DataFrame:
    """Five-minute bars of {symbol: (first price, beta, tick, digits)} between two times."""
    step = 5 * MINUTE
    return demo_at(spark.range(start - start % step, end + 1, step).select(F.col("id").alias("time")), symbols, seed)


def demo_at(times: DataFrame, symbols: dict[str, tuple[float, float, float, int]], seed: int = 1) -> DataFrame:
    """The same at those of the given times (each once) that lie in exchange hours."""
    spark = times.sparkSession
    times = times.where(in_session(F.col("time")))
    times = times.withColumn("day", session_day(F.col("time"))).withColumn("day_index", F.datediff("day", F.lit("1970-01-01").cast("date")))
    times = regime_of(times, regimes(spark))
    phase = F.pmod(F.col("time"), F.lit(86_400_000)) / 86_400_000.0
    scale = F.col("volatility") * 0.0004 * (0.7 + 0.9 * F.abs(F.cos(3.141592653589793 * phase)))
    rows = times.crossJoin(F.broadcast(spark.createDataFrame([(s, *v) for s, v in symbols.items()], "symbol string, first double, beta double, tick double, digits int")))  # a few symbols
    move = scale * (F.col("beta") * _normal(seed, F.col("time")) + 0.4 * _normal(seed + 10, F.col("time"), F.col("symbol")))
    # running sums day by day, then over the short table of days
    rows = rows.withColumn("_m", move)
    days = rows.groupBy("symbol", "day").agg(F.sum("_m").alias("_d"))
    before = days.withColumn("_base", F.coalesce(F.sum("_d").over(Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_d")
    w = Window.partitionBy("symbol", "day").orderBy("time")
    rows = rows.join(before, ["symbol", "day"]).withColumn("_c", F.col("first") * F.exp(F.col("_base") + F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, 0)))).withColumn("_o", F.col("first") * F.exp(F.col("_base") + F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")))
    wick = lambda k: F.abs(_normal(seed + k, F.col("time"), F.col("symbol"))) * scale * 0.5 * F.col("_c")
    snap = lambda x: F.round(F.rint(x / F.col("tick")) * F.col("tick"), 4)
    out = rows.select("symbol", "time", snap(F.col("_o")).alias("open"), snap(F.greatest("_o", "_c") + wick(20)).alias("high"), snap(F.least("_o", "_c") - wick(30)).alias("low"), snap(F.col("_c")).alias("close"), F.round(500 * (1 + 3 * F.abs(F.cos(3.141592653589793 * phase))) * F.exp(0.4 * _normal(seed + 40, F.col("time"), F.col("symbol")))).alias("volume"))
    return out.withColumns({"high": F.greatest("open", "high", "close"), "low": F.least("open", "low", "close")})


def paged(symbol: str, interval: str, start: int, end: int) -> list[tuple]:
    """A vendor for tests of paging: a bar for each step of a half-open range, its prices by the hour of the day."""
    step = LENGTH[interval]
    first = start + -start % step
    return [(t, 100.0 + t // HOUR % 24, 103.0 + t // HOUR % 24, 99.0 + t // HOUR % 24, 101.5 + t // HOUR % 24, float(t // step % 10)) for t in range(first, end, step)]


def flaky(symbol: str, interval: str, start: int, end: int, folder: str, page: int, lost: str) -> list[tuple]:
    """A vendor for tests of fallback: an archive that lost the pages whose number on the grid of ``page`` ends in a digit of ``lost``."""
    if str(start // int(page) % 10) in lost:
        raise BadData("page lost")
    return archive(symbol, interval, start, end, folder)


__all__ = ["demo_at", "demo_bars", "flaky", "paged", "regime_of", "regimes", "round_tick"]
