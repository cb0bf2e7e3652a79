"""Bars from ticks, and coarser bars from finer ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsmith.functions.intervals import LENGTH, bucket
from barsmith.functions.time import EXCHANGE_ZONE, from_ntz
from barsmith.operators.blocks import SPAN, previous

COLUMNS = ("symbol", "time", "open", "high", "low", "close", "volume")


def ticks(events: DataFrame) -> DataFrame:
    """symbol, time, seq, price of an event table; prices that are not positive are dropped."""
    ms = from_ntz(F.col("ts")) if dict(events.dtypes)["ts"] == "timestamp_ntz" else F.unix_millis("ts")
    return events.select(F.col("event_type").alias("symbol"), ms.cast("bigint").alias("time"), F.col("event_id").alias("seq"), F.col("value").alias("price")).where("price > 0")


def from_ticks(rows: DataFrame, name: str, zone: str = EXCHANGE_ZONE) -> DataFrame:
    """OHLCV bars; ties in time go by ``seq``. Partial sums are made before the shuffle."""
    order = F.struct("time", "seq")
    found = rows.groupBy("symbol", bucket(F.col("time"), name, zone).alias("bar")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return found.withColumnRenamed("bar", "time").select(*COLUMNS)


def resample(bars: DataFrame, name: str, zone: str = EXCHANGE_ZONE, source: str | None = None, drop_incomplete: bool = False) -> DataFrame:
    """First open, highest high, lowest low, last close and summed volume of each bucket that has bars.

    ``drop_incomplete`` leaves out a symbol's last bucket if it has fewer source bars than fit.
    """
    found = bars.groupBy("symbol", bucket(F.col("time"), name, zone).alias("bar")).agg(F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("_n"))
    if drop_incomplete:
        if not source:
            raise ValueError("drop_incomplete needs the source interval")
        last = found.groupBy("symbol").agg(F.max("bar").alias("_last"))
        found = found.join(last, "symbol").where((F.col("bar") < F.col("_last")) | (F.col("_n") >= LENGTH[name] // LENGTH[source]))
    return found.withColumnRenamed("bar", "time").select(*COLUMNS)


def selection_summary(bars: DataFrame) -> DataFrame:
    """One row a symbol: bars, open, close, change in percent, high, low."""
    each = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.min_by("open", "time").alias("open"), F.max_by("close", "time").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"))
    return each.withColumn("change_percent", F.when(F.col("open") != 0, (F.col("close") - F.col("open")) / F.col("open") * 100).otherwise(0.0))


def median_spacing(bars: DataFrame) -> DataFrame:
    """The upper median of the positive distances between neighbouring bars of a symbol."""
    near = previous(bars.select("symbol", "time"), ["symbol"], F.floor(F.col("time") / SPAN), ["time"], ["time"])
    gaps = near.select("symbol", (F.col("time") - F.col("_prev.time")).alias("gap")).where("gap > 0").groupBy("symbol", "gap").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("symbol").orderBy("gap")
    ranked = gaps.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(Window.partitionBy("symbol")))
    return ranked.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("symbol").agg(F.min("gap").alias("spacing"))


def tail(rows: DataFrame, n: int, keys: list[str], order: list) -> DataFrame:
    """The most recent ``n`` rows of each key, with the flag whether any were cut.

    No more than n + 1 rows of a key leave a task; the flag is whether there is a row n + 1.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    few = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n + 1)
    return few.withColumn("truncated", F.max("_r").over(Window.partitionBy(*keys)) > n).where(F.col("_r") <= n).drop("_r")
