"""Forming and closed bars of a tick stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of (symbol, ts timestamp, seq, price): in append mode each once it is closed, in update mode as it forms.

    The watermark allows for ticks that are ``late``: two bars, as the cache never trusts the last two.
    """
    order = F.struct("ts", "seq")
    bars = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", length).alias("w")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return bars.select("symbol", F.unix_millis("w.start").alias("time"), "open", "high", "low", "close", "volume")
