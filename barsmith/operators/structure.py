"""Swing points and true range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.operators.blocks import indexed, over_blocks, window


def swing_points(bars: DataFrame, strength: int = 2) -> DataFrame:
    """Highs strictly above the ``strength`` bars before and not below those after, and lows likewise.

    A point is confirmed at the time of the last bar that it needs. A bar can be both. ``bars`` may
    carry ``index`` already.
    """
    if strength < 1:
        raise ValueError("strength must be at least 1")
    s, w = strength, window()
    rows = bars if "index" in bars.columns else indexed(bars)
    back, ahead = w.rowsBetween(-s, -1), w.rowsBetween(1, s)
    rows = over_blocks(rows, {
        "_full": F.count(F.lit(1)).over(w.rowsBetween(-s, s)) == 2 * s + 1, "confirmed_time": F.lead("time", s).over(w),
        "_high": (F.col("high") > F.max("high").over(back)) & (F.col("high") >= F.max("high").over(ahead)),
        "_low": (F.col("low") < F.min("low").over(back)) & (F.col("low") <= F.min("low").over(ahead)),
    }, s, s)
    points = F.array(F.struct(F.lit("high").alias("kind"), F.col("high").alias("price"), F.col("_high").alias("is")), F.struct(F.lit("low").alias("kind"), F.col("low").alias("price"), F.col("_low").alias("is")))
    found = rows.where(F.col("_full")).withColumn("p", F.explode(F.filter(points, lambda p: p["is"])))
    return found.select("symbol", F.col("p.kind").alias("kind"), "index", "time", F.col("p.price").alias("price"), "confirmed_time", F.lit(s).alias("strength"))


def true_range(bars: DataFrame, period: int = 14) -> DataFrame:
    """Adds ``index``, ``true_range``, and ``atr``: the mean of the last ``period`` ranges, in which bar 0 has no part (0 for bar 0)."""
    rows = bars if "index" in bars.columns else indexed(bars)
    w = window()
    prior = F.lag("close").over(w)
    rows = over_blocks(rows, {"true_range": F.when(F.col("index") == 0, F.col("high") - F.col("low")).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prior), F.abs(F.col("low") - prior)))}, 1, 0)
    mean = F.avg(F.when(F.col("index") >= 1, F.col("true_range"))).over(w.rowsBetween(-(period - 1), 0))
    return over_blocks(rows, {"atr": F.coalesce(mean, F.lit(0.0))}, period, 0)
