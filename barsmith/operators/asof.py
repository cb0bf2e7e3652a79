"""Bars near a time: nearest, within range, exact, and fractional positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsmith.functions.intervals import DAY
from barsmith.operators.bars import median_spacing
from barsmith.operators.blocks import indexed


def around(points: DataFrame, bars: DataFrame, span: int = 7 * DAY) -> DataFrame:
    """Adds to (id, symbol, time) the bars at or before (``prev``) and after (``next``) as structs of time and index, and ``bars``, ``first``, ``last``.

    Points and bars are put in one order and carried forward and back. That is done in spans of time; what
    a span needs from outside is the last bar before it and the first after it, from a small table of spans.
    """
    rows = bars if "index" in bars.columns else indexed(bars)
    at = F.floor(F.col("time") / span)
    b = rows.select("symbol", "time", at.alias("_span"), F.lit(None).cast(dict(points.dtypes)["id"]).alias("id"), F.struct("time", "index").alias("_bar"), F.lit(0).alias("_kind"))
    p = points.select("symbol", "time", at.alias("_span"), "id", F.lit(None).cast("struct<time:bigint,index:bigint>").alias("_bar"), F.lit(1).alias("_kind"))
    spans = b.groupBy("symbol", "_span").agg(F.min("_bar").alias("_lo"), F.max("_bar").alias("_hi")).withColumn("_real", F.lit(1))
    spans = spans.unionByName(p.select("symbol", "_span").distinct(), allowMissingColumns=True).groupBy("symbol", "_span").agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    w = Window.partitionBy("symbol").orderBy("_span")
    spans = spans.select("symbol", "_span", F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("_lo").over(Window.partitionBy("symbol").orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    near = Window.partitionBy("symbol", "_span").orderBy("time", "_kind")
    back = Window.partitionBy("symbol", "_span").orderBy(F.desc("time"), F.desc("_kind"))
    both = b.unionByName(p).withColumns({"_p": F.last("_bar", ignorenulls=True).over(near), "_n": F.last("_bar", ignorenulls=True).over(back)})
    ends = rows.groupBy("symbol").agg(F.min(F.struct("time", "index")).alias("first"), F.max(F.struct("time", "index")).alias("last"), F.count(F.lit(1)).alias("bars"))
    found = both.where("_kind = 1").join(spans, ["symbol", "_span"]).join(ends, "symbol", "left")
    return found.select("id", "symbol", "time", F.coalesce("_p", "_before").alias("prev"), F.coalesce("_n", "_after").alias("next"), "first", "last", "bars")


def nearest(points: DataFrame, bars: DataFrame) -> DataFrame:
    """id, symbol, time, ``nearest`` (the earlier bar on a tie), ``snapped`` (null outside the series), ``exact`` (position or -1)."""
    a = around(points, bars)
    back, ahead = F.col("time") - F.col("prev.time"), F.col("next.time") - F.col("time")
    near = F.when(F.col("prev").isNull(), F.col("next.time")).when(F.col("next").isNull(), F.col("prev.time")).when(back <= ahead, F.col("prev.time")).otherwise(F.col("next.time"))
    inside = F.col("time").between(F.col("first.time"), F.col("last.time"))
    return a.select("id", "symbol", "time", near.alias("nearest"), F.when(inside, near).alias("snapped"), F.when(F.col("prev.time") == F.col("time"), F.col("prev.index")).otherwise(F.lit(-1).cast("bigint")).alias("exact"))


def logical_index(points: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds ``logical``: the position of a time, interpolated between bars and extrapolated by the median spacing."""
    a = around(points, bars).join(median_spacing(bars), "symbol", "left")
    step = F.when(F.col("spacing") > 0, F.col("spacing")).cast("double")
    before = (F.col("time") - F.col("first.time")) / step
    after = F.col("bars") - 1 + (F.col("time") - F.col("last.time")) / step
    part = F.try_divide((F.col("time") - F.col("prev.time")).cast("double"), (F.col("next.time") - F.col("prev.time")).cast("double"))
    value = F.when(F.col("time") < F.col("first.time"), before).when(F.col("time") > F.col("last.time"), after).when(F.col("prev.time") == F.col("time"), F.col("prev.index").cast("double")).otherwise(F.col("prev.index") + part)
    return a.select("id", "symbol", "time", value.alias("logical"))


def time_at(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """(id, symbol, logical) -> ``time``: the inverse of :func:`logical_index`, rounded half up."""
    rows = bars if "index" in bars.columns else indexed(bars)
    ends = rows.groupBy("symbol").agg(F.min("time").alias("_first"), F.max("time").alias("_last"), F.count(F.lit(1)).alias("_n"))
    at = positions.join(ends, "symbol").join(median_spacing(bars), "symbol", "left").withColumn("_i", F.floor("logical").cast("bigint"))
    here = rows.select("symbol", F.col("index").alias("_i"), F.col("time").alias("_t"))
    ahead = rows.select("symbol", (F.col("index") - 1).alias("_i"), F.col("time").alias("_t2"))
    at = at.join(here, ["symbol", "_i"], "left").join(ahead, ["symbol", "_i"], "left")
    inside = F.col("_t") + (F.coalesce("_t2", "_t") - F.col("_t")) * (F.col("logical") - F.col("_i"))
    value = F.when(F.col("logical") < 0, F.col("_first") + F.col("logical") * F.col("spacing")).when(F.col("logical") > F.col("_n") - 1, F.col("_last") + (F.col("logical") - (F.col("_n") - 1)) * F.col("spacing")).otherwise(inside)
    return at.select("id", "symbol", "logical", F.floor(value + 0.5).cast("bigint").alias("time"))
