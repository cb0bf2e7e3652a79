"""Divergence between correlated symbols: one takes a swing level, the other does not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.functions.numbers import is_close, percent_change
from barsmith.operators.blocks import BLOCK, previous
from barsmith.operators.gaps import containing

#: Width of a cell of the scale on which prices are compared; a few times what counts as close.
CLOSE = 4e-9


def _scale(price: Column) -> Column:
    """A scale on which prices that are close (by 1e-9 of the price, or by 1e-9 below 1) are less than CLOSE apart."""
    size = F.abs(price)
    return F.signum(price) * F.when(size < 1, size).otherwise(1 + F.log(size))


def on_edges(anchors: DataFrame, gaps: DataFrame) -> DataFrame:
    """(symbol, time, price, ...) -> adds ``on_edge``: whether the price is that of an edge of a gap that existed then.

    Each edge counts from its first gap on. Prices meet edges in cells of :func:`_scale`, each edge in its own
    and the two beside it; the exact test follows.
    """
    edges = gaps.select("symbol", F.col("time").alias("_gt"), F.explode(F.array("bottom", "top")).alias("_edge")).groupBy("symbol", "_edge").agg(F.min("_gt").alias("_gt"))
    at = lambda c: F.floor(_scale(c) / CLOSE)
    edges = edges.withColumn("_k", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: at(F.col("_edge")) + d)))
    asked = anchors.select("symbol", "time", "price").distinct().withColumn("_k", at(F.col("price")))
    hit = asked.join(edges, ["symbol", "_k"]).where((F.col("_gt") <= F.col("time")) & is_close(F.col("price"), F.col("_edge"))).select("symbol", "time", "price").distinct().withColumn("on_edge", F.lit(True))
    return anchors.join(hit, ["symbol", "time", "price"], "left").withColumn("on_edge", F.coalesce("on_edge", F.lit(False)))


def between(bars: DataFrame, swings: DataFrame, gaps: DataFrame, primary: str, references: list[str], *, shown: DataFrame | None = None, max_separation: int = 120, include_invalid: bool = False) -> DataFrame:
    """One row for each reference and pair of consecutive primary swings of one kind where just one symbol takes the level.

    ``bars``, ``swings`` and ``gaps`` hold all symbols. A reference is read at the two anchor times; a pair without
    both bars is left out. ``shown``: the primary gaps that divergences are placed in, by default all.
    """
    points = swings.where(F.col("symbol") == primary).select("kind", "index", "time", "price", "confirmed_time")
    pairs = previous(points, ["kind"], F.floor(F.col("index") / BLOCK), ["index"], ["index", "time", "price"])
    pairs = pairs.withColumn("separation_bars", F.col("index") - F.col("_prev.index")).where(F.col("separation_bars").between(1, max_separation))
    pairs = pairs.select("kind", "time", "price", "confirmed_time", "separation_bars", F.col("_prev.time").alias("p_time"), F.col("_prev.price").alias("p_price"))
    other = bars.where(F.col("symbol").isin(references))
    side = lambda t, out: other.select("symbol", F.col("time").alias(t), F.col("high").alias(f"{out}_high"), F.col("low").alias(f"{out}_low"))
    pairs = pairs.join(side("p_time", "r0"), "p_time").join(side("time", "r1"), ["symbol", "time"])
    high = F.col("kind") == "high"
    pairs = pairs.withColumns({"r_start": F.when(high, F.col("r0_high")).otherwise(F.col("r0_low")), "r_end": F.when(high, F.col("r1_high")).otherwise(F.col("r1_low"))})
    took = lambda a, b: F.when(high, F.col(b) > F.col(a)).otherwise(F.col(b) < F.col(a))
    pairs = pairs.withColumns({"p_took": took("p_price", "price"), "r_took": took("r_start", "r_end")}).where("p_took <> r_took")
    pairs = pairs.select("symbol", "kind", "time", "price", "p_time", "p_price", "r_start", "r_end", "p_took", "confirmed_time", "separation_bars")
    # both ends of a pair are looked up together: is there a swing of the reference, is its price on an edge
    ends = F.array(F.struct(F.lit(0).alias("end"), F.col("p_time").alias("time"), F.col("r_start").alias("price")), F.struct(F.lit(1).alias("end"), F.col("time").alias("time"), F.col("r_end").alias("price")))
    anchors = pairs.select("symbol", "kind", F.col("time").alias("_id"), F.explode(ends).alias("a")).select("symbol", "kind", "_id", "a.end", "a.time", "a.price")
    known = swings.where(F.col("symbol").isin(references)).select("symbol", "kind", "time").distinct().withColumn("swung", F.lit(True))
    anchors = on_edges(anchors.join(known, ["symbol", "kind", "time"], "left").withColumn("swung", F.coalesce("swung", F.lit(False))), gaps.where(F.col("symbol").isin(references)))
    anchors = anchors.groupBy("symbol", "kind", F.col("_id").alias("time")).agg(F.min("swung").alias("_swings"), F.min(F.col("swung") | F.col("on_edge")).alias("_either"))
    pairs = pairs.join(anchors, ["symbol", "kind", "time"])
    pairs = pairs.withColumn("validity", F.when(F.col("_swings"), "swing_pair").when(F.col("_either"), "fvg_edge").otherwise("unconfirmed"))
    if not include_invalid:
        pairs = pairs.where("validity <> 'unconfirmed'")
    mine = gaps.where(F.col("symbol") == primary) if shown is None else shown
    pairs = containing(pairs.withColumnRenamed("symbol", "reference_symbol").withColumn("symbol", F.lit(primary)), mine)
    who = F.col("p_took")
    return pairs.select(
        "kind", F.when(F.col("kind") == "high", "bearish").otherwise("bullish").alias("bias"), F.col("symbol").alias("primary_symbol"), "reference_symbol",
        F.col("p_time").alias("start_time"), F.col("time").alias("end_time"), F.col("p_price").alias("primary_start_price"), F.col("price").alias("primary_end_price"), F.col("r_start").alias("reference_start_price"), F.col("r_end").alias("reference_end_price"),
        F.when(who, F.col("symbol")).otherwise(F.col("reference_symbol")).alias("leading_symbol"), F.when(who, F.col("reference_symbol")).otherwise(F.col("symbol")).alias("lagging_symbol"),
        "validity", (F.col("validity") != "unconfirmed").alias("valid"), "confirmed_time", F.col("gap_time").isNotNull().alias("inside_fair_value_gap"), F.col("gap_time").alias("fair_value_gap_time"),
        F.abs(percent_change(F.col("p_price"), F.col("price")) - percent_change(F.col("r_start"), F.col("r_end"))).alias("strength"), "separation_bars",
    )


def divergences(primary: DataFrame, swings: DataFrame, reference: DataFrame, reference_swings: DataFrame, *, primary_symbol: str, reference_symbol: str, primary_gaps: DataFrame, reference_gaps: DataFrame, **options) -> DataFrame:
    """:func:`between` for one reference, from tables of one symbol each."""
    both = lambda a, b: a.withColumn("symbol", F.lit(primary_symbol)).unionByName(b.withColumn("symbol", F.lit(reference_symbol)))
    return between(both(primary, reference), both(swings, reference_swings), both(primary_gaps, reference_gaps), primary_symbol, [reference_symbol], **options)


def shared_bars(bars: DataFrame, primary: str, references: list[str]) -> DataFrame:
    """(reference_symbol, bars, shared): how many bars each reference has, and how many of their times the primary shares."""
    mine = bars.where(F.col("symbol") == primary).select("time", F.lit(1).alias("_in"))
    return bars.where(F.col("symbol").isin(references)).join(mine, "time", "left").groupBy(F.col("symbol").alias("reference_symbol")).agg(F.count(F.lit(1)).alias("bars"), F.count("_in").alias("shared"))
