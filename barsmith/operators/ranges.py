"""Algebra of closed ranges of integer milliseconds, by counts over their end points in order of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.operators.blocks import running
from barsmith.operators.tables import kept

KEYS = ("symbol", "interval")


#: Milliseconds of a stretch of the time axis whose end points are counted in one task.
STRETCH = 30 * 86_400_000


def _counted(events: DataFrame, keys, values: dict[str, Column]) -> DataFrame:
    """Running sums over end points (keys, t, kind) in order of time and kind, stretch by stretch."""
    return running(events, list(keys), F.floor(F.col("t") / STRETCH), ["t", "kind"], {n: ("sum", c) for n, c in values.items()})


def _islands(ranges: DataFrame, reach: int, keys) -> DataFrame:
    """(keys, start, end, k): ranges joined while the next one starts at most ``reach`` after the end so far, numbered from 0.

    Starts and ends go by in one order; an island lasts while more ranges have begun than ended.
    """
    ends = F.array(F.struct(F.col("start").alias("t"), F.lit(0).alias("kind")), F.struct((F.col("end") + reach).alias("t"), F.lit(1).alias("kind")))
    # equal end points are one row, so that order among them does not matter
    events = ranges.select(*keys, F.explode(ends).alias("e")).groupBy(*keys, "e.t", "e.kind").agg(F.count(F.lit(1)).alias("n"))
    step = F.when(F.col("kind") == 0, F.col("n")).otherwise(-F.col("n"))
    depth = _counted(events, keys, {"depth": step})
    opens = (F.col("kind") == 0) & (F.col("depth") == F.col("n"))
    shuts = (F.col("kind") == 1) & (F.col("depth") == 0)
    edges = depth.where(opens | shuts).select(*keys, "t", "kind")
    numbered = _counted(edges, keys, {"k": F.when(F.col("kind") == 0, 1).otherwise(0)}).withColumn("k", F.col("k") - 1)
    return numbered.groupBy(*keys, "k").agg(F.min("t").alias("start"), (F.max("t") - reach).alias("end")).select(*keys, "start", "end", "k")


def merge(ranges: DataFrame, keys=KEYS) -> DataFrame:
    """Ranges that overlap or share an instant become one; ranges one millisecond apart stay two."""
    return _islands(ranges, 0, keys).drop("k")


def coalesce(ranges: DataFrame, step: int, bars: int = 4, keys=KEYS) -> DataFrame:
    """Ranges up to ``bars`` bars apart become one."""
    return _islands(ranges, bars * step, keys).drop("k")


def _met(islands: DataFrame, asked: DataFrame, keys) -> DataFrame:
    """Adds to ranges (keys, _from, _to) how many islands start at or before _from, at or before _to, and end before each.

    End points of islands and of ranges go by in one order: no range meets an island one by one.
    """
    s = lambda t, kind: F.struct(F.col(t).alias("t"), F.lit(kind).alias("kind"), F.lit(None).cast("bigint").alias("other"))
    q = lambda t, kind, o: F.struct(F.col(t).alias("t"), F.lit(kind).alias("kind"), F.col(o).alias("other"))
    both = islands.select(*keys, F.explode(F.array(s("start", 0), s("end", 3))).alias("e")).unionByName(asked.select(*keys, F.explode(F.array(q("_from", 1, "_to"), q("_to", 2, "_from"))).alias("e"))).select(*keys, "e.*")
    counted = _counted(both, keys, {"begun": F.when(F.col("kind") == 0, 1).otherwise(0), "ended": F.when(F.col("kind") == 3, 1).otherwise(0)})
    start = F.col("kind") == 1
    sides = counted.where("kind in (1, 2)").withColumns({"_from": F.when(start, F.col("t")).otherwise(F.col("other")), "_to": F.when(start, F.col("other")).otherwise(F.col("t"))})
    pick = lambda c, side, name: F.max(F.when(F.col("kind") == side, F.col(c))).alias(name)
    return sides.groupBy(*keys, "_from", "_to").agg(pick("begun", 1, "begun_from"), pick("begun", 2, "begun_to"), pick("ended", 1, "ended_from"), pick("ended", 2, "ended_to"))


def missing(covered: DataFrame, requested: DataFrame, keys=KEYS) -> DataFrame:
    """What of each requested range is not covered; a key may have several.

    Covered ranges become islands, and the room between two of them a gap with a number. Counts of the islands before its ends
    tell a request the first and last gap that it reaches, so the work grows with requests, ranges and what is missing.
    """
    keys = list(keys)
    wanted = requested.select(*keys, F.col("start").alias("_from"), F.col("end").alias("_to")).where("_from <= _to").distinct()
    islands = kept(_islands(covered.select(*keys, "start", "end"), 0, keys), "islands")
    reached = _met(islands, wanted, keys).withColumn("k", F.explode(F.when(F.col("begun_from") <= F.col("ended_to"), F.sequence("begun_from", "ended_to")).otherwise(F.array().cast("array<bigint>"))))
    right = islands.select(*keys, "k", (F.col("start") - 1).alias("_right"))
    left = islands.select(*keys, (F.col("k") + 1).alias("k"), (F.col("end") + 1).alias("_left"))
    found = reached.join(right, [*keys, "k"], "left").join(left, [*keys, "k"], "left")
    found = found.select(*keys, F.greatest("_from", "_left").alias("start"), F.least("_to", "_right").alias("end"))
    return found.where("start <= end")


def outside(rows: DataFrame, ranges: DataFrame, start: str, end: str, keys=()) -> DataFrame:
    """The rows whose closed range [start, end] touches none of the ranges (keys, start, end), by counts as in :func:`missing`."""
    keys = list(keys)
    plain = rows.select(*keys, F.col(start).alias("_from"), F.col(end).alias("_to")).distinct().withColumn("_one", F.lit(1))
    spans = ranges.select(*keys, "start", "end").withColumn("_one", F.lit(1))
    told = _met(_islands(spans, 0, [*keys, "_one"]), plain, [*keys, "_one"]).where("begun_to = ended_from").select(*keys, F.col("_from").alias(start), F.col("_to").alias(end))
    return rows.join(told, [*keys, start, end], "left_semi").select(*rows.columns)


def chunks(requested: DataFrame, length: int, keys=KEYS) -> DataFrame:
    """Requests cut into pieces of at most ``length`` milliseconds that share their boundary instants."""
    cuts = requested.withColumn("start_at", F.explode(F.sequence("start", F.greatest(F.col("end") - 1, F.col("start")), F.lit(length))))
    return cuts.select(*keys, F.col("start_at").alias("start"), F.least(F.col("start_at") + length, F.col("end")).alias("end"))
