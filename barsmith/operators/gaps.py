"""Fair value gaps: three-bar imbalances, and what became of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.operators.blocks import indexed, over_blocks, window

#: Children of a node in the tree of lowest and highest prices.
LOOK = 256
#: Milliseconds of the shortest stretch of time by which points meet gaps, and how much longer each next one is.
STRETCH, LONGER = 16 * 3_600_000, 8


def detect(bars: DataFrame, min_size_percent: float = 0.0) -> DataFrame:
    """A gap lies between the bars two apart: bullish if the later low is above the earlier high, bearish mirrored."""
    rows = bars if "index" in bars.columns else indexed(bars)
    w = window()
    rows = over_blocks(rows, {"_h2": F.lag("high", 2).over(w), "_l2": F.lag("low", 2).over(w), "start_time": F.lag("time", 2).over(w)}, 2, 0)
    kind = F.when(F.col("_h2") < F.col("low"), "bullish").when(F.col("_l2") > F.col("high"), "bearish")
    rows = rows.withColumn("direction", kind).where("direction is not null")
    up = F.col("direction") == "bullish"
    rows = rows.withColumns({"bottom": F.when(up, F.col("_h2")).otherwise(F.col("high")), "top": F.when(up, F.col("low")).otherwise(F.col("_l2"))})
    rows = rows.withColumns({"midpoint": (F.col("top") + F.col("bottom")) / 2, "size": F.col("top") - F.col("bottom")})
    rows = rows.withColumn("size_percent", F.when(F.col("midpoint") == 0, F.lit(0.0)).otherwise(F.col("size") / F.col("midpoint") * 100))
    return rows.where(F.col("size_percent") >= min_size_percent).select("symbol", "direction", "index", "time", "start_time", "bottom", "top", "midpoint", "size", "size_percent")


def tree(bars: DataFrame, fan: int, depth: int) -> DataFrame:
    """(symbol, k, parent, children): nodes over positions, each with the lowest low and highest high of its up to ``fan`` children.

    The children of level 0 are bars, and carry their times.
    """
    level = bars.select("symbol", F.col("index").alias("at"), "low", "high", "time")
    levels = []
    for k in range(depth):
        levels.append(level.withColumn("k", F.lit(k)))
        level = level.groupBy("symbol", F.floor(F.col("at") / fan).alias("at")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.lit(None).cast("bigint").alias("time"))
    rows = levels[0]
    for more in levels[1:]:
        rows = rows.unionByName(more)
    child = F.struct(F.pmod("at", F.lit(fan)).alias("i"), "low", "high", "time")
    return rows.groupBy("symbol", "k", F.floor(F.col("at") / fan).alias("parent")).agg(F.array_sort(F.collect_list(child)).alias("children"))


def mitigation(bars: DataFrame, gaps: DataFrame, block: int = LOOK) -> DataFrame:
    """Adds mitigated(_time), filled(_time), end_time and penetration (0 to 1) by the bars after each gap.

    The first bar that comes back to a price is found in a tree of lowest and highest prices: on the way up
    a gap looks at the nodes to the right of its own, on the way down at the children of the first one that
    reaches the price. Each step is a join with one row a gap, so the work is gaps times levels.
    """
    rows = bars if "index" in bars.columns else indexed(bars)
    fan = max(2, block)
    last, depth = rows.agg(F.max("index")).first()[0] or 0, 1  # one number
    while fan**depth <= last:
        depth += 1
    nodes = tree(rows, fan, depth)
    up = F.col("direction") == "bullish"
    # prices as the direction sees them: the price that comes back into the gap, mirrored for bearish ones
    reach = lambda c: F.when(up, c["low"]).otherwise(-c["high"])
    found = gaps.withColumns({"_touch": F.when(up, F.col("top")).otherwise(-F.col("bottom")), "_fill": F.when(up, F.col("bottom")).otherwise(-F.col("top"))})
    nothing = F.lit(None).cast("struct<k:int,at:bigint,time:bigint>")
    found = found.withColumns({"_t": nothing, "_f": nothing, "_after": F.lit(None).cast("double")})
    for k in range(depth):
        own, parent = F.floor(F.col("index") / fan**k), F.floor(F.col("index") / fan ** (k + 1))
        here = nodes.where(F.col("k") == k).select("symbol", F.col("parent").alias("_p"), "children")
        found = found.withColumn("_p", parent).join(here, ["symbol", "_p"], "left")
        right = F.filter("children", lambda c: c["i"] > F.pmod(own, F.lit(fan)))  # noqa: B023
        found = found.withColumn("_right", right)
        first = lambda level: F.get(F.filter("_right", lambda c: reach(c) <= level), F.lit(0))
        node = lambda c: F.when(c.isNotNull(), F.struct(F.lit(k).alias("k"), (F.col("_p") * fan + c["i"]).alias("at"), c["time"].alias("time")))  # noqa: E731, B023
        found = found.withColumns({"_t": F.coalesce("_t", node(first(F.col("_touch")))), "_f": F.coalesce("_f", node(first(F.col("_fill")))), "_after": F.least("_after", F.array_min(F.transform("_right", reach)))})
        found = found.drop("_p", "children", "_right")
    for k in range(depth - 1, 0, -1):
        for name, level in (("_t", "_touch"), ("_f", "_fill")):
            below = nodes.where(F.col("k") == k - 1).select("symbol", F.col("parent").alias("_p"), "children")
            found = found.withColumn("_p", F.when(F.col(f"{name}.k") == k, F.col(f"{name}.at"))).join(below, ["symbol", "_p"], "left")
            c = F.get(F.filter("children", lambda c: reach(c) <= F.col(level)), F.lit(0))  # noqa: B023
            down = F.struct(F.lit(k - 1).alias("k"), (F.col("_p") * fan + c["i"]).alias("at"), c["time"].alias("time"))
            found = found.withColumn(name, F.when(F.col("_p").isNotNull(), down).otherwise(F.col(name))).drop("_p", "children")
    ends = rows.groupBy("symbol").agg(F.max("time").alias("_last"))
    found = found.join(ends, "symbol")
    depth_of = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("_touch") - F.col("_after"), F.col("size"))))
    return found.select("symbol", "direction", "index", "time", "start_time", F.coalesce("_f.time", "_last").alias("end_time"), "bottom", "top", "midpoint", "size", "size_percent", F.col("_t").isNotNull().alias("mitigated"), F.col("_t.time").alias("mitigated_time"), F.col("_f").isNotNull().alias("filled"), F.col("_f.time").alias("filled_time"), F.when(F.col("_after").isNull(), F.lit(0.0)).otherwise(F.coalesce(depth_of, F.lit(0.0))).alias("penetration"))


def fair_value_gaps(bars: DataFrame, min_size_percent: float = 0.0, include_filled: bool = True) -> DataFrame:
    """Gaps and what became of them. ``bars`` are read several times, so they should be a table."""
    rows = bars if "index" in bars.columns else indexed(bars)
    found = mitigation(rows, detect(rows, min_size_percent))
    return found if include_filled else found.where("not filled")


def containing(points: DataFrame, gaps: DataFrame, time: str = "time", price: str = "price") -> DataFrame:
    """Adds ``gap_time``: the earliest gap that existed, was not filled before, and holds the price.

    A gap filled at that very time still counts. Points and gaps meet in cells of time and price: a gap lies in
    cells as long and as high as itself (two by two of them at most), and a point asks in one cell of each
    size that gaps of its symbol have. So a point meets gaps that are near in both, not all of its symbol.
    """
    open_end = F.lit(1 << 62)
    g = gaps.select("symbol", F.col("time").alias("_gt"), "bottom", "top", F.coalesce("filled_time", open_end).alias("_gf"))
    span = F.greatest(F.col("_gf") - F.col("_gt"), F.lit(1)).cast("double")
    # sizes are numbers of steps: time in powers of LONGER, without end for gaps still open; price in powers of two
    long = F.when(F.col("_gf") == open_end, F.lit(99)).otherwise(F.greatest(F.lit(0), F.ceil(F.log(span / STRETCH) / F.log(F.lit(float(LONGER)))).cast("int")))
    high = F.ceil(F.log2(F.greatest(F.col("top") - F.col("bottom"), F.lit(1e-12)))).cast("int")
    g = g.withColumns({"_long": long, "_high": high})

    def stretch(t: Column) -> Column:
        return F.when(F.col("_long") == 99, F.lit(0).cast("bigint")).otherwise(F.floor(t / (STRETCH * F.pow(F.lit(float(LONGER)), F.col("_long")))))

    def cell(p: Column) -> Column:
        return F.floor(p / F.pow(F.lit(2.0), F.col("_high")))

    sizes = g.select("symbol", "_long", "_high").distinct()
    g = g.withColumn("_s", F.explode(F.sequence(stretch(F.col("_gt")), stretch(F.col("_gf"))))).withColumn("_c", F.explode(F.sequence(cell(F.col("bottom")), cell(F.col("top")))))
    keyed = points.withColumn("_row", F.struct(*(F.col(f"`{c}`") for c in points.columns))).select("_row", "symbol", F.col(time).alias("_time"), F.col(price).alias("_price"))
    asked = keyed.join(sizes, "symbol").withColumns({"_s": stretch(F.col("_time")), "_c": cell(F.col("_price"))})
    holds = (F.col("_gt") <= F.col("_time")) & (F.col("_gf") >= F.col("_time")) & F.col("_price").between(F.col("bottom"), F.col("top"))
    first = asked.join(g, ["symbol", "_long", "_high", "_s", "_c"]).where(holds).groupBy("_row").agg(F.min("_gt").alias("gap_time"))
    return keyed.select("_row").join(first, "_row", "left").select("_row.*", "gap_time")
