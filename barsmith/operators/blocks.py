"""Positions and overlapping blocks, so that one long series is many tasks.

A window over ``partitionBy(symbol)`` puts a whole series into one task, and there are only a few
symbols. Here a series is numbered without that: bars are counted in spans of time, the counts are
summed up over the short table of spans, and each span numbers its own bars. Blocks of consecutive
positions then carry the few bars before and after that a fixed frame looks at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Bars in a block, and milliseconds in a span.
BLOCK, SPAN = 4096, 7 * 86_400_000


def indexed(bars: DataFrame, span: int = SPAN) -> DataFrame:
    """Adds ``index``: the position of a bar in its symbol's series, from 0."""
    rows = bars.withColumn("_span", F.floor(F.col("time") / span))
    return place(rows, ["symbol"], "_span", ["time"], "index").drop("_span")


def place(rows: DataFrame, keys: list[str], span: str, order: list[str], name: str) -> DataFrame:
    """Adds the position from 0 in ``order`` of ``keys``; the column ``span`` grows with the order."""
    counts = rows.groupBy(*keys, span).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, span, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    at = F.row_number().over(Window.partitionBy(*keys, span).orderBy(*order)) - 1
    return rows.withColumn("_place", at).join(offsets, [*keys, span]).withColumn(name, (F.col("_place") + F.col("_offset")).cast("bigint")).drop("_place", "_offset")


def in_blocks(rows: DataFrame, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """Indexed rows with ``_block``; rows near an edge are repeated in the neighbouring blocks with ``_own`` false."""
    block = max(block, before, after, 1)
    mine = F.floor(F.col("index") / block)
    at = F.col("index") - mine * block
    places = F.filter(F.array(F.struct(mine.alias("block"), F.lit(True).alias("own"), F.lit(True).alias("ok")), F.struct((mine + 1).alias("block"), F.lit(False).alias("own"), (at >= block - before).alias("ok")), F.struct((mine - 1).alias("block"), F.lit(False).alias("own"), ((at < after) & (mine > 0)).alias("ok"))), lambda p: p.ok)
    return rows.withColumn("_p", F.explode(places)).withColumns({"_block": F.col("_p.block"), "_own": F.col("_p.own")}).drop("_p")


def window() -> WindowSpec:
    return Window.partitionBy("symbol", "_block").orderBy("index")


def own(rows: DataFrame) -> DataFrame:
    return rows.where("_own").drop("_own", "_block")


def over_blocks(bars: DataFrame, columns: dict[str, Column], before: int, after: int) -> DataFrame:
    """Indexed bars with window columns made over :func:`window`, whose frames reach ``before`` back and ``after`` ahead."""
    return own(in_blocks(bars, before, after).withColumns(columns))


def previous(rows: DataFrame, keys: list[str], block: Column, order: list[str], columns: list[str], name: str = "_prev") -> DataFrame:
    """Adds the struct of ``columns`` of the row before in ``order`` of its ``keys`` (null for the first).

    ``block`` grows with the order. Rows look back within their block; the first of one gets the last row of the
    block before from a table with one row a block.
    """
    rows = rows.withColumn("_b", block)
    of = F.struct(*columns)
    inside = F.lag(of).over(Window.partitionBy(*keys, "_b").orderBy(*order))
    ends = rows.groupBy(*keys, "_b").agg(F.max_by(of, F.struct(*order)).alias("_end"))
    before = ends.select(*keys, "_b", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_b")).alias("_before"))
    return rows.withColumn(name, inside).join(before, [*keys, "_b"]).withColumn(name, F.coalesce(name, "_before")).drop("_b", "_before")


#: How a running value of a block joins that of all blocks before, by kind of aggregate.
_JOINED = {"sum": (F.sum, lambda a, b: a + b, 0), "max": (F.max, F.greatest, None), "product": (F.product, lambda a, b: a * b, 1.0)}


def running(rows: DataFrame, keys: list[str], block: Column, order: list[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds running aggregates up to each row: {name: ("sum", "max" or "product", column)}.

    They run within blocks, and over the table with one row a block.
    """
    rows = rows.withColumn("_b", block).withColumns({f"_v_{n}": c for n, (_, c) in values.items()})
    whole = rows.groupBy(*keys, "_b").agg(*(_JOINED[how][0](f"_v_{n}").alias(f"_t_{n}") for n, (how, _) in values.items()))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select(*keys, F.col("_b").alias("_b"), *(_JOINED[how][0](f"_t_{n}").over(before).alias(f"_o_{n}") for n, (how, _) in values.items()))
    upto = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: _JOINED[how][0](f"_v_{n}").over(upto) for n, (how, _) in values.items()}).join(offsets, [*keys, "_b"])
    for n, (how, _) in values.items():
        _, join, none = _JOINED[how]
        rows = rows.withColumn(n, join(F.col(n), F.col(f"_o_{n}")) if none is None else join(F.col(n), F.coalesce(f"_o_{n}", F.lit(none))))
    return rows.drop("_b", *(f"_{k}_{n}" for n in values for k in "vo"))
