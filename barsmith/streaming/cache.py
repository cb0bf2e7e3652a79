"""A tick stream that keeps the bar cache up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barsmith.functions.intervals import LENGTH
from barsmith.operators.store import Store
from barsmith.operators.tables import kept
from barsmith.streaming.bars import stream_bars

#: Spark's words for the length of an interval.
WINDOWS = {"5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour"}


def absorb(store: Store, changed: DataFrame, batch: int, interval: str, provider: str = "stream") -> None:
    """Writes the bars that a micro-batch changed, and records what of them is settled.

    Bars carry the number of their batch as the time of their fetch, so a batch that is played again writes what it wrote
    before, and one that is older than what is there changes nothing. Coverage goes on from where it ended, to two bars
    before the newest one; those two, and any bar that a late tick changes, are written again when they change.
    """
    changed = kept(changed, "changed")
    if changed.isEmpty():
        return
    store.save_candles(changed.withColumns({"interval": F.lit(interval), "provider": F.lit(provider), "fetched_at": F.lit(batch).cast("bigint")}))
    ends = changed.groupBy("symbol").agg(F.min("time").alias("first"), F.max("time").alias("last"))
    done = store.coverage().where(F.col("interval") == interval).groupBy("symbol").agg(F.max("end").alias("upto"))
    step = LENGTH[interval]
    ranges = ends.join(done, "symbol", "left").select("symbol", F.lit(interval).alias("interval"), F.least(F.coalesce("upto", "first"), "first").alias("start"), (F.col("last") - step - 1).alias("end"))
    store.record_coverage(kept(ranges.where("start <= end"), "settled"))


def into_cache(store: Store, ticks: DataFrame, interval: str, state: str, late: str = "2 hours", **trigger) -> StreamingQuery:
    """Starts the stream of (symbol, ts, seq, price) into the cache; ``state`` is its checkpoint folder.

    Bars are written as they form, each micro-batch in one write of the folders that it touches. Ticks later than ``late`` are lost.
    """
    bars = stream_bars(ticks, WINDOWS[interval], late)
    write = bars.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(lambda rows, batch: absorb(store, rows, batch, interval))
    return (write.trigger(**trigger) if trigger else write).start()
