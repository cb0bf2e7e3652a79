"""Vendor rows to clean bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.functions.numbers import finite
from barsmith.functions.time import unit_to_ms
from barsmith.operators.blocks import BLOCK, previous

#: Names of fields, the preferred one first.
ALIASES = {"time": ("time", "timestamp", "t", "date"), "open": ("open", "o"), "high": ("high", "h"), "low": ("low", "l"), "close": ("close", "c"), "volume": ("volume", "v")}
PRICES = ("open", "high", "low", "close")
#: Keys under which vendors put their list, in order of preference.
ENVELOPES = ("bars", "data", "results", "candles", "ohlcv")


def field(record: Column, names: tuple[str, ...]) -> Column:
    """The value of the first key that is present in a map, even if that value is null."""
    found = F.lit(None).cast("string")
    for name in reversed(names):
        found = F.when(F.map_contains_key(record, F.lit(name)), F.try_element_at(record, F.lit(name))).otherwise(found)
    return found


def from_maps(rows: DataFrame, record: str = "record") -> DataFrame:
    """A map<string,string> column to the seven raw columns; volume defaults to absent."""
    return rows.select("symbol", "ingest_seq", *(field(F.col(record), names).alias(name) for name, names in ALIASES.items()))


def from_lists(rows: DataFrame, record: str = "record") -> DataFrame:
    """An array [time, open, high, low, close(, volume)] to the raw columns; shorter ones give nulls, five items a volume of 0."""
    item = lambda i: F.when(F.size(record) >= 5, F.get(F.col(record), F.lit(i)))
    volume = F.when(F.size(record) > 5, item(5)).otherwise(F.lit("0"))
    return rows.select("symbol", "ingest_seq", *(item(i).alias(c) for i, c in enumerate(("time", *PRICES))), volume.alias("volume"))


def _lean(text: Column) -> Column:
    return F.ltrim(text, F.lit(" \t\r\n"))


def records(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Vendor JSON to (symbol, ingest_seq, record): each record's JSON text, in the order sent.

    A payload is a bare list, a list under a known key (the first that holds one), or columns t, o, h, l, c, v of
    equal length (without v, a volume of 0). Any other payload gives no rows.
    """
    text = F.col(payload)
    found = [text, *(F.get_json_object(text, f"$.{k}") for k in ENVELOPES)]
    listed = [F.when(F.startswith(_lean(c), F.lit("[")), F.from_json(c, "array<string>")) for c in found]
    lists = [F.from_json(F.get_json_object(text, f"$.{k}"), "array<string>") for k in "tohlcv"]
    zeros = F.transform(lists[0], lambda _: F.lit("0"))
    zipped = F.arrays_zip(*(c.alias(k) for c, k in zip([*lists[:5], F.when(F.size(lists[5]) > 0, lists[5]).otherwise(zeros)], "tohlcv")))
    columnar = F.transform(zipped, lambda z: F.to_json(F.create_map(*(x for k in "tohlcv" for x in (F.lit(k), z[k])))))
    every = F.coalesce(*listed, F.when(lists[0].isNotNull(), columnar))
    return rows.select("symbol", F.posexplode(every).alias("ingest_seq", "record"))


def unwrap(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """The records of vendor JSON that are objects: (symbol, ingest_seq, record map)."""
    found = records(rows, payload).where(F.startswith(_lean(F.col("record")), F.lit("{")))
    return found.select("symbol", "ingest_seq", F.from_json("record", "map<string,string>").alias("record"))


def from_payloads(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Vendor JSON to raw columns, whether its records are objects or lists; other records give null prices."""
    found = records(rows, payload)
    listed = F.startswith(_lean(F.col("record")), F.lit("["))
    lists = from_lists(found.where(listed).withColumn("record", F.from_json("record", "array<string>")))
    maps = from_maps(found.where(F.coalesce(~listed, F.lit(True))).withColumn("record", F.coalesce(F.from_json("record", "map<string,string>"), F.create_map().cast("map<string,string>"))))
    return maps.unionByName(lists)


def normalize(raw: DataFrame) -> DataFrame:
    """Clean bars of (symbol, ingest_seq, time, open, high, low, close, volume) rows of any type.

    Dropped: unreadable times or prices, prices not above zero. Volume: null or negative becomes 0. High and
    low are widened to hold all four prices. Of several rows of one time the last to arrive stays.
    """
    rows = _marked(raw).where("reason is null")
    w = Window.partitionBy("symbol", "time").orderBy(F.desc("ingest_seq"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("symbol", "time", "open", F.col("top").alias("high"), F.col("bottom").alias("low"), "close", "volume")


def _marked(raw: DataFrame) -> DataFrame:
    rows = raw.select("symbol", "ingest_seq", unit_to_ms(finite(F.col("time"))).alias("time"), *(finite(F.col(c)).alias(c) for c in (*PRICES, "volume")))
    bad = F.col("time").isNull() | F.greatest(*(F.when(F.col(c) > 0, 0).otherwise(1) for c in PRICES)).cast("boolean")
    rows = rows.withColumns({"reason": F.when(bad, F.lit("malformed")), "no_volume": F.col("volume").isNull(), "volume": F.greatest(F.coalesce("volume", F.lit(0.0)), F.lit(0.0)), "top": F.greatest(*PRICES), "bottom": F.least(*PRICES)})
    return rows.withColumn("repaired", F.col("reason").isNull() & ((F.col("high") != F.col("top")) | (F.col("low") != F.col("bottom"))))


def report(raw: DataFrame) -> DataFrame:
    """One row a symbol: received, kept, malformed, duplicate, reordered, repaired, missing_volume."""
    rows = _marked(raw)
    good = F.col("reason").isNull()
    near = previous(rows.where(good), ["symbol"], F.floor(F.col("ingest_seq") / BLOCK), ["ingest_seq"], ["time"])
    order = near.groupBy("symbol").agg(F.max(F.coalesce(F.col("time") < F.col("_prev.time"), F.lit(False))).alias("reordered"))
    kept = rows.where(good).select("symbol", "time").distinct().groupBy("symbol").agg(F.count(F.lit(1)).alias("kept"))
    counts = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("received"), F.count_if(~good).alias("malformed"), F.count_if(F.col("repaired")).alias("repaired"), F.count_if(good & F.col("no_volume")).alias("missing_volume"))
    out = counts.join(kept, "symbol", "left").join(order, "symbol", "left").withColumn("kept", F.coalesce("kept", F.lit(0)).cast("bigint"))
    return out.select("symbol", "received", "kept", "malformed", (F.col("received") - F.col("malformed") - F.col("kept")).alias("duplicate"), F.coalesce("reordered", F.lit(False)).alias("reordered"), "repaired", "missing_volume")
