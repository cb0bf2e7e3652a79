"""Instruments, and which of several sources counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Symbol, name, tick, price digits, exchange zone.
INSTRUMENTS = (
    ("ES", "E-mini S&P 500", 0.25, 2, "America/Chicago"),
    ("NQ", "E-mini Nasdaq 100", 0.25, 2, "America/Chicago"),
    ("YM", "E-mini Dow", 1.0, 0, "America/Chicago"),
)
SCHEMA = "symbol string, name string, tick double, digits int, zone string"


def instruments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(INSTRUMENTS), SCHEMA)


def instrument(symbol: str) -> tuple:
    """One instrument by symbol in any case; KeyError if it is unknown."""
    wanted = symbol.strip().upper()
    for row in INSTRUMENTS:
        if row[0] == wanted:
            return row
    raise KeyError(f"unknown symbol {symbol!r}")


def with_instruments(rows: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Rows with what is known of their instrument, by symbol in any case and with blanks around it; ``known`` is false for others."""
    table = instruments(rows.sparkSession).withColumnRenamed("symbol", "_symbol").withColumn("known", F.lit(True))
    wanted = F.upper(F.trim(F.col(symbol)))
    return rows.join(F.broadcast(table), wanted == F.col("_symbol"), "left").drop("_symbol").withColumn("known", F.coalesce("known", F.lit(False)))


def by_priority(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows that several sources give for one key, that of the source with the smallest ``priority``."""
    w = Window.partitionBy(*keys).orderBy("priority")
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def quality(failed, fetched, own):
    """``partial`` if a gap failed, ``cached`` if nothing was fetched, else the source's own word."""
    return F.when(failed, "partial").when(~fetched, "cached").otherwise(own)
