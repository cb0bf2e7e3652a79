"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.operators.tables import kept as written

#: ASCII white space: the separators between words wherever a contract speaks of words.
WORD = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod(column: Column, modulus: int) -> Column:
    """``crc32(column as text) mod modulus``: the fold rule of the two classifiers."""
    return F.crc32(F.encode(column.cast("string"), "UTF-8")) % modulus


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


__all__ = ["WORD", "crc32_mod", "partitions", "table", "written"]
