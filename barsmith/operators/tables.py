"""Tables that a plan reads several times, written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local session may lack it (tests); elsewhere the warehouse stands in."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return _OWN.setdefault("tmp", tempfile.mkdtemp(prefix="spark-shared-"))
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def kept(rows: DataFrame, name: str = "bars") -> DataFrame:
    """``rows`` written as Parquet and read again: it cuts the lineage, and a lost executor costs a re-read of files."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
