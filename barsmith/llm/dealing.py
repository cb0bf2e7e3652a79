"""Groups of which pairs must meet, dealt out so that no task holds more than two chunks of one.

Pairs within one class need not meet, as they are linked already. So a class with many rows in a group has
chunks of its own, which meet all other chunks of the group but not each other: a dense group of near
copies costs a number of rows in proportion to it, not to its square.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def meetings(rows: DataFrame, group: list[str], item: str, chunk: int) -> DataFrame:
    """Adds ``meet`` to (group, class, item): rows of one group with one ``meet`` belong in one task.

    A row is repeated for each chunk that its own chunk meets. Groups of one row, or of one class, are left out.
    """
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), (F.min("class") != F.max("class")).alias("_open")).where("_open").drop("_open")
    rows = rows.join(sizes, group)
    heavy = rows.where(F.col("_n") > chunk).groupBy(*group, "class").agg(F.count(F.lit(1)).alias("_c"))
    # the chunks of a group: first those of small classes together, then those of each large one
    own = F.col("_c") > chunk // 2
    kinds = heavy.withColumn("_big", F.when(own, F.col("class"))).groupBy(*group, "_big").agg(F.ceil(F.sum("_c") / chunk).cast("int").alias("_k"))
    order = Window.partitionBy(*group).orderBy(F.asc_nulls_first("_big"))
    kinds = kinds.withColumns({"_first": (F.sum("_k").over(order) - F.col("_k")).cast("int"), "_all": F.sum("_k").over(Window.partitionBy(*group)).cast("int")})
    big = heavy.where(own).select(*group, "class", F.col("class").alias("_big"))
    light = rows.where(F.col("_n") <= chunk).drop("_n").withColumn("meet", F.lit(0).cast("bigint"))
    parted = rows.where(F.col("_n") > chunk).drop("_n").join(big, [*group, "class"], "left").alias("r")
    same = F.lit(True)
    for c in group:
        same = same & (F.col(f"r.{c}") == F.col(f"k.{c}"))
    parted = parted.join(kinds.alias("k"), same & F.col("r._big").eqNullSafe(F.col("k._big"))).select("r.*", "_k", "_first", "_all")
    parted = parted.withColumn("_at", F.col("_first") + F.pmod(F.xxhash64(item), F.col("_k")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("_all") - 1), lambda j: F.when(F.col("_big").isNull(), j != F.col("_at")).otherwise((j < F.col("_first")) | (j >= F.col("_first") + F.col("_k"))))
    pair = lambda j: F.least(j, F.col("_at")).cast("bigint") * F.col("_all") + F.greatest(j, F.col("_at"))
    alone = F.when(F.col("_all") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.transform(others, pair))
    parted = parted.withColumn("meet", F.explode(alone)).drop("_big", "_k", "_first", "_all", "_at")
    return light.unionByName(parted)
