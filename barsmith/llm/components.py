"""Connected components of an edge table, by randomised contraction.

In each round every node moves to the neighbour (or itself) that comes first in a random order drawn
anew, and edges are relabelled; a constant part of the nodes goes each round whatever the graph looks
like, so long chains and hubs need about log(n) rounds. Edges and moves are tables in the shared
folder; nothing but the question whether edges are left reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(u, v) bigint -> (node, root) for each node of an edge between two nodes; root is a node of its component.

    Loops and repeated edges do no harm. An edge table without edges gives an empty result.
    """
    first = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    left, moves = first, []
    while not left.isEmpty():
        both = left.select("u", "v").union(left.select("v", "u"))
        rank = lambda c, k=len(moves): F.struct(F.xxhash64(F.lit(k), c).alias("h"), c.alias("n"))
        best = both.groupBy("u").agg(F.min(rank(F.col("v"))).alias("best"))
        move = written(best.where(F.col("best") < rank(F.col("u"))).select(F.col("u").alias("node"), F.col("best.n").alias("to")), "moves")
        moves.append(move)
        for end in ("u", "v"):
            left = left.join(move.withColumnsRenamed({"node": end}), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        left = written(left.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    nodes = first.select(F.col("u").alias("node")).union(first.select("v")).distinct().withColumn("root", F.col("node"))
    for move in moves:
        nodes = nodes.join(move.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return nodes
