"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilefold.llm import common as C

#: Rounds of a graph of 2**60 nodes would be some 120; more mean a fault.
ROUNDS = 200


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v), root being the least node of its component.

    Each round hangs every larger neighbour of a node on the least one it knows (large star), then every smaller one
    (small star), until nothing changes; then all edges lead to a root. Stars are joins with one least neighbour a
    node, so a hub's edges can be dealt over many tasks. Each round is a table in the shared folder.
    """
    spark = edges.sparkSession
    now, path = C.stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(ROUNDS):
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before or not after[0]:
            break
        before = after
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, at = C.stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        C.remove(spark, path)
        now, path = after, at
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
