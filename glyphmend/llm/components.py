"""Connected components of an edge table, by alternating large and small stars.

Every round is two stars, each an aggregation and a join over the edges; lineage is cut by checkpoint().  A hub's
smallest neighbour comes from partial minima, so no task gathers a whole neighbourhood.  Edges go through as many
tasks as their number asks for: each shuffle leaves files for each of its tasks, and a round has several shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmend.llm.common import checkpointed


#: Edges that a task should write.
EDGES = 1 << 15


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("root", "node")), F.bit_xor(F.xxhash64("node", "root", F.lit(1)))).first())


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) for every node of edges (a, b), any comparable type.

    An empty edge table gives an empty result; self-loops give their node itself.
    """
    links = checkpointed(edges.select(F.least("a", "b").alias("root"), F.greatest("a", "b").alias("node")).distinct())
    seen = _signature(links)
    parts = 1 + seen[0] // EDGES
    links = links.coalesce(parts)
    for _ in range(max_rounds):
        # Large star: each larger neighbour of a node is linked to the node's smallest neighbour.
        both = links.select(F.col("node").alias("u"), F.col("root").alias("v")).union(links.select(F.col("root").alias("u"), F.col("node").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.col("u").alias("mu"), "m")
        large = both.join(least, F.col("u") == F.col("mu")).where("v >= u").select(F.col("m").alias("root"), F.col("v").alias("node"))
        large = large.union(least.select(F.col("m").alias("root"), F.col("mu").alias("node"))).coalesce(parts).distinct().coalesce(parts)
        # Small star: a node and all its smaller neighbours are linked to the smallest of them.
        small = large.groupBy("node").agg(F.min("root").alias("m")).select(F.col("node").alias("mn"), "m")
        links = checkpointed(
            large.join(small, F.col("node") == F.col("mn")).select(F.col("m").alias("root"), F.col("root").alias("node"))
            .union(small.select(F.col("m").alias("root"), F.col("mn").alias("node")))
            .coalesce(parts)
            .distinct()
            .coalesce(parts)
        )
        now = _signature(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return links.groupBy("node").agg(F.min("root").alias("root"))
