"""Connected components of an edge list, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.tables import stage


def _least(pairs: DataFrame) -> DataFrame:
    """Per node ``u`` of (u, v) rows the least of its neighbours and itself."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; the component is its
    least node.

    Alternates large-star and small-star until the edges stay the same: every
    node hangs on its least neighbour, so the rounds grow with the logarithm of
    the longest path. A node with very many neighbours is grouped map-side
    first and meets its own edges in a join that Spark can split. Each round is
    a written table. Loops and repeated or null edges are ignored; no edges
    give no rows.
    """
    now = stage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "edges"
    )
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.filter("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.filter("u > v").distinct(), "large-star")
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        now = stage(small.filter("u > v").distinct(), "small-star")
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
