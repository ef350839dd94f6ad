"""Connected components of a graph given as links, by alternating star contractions.

Each round points every larger neighbour of a node at the node's smallest neighbour, and then every smaller one
(Kiveris, Lattanzi, Mirrokni, Rastogi, Vassilvitskii, "Connected Components in MapReduce and Beyond", 2014). Rounds
end when the links no longer change; every round is cut off through the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 60


def _smallest(links: DataFrame) -> DataFrame:
    """For links (u, v) between a node and its neighbours: (u, v, m), m the smallest of u and its neighbours.

    The smallest comes from an aggregation with partial sums and a join, which Spark can split, not from a list of
    neighbours: a node with a third of all links is no hot group.
    """
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return links.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is the smallest node reached.

    Links from a node to itself and repeated links are allowed; no links give an empty result.
    """
    links = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _smallest(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        links = materialize(small.where("u <> v").distinct())
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
