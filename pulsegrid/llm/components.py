"""Connected components of an edge table by alternating large and small stars.

The two star steps are those of Kiveris et al., "Connected Components in MapReduce and Beyond"
(SoCC 2014). All of it is grouping with map-side minima and joins on node ids; nothing but one row
of totals per round reaches the driver, which decides between a broadcast and a shuffle of minima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.store import cut


#: Tables of so many rows of two longs are broadcast; larger ones are written out, so that a join reads both of its
#: sides dealt anew and adaptive execution can split a hub's rows.
SMALL_EDGES = 100_000


def _lowest(edges: DataFrame, small: bool) -> DataFrame:
    """The smallest neighbour of each node; at most two rows for each edge."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    return F.broadcast(low) if small else cut(low)


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = both.where("b > a").join(_lowest(both, small), "a")
    return met.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    low = _lowest(edges, small)
    linked = edges.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(low.select("a", F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another; component is the smallest node reachable.

    Edges are undirected and may repeat; loops and null ends are ignored. An empty table gives an empty one.
    """
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("a > b").distinct()
    now, before = cut(now), None
    while True:
        total = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(total) == before or not total[0]:
            break
        before = tuple(total)
        small = total[0] <= SMALL_EDGES
        now = cut(_small_star(_large_star(now, small), small))
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
