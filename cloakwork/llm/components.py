"""Connected components of a graph given as edges, in Spark: alternating large-star and small-star rounds.

A round lets every node point its larger neighbours, then its smaller ones, at its smallest neighbour; the graph of a component ends as a star
around its smallest node. Minima come from grouped aggregates and joins that Spark can split at hot keys; no neighbourhood
is ever gathered into a list, and nothing is collected. Every round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame) -> DataFrame:
    """edges (u, v), both directions wanted: the smallest of u and its neighbours for each u, joined to each edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    # the key is an expression, so that both sides are dealt out for the join alone: Spark can then split a node that most edges meet at
    return edges.join(least, edges["u"] == F.greatest(least["c"], least["c"])).select("u", "v", "m")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node that has an edge to another, and the smallest node of its component. Null ends and loops don't count."""
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "edges")
    mark = None
    while True:  # every round that changes an edge lowers one of its ends, so the rounds come to an end
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the edge from each node to its own minimum, so that no node gets lost
        small_in = large.union(both.groupBy("u").agg(F.min("v").alias("v")).filter("v < u")).filter("u != v").distinct()
        down = small_in.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _star(down)
        e = stored(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
