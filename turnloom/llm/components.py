"""Connected components by large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each step is a grouped minimum, combined
before the shuffle, and a join back to the edges; no neighbourhood is ever gathered. The edges are written to the
shared folder after each round, and those of the round before deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import drop_staged, staged


def _star(edges: DataFrame) -> DataFrame:
    """Point what lies above (large star) or is (small star, edges already directed downwards) at the least neighbour."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    starred = _star(both).where("v > u")
    return starred.select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    starred = _star(down)
    own = starred.select("u", F.col("m").alias("v"))
    return own.union(starred.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """For links (a, b) of nodes of any ordered type: node, comp (the least node of its component).

    Nodes without links don't occur. An empty table gives an empty result.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges, mark = staged(edges, "edges"), None
    while True:
        before, edges = edges, staged(_small(_large(edges)), "edges")
        drop_staged(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
