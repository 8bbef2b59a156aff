"""Connected components of a graph of links, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactspark.llm.common import stored


def _pointed(edges: DataFrame) -> DataFrame:
    """Each link once, from the larger end to the smaller."""
    return edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Lead every larger neighbour of a node to the node's least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
    return larger.join(least, "u").select(F.col("w").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Lead a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    lead = edges.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return lead.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Map every linked node to the smallest node it can reach: node, root.

    Alternates two steps until every link leads straight to a root; each is a
    minimum per node and a join of links with those minima (one row per node),
    so a node with very many links is split like any skewed join. The links of
    each round are written to the shared folder.
    """
    edges = stored(_pointed(links.select(F.col(a).alias("a"), F.col(b).alias("b"))), "links")
    while True:
        after = stored(_pointed(_small_star(_pointed(_large_star(edges)))), "links")
        # done when every node has one link and no root has any
        links_of = after.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("nodes")).first()
        if links_of["n"] == links_of["nodes"]:
            roots = after.select(F.col("v").alias("r")).distinct()
            if after.join(roots, after["u"] == roots["r"], "left_semi").isEmpty():
                return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = after
