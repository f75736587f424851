"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import stored


def _with_minimum(edges: DataFrame, minima: DataFrame) -> DataFrame:
    """Join each edge (u, v) with the minimum m of u. The minima are a stored table, so that both sides of the join are plain
    shuffles and the edges of a hub can be split."""
    return edges.join(stored(minima, "minima"), "u")


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    minima = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_minimum(both.filter("v > u"), minima).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    minima = edges.groupBy("u").agg(F.min("v").alias("m"))
    to_smallest = minima.select("u", F.col("m").alias("v"))
    others = _with_minimum(edges, minima).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(to_smallest).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the component is its smallest node.

    Nodes without a link are absent; repeated links, loops and null ends are ignored; no links give no rows. Each round is
    written to the shared folder, so a lost executor costs one round. Only a count and a checksum reach the driver.
    """
    edges = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    while (now := _state(edges)) != before:
        before = now
        edges = stored(small_star(stored(large_star(edges), "large-star")), "small-star")
    hubs = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(hubs)
