"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.session import stage


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least neighbour of u."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).filter("v > u").select(
        F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the least of them."""
    least = _least(edges)
    return least.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Least node reachable from each node that has a link: columns `node` and `component`.

    `links` are pairs (u, v) of longs in any order. Every round is written to the shared folder;
    rounds grow with the logarithm of the number of nodes, and joins on a node's neighbours are
    plain joins whose skewed sides can be split.
    """
    edges = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(
        "u != v").distinct(), "edges")

    def state(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 24))).first())

    before = state(edges)
    while True:
        edges = stage(_small_star(_large_star(edges)), "edges")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
