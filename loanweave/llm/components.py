"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.llm.common import joined_apart, saved


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame) -> DataFrame:
    """``a, m, degree``: each node's smallest neighbour and its number of neighbours, saved."""
    return saved(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree")))


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for each end of an edge (``a, b``), the root being the smallest node of its component.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest. Nodes are never gathered: the
    smallest neighbour is an aggregate that is joined back, to the edges of nodes with very many neighbours where these lie. Every
    round is written to the shared folder; rounds grow with the logarithm of the number of nodes.
    """
    edges = saved(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _sum(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = joined_apart(both, _least(both), "a", "degree", 2 * before[0]).filter("b > a")
        large = saved(large.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
        near = joined_apart(large, _least(large), "a", "degree", large.count())
        edges = saved(near.select("a", F.col("m").alias("b")).unionByName(near.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        after = _sum(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
