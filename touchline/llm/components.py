"""Connected components of links by alternating large and small stars; each round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, passing


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """Links each node's neighbours (large stars: those above it; small stars: those below) to its least neighbour."""
    near = edges.select("a", "b")
    if both:
        near = near.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    out = near.join(least, "a")  # a node with very many neighbours is split by the join
    if both:
        out = out.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, component (the least id reachable) of every node of edges(a, b); nodes without a link to another have no row."""
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    with passing(edges.sparkSession) as stays:
        edges = kept(edges, "links")
        before = _state(edges)
        while before[0]:
            edges = kept(_stars(_stars(edges, True), False), "links")
            now = _state(edges)
            if now == before:
                break
            before = now
        stays(edges)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
