"""Connected components by DataFrame joins: large-star and small-star steps until the edges are stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u > v). Large: every neighbour above u is tied to the least of u's neighbours and u itself. Small: every
    neighbour below u, and u, is tied to the least of them. Only the least neighbour is aggregated, so that a hot
    vertex is summed map-side, and the join back can be split by adaptive execution."""
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = around.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether edges (u > v) are stars around their least vertices: each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) of every vertex of an edge; component is the smallest vertex that can be reached.

    Nulls and loops are ignored; repeated and reversed edges count once; no edges give no rows. The number of rounds
    grows with the logarithm of the longest path. Only counts come to the driver. Once a round leaves as many edges as it
    found, they may be stars, which no more rounds would change."""
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = materialize(edges, "cc")
    last = edges.count()
    while last:
        edges = materialize(_star(_star(edges, True), False), "cc")
        now = edges.count()
        if now == last and _settled(edges):
            break
        last = now
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    )
