"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node around it."""
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.join(least, "u").where("v > u").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("v"), "m").union(least.select("a", "m"))
    return moved.where("v <> m").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).distinct()


def connected(spark: SparkSession, links: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) of every node in links (a, b): component is the least node reachable.

    The rounds grow with the logarithm of the longest path; each ends in a written table, so lineage
    stays short. No group of rows is ever collected, only minima per node.
    """
    edges = common.materialize(spark, links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = None
    while True:
        last = edges
        edges = common.materialize(spark, _small_star(_large_star(last)), name)
        common.forget(spark, last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    # now every edge leads from a node to its component's least node
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
