"""A stored adjacency for traversals: neighbours in chunks, dealt by (node, chunk), so that a hub is many keys.

The table is written once, bucketed by (node, chunk), and read by every level of a traversal: only the
frontier moves. A frontier row knows into how many chunks its node is cut, so it is copied to that many
keys and no key holds much more than a chunk of neighbours. Where no node has more than ``chunk``
neighbours nothing is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import cut, cut_by, forget
from .learning import ranked

#: Neighbours of a chunk, about.
CHUNK = 1024
#: A node is hot if it has more than this share of all edges; fewer than 1 / HOT_SHARE are.
HOT_SHARE = 1 / 1024


def _looked_up(rows: DataFrame, nodes: DataFrame, hot: DataFrame, column: str, **columns: str) -> DataFrame:
    """Left join with columns of ``nodes`` under other names; rows of hot nodes meet a broadcast and are not shuffled."""
    view = lambda t: t.select(F.col("node").alias(column), *[F.col(c).alias(out) for c, out in columns.items()])
    near = rows.join(F.broadcast(view(hot)), column)
    far = rows.join(F.broadcast(view(hot).select(column)), column, "left_anti").join(view(nodes), column, "left")
    return near.unionByName(far)


class Adjacency:
    """Neighbours of distinct edges (source, target), written; ``drop`` removes what was written.

    Where no node has more than ``chunk`` neighbours the table is (node, to), else (node, chunk, to, chunks)
    with the chunks of ``to``; a row an edge, bucketed by its key. ``written``: the edges are distinct and a written
    table already, so they are shuffled once only.
    """

    def __init__(self, spark: SparkSession, edges: DataFrame, chunk: int = CHUNK, written: bool = False):
        self.spark = spark
        e = edges.select(F.col("source").alias("node"), F.col("target").alias("to"))
        e = e if written else cut(spark, e.distinct(), "edges")
        hubs = e.groupBy("node").agg(F.count("*").alias("degree")).where(F.col("degree") > chunk)
        self.split = not hubs.isEmpty()
        if self.split:
            self.hubs = cut(spark, hubs.select("node", "degree", F.ceil(F.col("degree") / chunk).cast("int").alias("chunks")), "hubs")
            hot = self.hubs.where(F.col("degree") > e.count() * HOT_SHARE)
            parts = _looked_up(_looked_up(e, self.hubs, hot, "node", chunks="own"), self.hubs, hot, "to", chunks="chunks")
            self.table = cut_by(spark, parts.select("node", F.pmod(F.xxhash64("to"), F.coalesce("own", F.lit(1))).cast("int").alias("chunk"), "to", F.coalesce("chunks", F.lit(1)).alias("chunks")), ["node", "chunk"], "adjacency")
        else:
            self.table = cut_by(spark, e, ["node"], "adjacency")
        if not written:
            forget(spark, e)

    def start(self, nodes: DataFrame) -> DataFrame:
        """Rows with a column ``node``, plus ``chunks``: how many keys they are copied to."""
        if not self.split:
            return nodes.withColumn("chunks", F.lit(1))
        return nodes.join(self.hubs.select("node", "chunks"), "node", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))

    def expand(self, frontier: DataFrame, *kept: Column | str) -> DataFrame:
        """``kept``, to, chunks (of ``to``): a row for each neighbour of each frontier row (node, chunks, ...)."""
        if not self.split:
            return frontier.drop("chunks").join(self.table, "node").select(*kept, "to", F.lit(1).alias("chunks"))
        copies = frontier.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        return copies.join(self.table, ["node", "chunk"]).select(*kept, "to", "chunks")

    def drop(self) -> None:
        forget(self.spark, self.table, *([self.hubs] if self.split else []))


def indexed(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, pos, to, degree, to_degree of distinct edges (source, target): ``pos`` counts a node's neighbours in order from 0.

    Places come from one shuffle by ranges of (node, to), so a hub's edges lie in many tasks; the written
    table has a row an edge, so any neighbour is found by (node, pos) without a list.
    """
    e = edges.select(F.col("source").alias("node"), F.col("target").alias("to")).distinct()
    order = cut(spark, ranked(e, ["node", "to"], "rank"), "ranked")
    nodes = cut(spark, order.groupBy("node").agg(F.min("rank").alias("first"), F.count("*").alias("degree")), "degrees")
    hot = nodes.where(F.col("degree") > order.count() * HOT_SHARE)
    placed = _looked_up(order, nodes, hot, "node", first="first", degree="degree")
    out = _looked_up(placed, nodes, hot, "to", degree="to_degree")
    out = cut(spark, out.select("node", (F.col("rank") - F.col("first")).alias("pos"), "to", "degree", F.coalesce("to_degree", F.lit(0)).alias("to_degree")), "indexed")
    forget(spark, order, nodes)
    return out
