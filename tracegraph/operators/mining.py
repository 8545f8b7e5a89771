"""State hypergraphs and frequent labelled paths and subtrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.iterate import cut


def state_nodes(steps: DataFrame) -> DataFrame:
    """id, state, occurrences of the states on either side of a step, and the solved state with 0."""
    sides = steps.select(F.col("before").alias("state")).union(steps.where("after <> 'no goals'").select("after"))
    nodes = sides.groupBy("state").agg(F.count("*").alias("occurrences")).select(T.state_id(F.col("state")).alias("id"), "state", "occurrences")
    solved = steps.sparkSession.createDataFrame([(T.NO_GOALS, "no goals", 0)], "id string, state string, occurrences long")
    return nodes.union(solved)


def hyperedges(steps: DataFrame) -> DataFrame:
    """input, head, outputs, theorems (how many), occurrences: unique on (input, head, sorted outputs)."""
    rows = steps.withColumn("outputs", F.array_sort(T.split_state(F.col("after"))))
    return rows.groupBy(F.col("before").alias("input"), "head", "outputs").agg(F.count_distinct("theorem").alias("theorems"), F.count("*").alias("occurrences"))


def text_bfs(spark: SparkSession, edges: DataFrame, starts: DataFrame, max_edges: int) -> DataFrame:
    """(start, node, depth) over text keys."""
    adjacency = cut(spark, edges.select("source", "target").distinct(), "or-edges")
    seen = cut(spark, starts.select("start", "node", F.lit(0).cast("long").alias("depth")), "or")
    front = seen
    for depth in range(1, max_edges + 1):
        step = front.join(adjacency, front.node == adjacency.source).select("start", F.col("target").alias("node")).distinct()
        front = cut(spark, step.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth).cast("long")), "or")
        seen = seen.unionByName(front)
    return seen


def _paths(steps: DataFrame, edges: int) -> DataFrame:
    """Runs of ``edges`` consecutive steps of a theorem, by lead over its order: no self-join."""
    w = Window.partitionBy("theorem").orderBy("idx")
    rows = steps.select("theorem", "idx", *[F.lead("head", k).over(w).alias(f"h{k}") for k in range(edges)])
    return rows.where(F.col(f"h{edges - 1}").isNotNull()).select("theorem", "idx", F.concat_ws(">", *[f"h{k}" for k in range(edges)]).alias("motif"))


def path_motifs(steps: DataFrame, edges: int) -> DataFrame:
    per = _paths(steps, edges).groupBy("motif", "theorem").agg(F.count("*").alias("n"))
    return per.groupBy("motif").agg(F.sum("n").alias("support"), F.count("*").alias("theorems"))


def path_examples(steps: DataFrame, edges: int, most: int) -> DataFrame:
    w = Window.partitionBy("motif").orderBy("theorem", "idx")
    return _paths(steps, edges).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).select("motif", "theorem", "idx")
