"""Trace, graph and feature tables derived from the driver's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .iterate import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tactics(spark: SparkSession, sf: str) -> DataFrame:
    """One row per tactic: theorem, idx, head, premise, ord."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("theorem"), (F.row_number().over(w) - 1).cast("long").alias("idx"), F.col("event_type").alias("head"), F.get_json_object("props", "$.k").cast("long").alias("premise"), F.col("event_id").alias("ord"))


def categories(spark: SparkSession, sf: str) -> DataFrame:
    """name, category of theorems: the region of the customer of that key."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("c_custkey").alias("name"), F.col("r_name").alias("category"))


def succession(spark: SparkSession, sf: str) -> DataFrame:
    """source, target: parts that follow each other within an order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("source"), F.lead("l_partkey").over(w).alias("target")).where("target is not null")


def arcs(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct edges of ``succession``, written."""
    return cut(spark, succession(spark, sf).distinct(), "arcs")


def states(spark: SparkSession, sf: str) -> DataFrame:
    """theorem, idx, head, before, after: the state of a step and of the next; the last leads to no goals."""
    t = tactics(spark, sf)
    state = F.concat("head", F.lit(":"), (F.col("premise") % 20).cast("string"))
    w = Window.partitionBy("theorem").orderBy("idx")
    return t.withColumn("before", state).withColumn("after", F.coalesce(F.lead("before").over(w), F.lit("no goals"))).select("theorem", "idx", "head", "before", "after", "ord")


def hyper(spark: SparkSession, sf: str) -> DataFrame:
    """theorem, idx, ord, tactic, input, outputs: a step leads from one state to none (no goals), one or two others.

    States are S00 to S99; what a tactic leaves depends on the state and on the tactic, so that states
    have alternatives (OR) and steps with two outputs (AND).
    """
    k, n = F.col("premise"), F.length("head")
    name = lambda x: F.format_string("S%02d", x % 100)
    one, two = name(7 * k + 3 * n), F.array(name(3 * k + n + 1), name(5 * k + 2))
    outputs = F.when((k + n) % 3 == 0, F.array(F.lit("no goals"))).when((k + n) % 3 == 1, F.array(one)).otherwise(two)
    return tactics(spark, sf).select("theorem", "idx", "ord", F.col("head").alias("tactic"), name(k).alias("input"), outputs.alias("outputs"))


def dag(spark: SparkSession, sf: str) -> DataFrame:
    """source < target: parts ordered together at least twice."""
    p = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    q = p.withColumnRenamed("l_partkey", "other")
    return p.join(q, "l_orderkey").where("l_partkey < other").groupBy(F.col("l_partkey").alias("source"), F.col("other").alias("target")).agg(F.count("*").alias("w")).where("w >= 2")


def tree(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as labelled branching edges: line number n of an order leads from node n to 2n and 2n + 1."""
    w = Window.partitionBy("theorem").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")  # by the name, so groups by it need no other shuffle
    at, none = F.col("l_linenumber").cast("long"), F.array().cast("array<string>")
    label = F.struct(F.lit("structural").alias("kind"), F.col("l_returnflag").alias("head"), none.alias("lemma_tuple"), none.alias("direction_tuple"))
    lines = table(spark, sf, "lineitem").withColumn("theorem", F.col("l_orderkey").cast("string"))
    return lines.select("theorem", F.col("theorem").alias("file_path"), F.format_string("%05d", F.row_number().over(w)).alias("edge"), at.cast("string").alias("in_node"), F.array((2 * at).cast("string"), (2 * at + 1).cast("string")).alias("out_nodes"), label.alias("label"))


def traces(spark: SparkSession, sf: str) -> DataFrame:
    """Events as traced theorems: a tactic leaves k % 3 goals and uses premise k; one row per user."""
    goals = F.col("premise") % 3
    after = F.when(goals == 0, "no goals").when(goals == 1, "⊢ a").otherwise("case l\n⊢ a\n\ncase r\n⊢ b")
    path = F.concat(F.lit("Mathlib/A"), (F.col("premise") % 7).cast("string"), F.lit("/X.lean"))
    premise = F.struct(F.concat(F.lit("P"), F.col("premise").cast("string")).alias("full_name"), path.alias("def_path"))
    tactic = F.struct(F.col("head").alias("tactic"), F.lit("⊢ a").alias("state_before"), after.alias("state_after"), F.struct(F.col("head").alias("text"), F.array(premise).alias("premises")).alias("annotated_tactic"))
    t = tactics(spark, sf).select("theorem", F.struct("idx", tactic.alias("t")).alias("step")).groupBy("theorem").agg(F.transform(F.array_sort(F.collect_list("step")), lambda x: x["t"]).alias("traced_tactics"))
    return t.select(F.concat(F.lit("T"), F.col("theorem").cast("string")).alias("full_name"), F.lit("Mathlib/Users/X.lean").alias("file_path"), F.lit("train").alias("split"), F.col("theorem").alias("ordinal"), "traced_tactics")


TAC = """tac AS (SELECT user_id AS theorem, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
 event_type AS head, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS premise, event_id AS ord FROM events)"""
CAT = "cat AS (SELECT c_custkey AS name, r_name AS category FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
SUC = """suc AS (SELECT source, target FROM (SELECT l_partkey AS source, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS target FROM lineitem) x WHERE target IS NOT NULL)"""
STA = f"""{TAC}, sta AS (SELECT theorem, idx, head, before, coalesce(lead(before) OVER (PARTITION BY theorem ORDER BY idx), 'no goals') AS after, ord
 FROM (SELECT *, head || ':' || CAST(premise % 20 AS VARCHAR) AS before FROM tac) x)"""
DAG = """lp AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), dag AS (SELECT a.l_partkey AS source, b.l_partkey AS target, count(*) AS w
 FROM lp a JOIN lp b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(*) >= 2)"""
TRE = """tre AS (SELECT l_orderkey AS theorem, CAST(l_linenumber AS BIGINT) AS pos, l_returnflag AS label,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS edge FROM lineitem)"""
HYP = f"""{TAC}, hyp AS (SELECT theorem, idx, ord, head AS tactic, printf('S%02d', premise % 100) AS input, CASE (premise + length(head)) % 3 WHEN 0 THEN ['no goals']
 WHEN 1 THEN [printf('S%02d', (7 * premise + 3 * length(head)) % 100)] ELSE [printf('S%02d', (3 * premise + length(head) + 1) % 100), printf('S%02d', (5 * premise + 2) % 100)] END AS outputs FROM tac)"""
