"""Searches on state hypergraphs: OR paths with meeting points, AND/OR discharge with proofs, sampled pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.iterate import cut, forget
from .adjacency import Adjacency
from .graphs import bfs

#: The state without goals: what a finishing tactic leads to.
DONE = "no goals"


def hyperedges(steps: DataFrame) -> DataFrame:
    """input, tactic, outputs, theorems, occurrences: unique by (input, tactic, sorted outputs).

    outputs keep the order of the first sighting; theorems are distinct, by first sighting. steps:
    (theorem, ord, tactic, input, outputs).
    """
    per = steps.groupBy("input", "tactic", F.array_sort("outputs").alias("key"), "theorem").agg(F.min("ord").alias("seen"), F.min_by("outputs", "ord").alias("outputs"), F.count("*").alias("n"))
    edges = per.groupBy("input", "tactic", "key").agg(F.min_by("outputs", "seen").alias("outputs"), F.transform(F.array_sort(F.collect_list(F.struct("seen", "theorem"))), lambda x: x["theorem"]).alias("theorems"), F.sum("n").alias("occurrences"))
    return edges.drop("key")


def or_edges(edges: DataFrame) -> DataFrame:
    """(source, target): any output of a hyperedge can be gone on with."""
    return edges.select(F.col("input").alias("source"), F.explode("outputs").alias("target")).distinct()


def preference() -> tuple[Column, ...]:
    """Order of hyperedges: fewest outputs, most often seen, then by text."""
    return F.size("outputs"), -F.col("occurrences"), F.col("tactic"), F.concat_ws("|", "outputs")


def _turned(arcs: DataFrame) -> DataFrame:
    return arcs.select(F.col("target").alias("source"), F.col("source").alias("target"))


class _Side:
    """One end of a search from both ends: the levels reached so far for each key (a start or a target)."""

    def __init__(self, spark: SparkSession, arcs: DataFrame, pairs: DataFrame, key: str):
        self.spark, self.key, self.around = spark, key, Adjacency(spark, arcs, written=True)
        self.levels = [cut(spark, self.around.start(pairs.select(key, F.col(key).alias("node")).distinct()), "ends")]
        self.rows = self.levels[0].count()

    def grow(self, pairs: DataFrame) -> None:
        """One more level, from the newest one's rows of keys that still have an open pair."""
        step = self.around.expand(self.levels[-1].join(pairs.select(self.key).distinct(), self.key, "left_semi"), self.key).groupBy(self.key, F.col("to").alias("node")).agg(F.first("chunks").alias("chunks"))
        seen = reduce(DataFrame.unionByName, [level.select(self.key, "node") for level in self.levels])
        self.levels.append(cut(self.spark, step.join(seen, [self.key, "node"], "left_anti"), "ends"))
        self.rows = self.levels[-1].count()

    def through(self, rows: DataFrame, level: DataFrame, key: str) -> DataFrame:
        """The pairs' nodes moved one arc on, to those that stand in ``level`` of the pair's ``key``."""
        moved = self.around.expand(self.around.start(rows), "start", "target").withColumnRenamed("to", "node").select("start", "target", "node")
        return moved.join(level.select(key, "node"), [key, "node"], "left_semi").distinct()


def or_paths(spark: SparkSession, edges: DataFrame, pairs: DataFrame, max_depth: int, rows: list[int] | None = None) -> DataFrame:
    """start, target, found, depth, meet of each distinct pair (start, target).

    depth is the length of a shortest OR path of at most ``max_depth`` steps, else -1. meet is the least
    state in its middle: depth / 2 steps, rounded up, from the start. Levels are searched from all starts
    and all targets together; each round grows the side whose newest level has fewer rows. A pair leaves
    as soon as its sides meet, and a start or target without open pairs is not gone on from; the search
    ends when no pair is open or a side has nothing left. ``rows`` collects the rows of each new level.
    """
    arcs = cut(spark, or_edges(edges), "or-edges")
    out = arc_paths(spark, arcs, pairs, max_depth, rows)
    forget(spark, arcs)
    return out


def arc_paths(spark: SparkSession, arcs: DataFrame, pairs: DataFrame, max_depth: int, rows: list[int] | None = None) -> DataFrame:
    """``or_paths`` on distinct arcs (source, target), a written table: only what lies around the pairs' ends is visited."""
    pairs = cut(spark, pairs.select("start", "target").distinct(), "or-pairs")
    ahead, back = _Side(spark, arcs, pairs, "start"), _Side(spark, _turned(arcs), pairs, "target")
    still, met, rounds = pairs.where("start <> target"), [pairs.where("start = target").select("start", "target", F.lit(0).cast("long").alias("depth"), F.col("start").alias("node"))], []
    for depth in range(1, max_depth + 1):
        side = ahead if ahead.rows <= back.rows else back
        side.grow(still)
        if rows is not None:
            rows.append(side.rows)
        if not side.rows:  # no open pair can be gone on with
            break
        common = still.join(ahead.levels[-1].select("start", "node"), "start").join(back.levels[-1].select("target", "node"), ["target", "node"])
        state = cut(spark, still.join(common, ["start", "target"], "left"), "met")  # a pair that stays open has one row, without a node
        rounds.append(state)
        some = state.agg(F.count("node").alias("met"), F.count_if(F.col("node").isNull()).alias("open")).first()
        still = state.where("node is null").select("start", "target")
        if some.met:
            middle, at = state.where("node is not null"), len(ahead.levels) - 1
            while at > (depth + 1) // 2:  # back along the levels ahead
                at -= 1
                middle = back.through(middle, ahead.levels[at], "start")
            while at < (depth + 1) // 2:  # on along the levels back from the target
                at += 1
                middle = ahead.through(middle, back.levels[depth - at], "target")
            met.append(middle.groupBy("start", "target").agg(F.min("node").alias("node")).select("start", "target", F.lit(depth).cast("long").alias("depth"), "node"))
        if not some.open:
            break
    out = cut(spark, pairs.join(reduce(DataFrame.unionByName, met), ["start", "target"], "left"), "or-paths")
    ahead.around.drop()
    back.around.drop()
    forget(spark, *ahead.levels, *back.levels, *rounds)
    return out.select("start", "target", F.col("depth").isNotNull().alias("found"), F.coalesce("depth", F.lit(-1).cast("long")).alias("depth"), F.col("node").alias("meet"))


def path_steps(spark: SparkSession, edges: DataFrame, pairs: DataFrame, max_depth: int) -> DataFrame:
    """start, target, step, input, tactic, output along one shortest OR path of each pair that has one.

    Of several the one is taken whose states, from the end back, are least; of several tactics between
    two states the preferred one. Pairs whose ends are equal have no steps.
    """
    reached = cut(spark, bfs(spark, or_edges(edges), pairs.select("start", F.col("start").alias("node")).distinct(), max_depth), "reached")
    at = pairs.select("start", "target", F.col("target").alias("node")).distinct()
    found = None
    for _ in range(max_depth):
        step = at.join(reached.where("depth > 0"), ["start", "node"]).select("start", "target", F.col("depth").alias("step"), F.col("parent").alias("input"), F.col("node").alias("output"))
        step = cut(spark, step, "path-step")
        if step.isEmpty():
            break
        found = step if found is None else found.unionByName(step)
        at = step.select("start", "target", F.col("input").alias("node"))
    if found is None:
        found = step
    between = edges.select("input", F.explode(F.array_distinct("outputs")).alias("output"), F.struct(*[c.alias(f"o{k}") for k, c in enumerate(preference())]).alias("rank"), "tactic")
    best = between.groupBy("input", "output").agg(F.min_by("tactic", "rank").alias("tactic"))
    return found.join(best, ["input", "output"]).select("start", "target", "step", "input", "tactic", "output")


def discharge(spark: SparkSession, edges: DataFrame, oracles: DataFrame, max_depth: int) -> DataFrame:
    """oracle, node, depth: what can be discharged by steps of at most ``max_depth``, for each oracle on its own.

    The oracle and the state without goals are given (depth 0); a step discharges its input once all of
    its outputs are. The rounds stop when one adds nothing. oracles: (oracle), null for none.
    """
    members = cut(spark, edges.select("input", "tactic", F.concat_ws("|", "outputs").alias("key"), F.explode("outputs").alias("output")).distinct(), "members")
    needed = cut(spark, members.groupBy("input", "tactic", "key").agg(F.count("*").alias("needed")), "needed")
    given = oracles.select("oracle", F.explode(F.array(F.lit(DONE), F.col("oracle"))).alias("node")).where("node is not null").distinct()
    known = fresh = cut(spark, given.withColumn("depth", F.lit(0).cast("long")), "known")
    have = None
    for depth in range(1, max_depth + 1):
        more = fresh.join(members, F.col("node") == F.col("output")).groupBy(F.col("oracle"), "input", "tactic", "key").agg(F.count("*").alias("have"))
        if have is not None:  # counts of the rounds before go on
            more = more.unionByName(have).groupBy("oracle", "input", "tactic", "key").agg(F.sum("have").alias("have"))
        more = cut(spark, more, "have")
        if have is not None:
            forget(spark, have)
        have = more
        ready = have.join(needed, ["input", "tactic", "key"]).where("have = needed").select("oracle", F.col("input").alias("node")).distinct()
        k = known.select(F.col("oracle").alias("o"), F.col("node").alias("n"))
        fresh = cut(spark, ready.join(k, F.col("oracle").eqNullSafe(F.col("o")) & (F.col("node") == F.col("n")), "left_anti").withColumn("depth", F.lit(depth).cast("long")), "known")
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
    return known


def proofs(edges: DataFrame, discharged: DataFrame) -> DataFrame:
    """node, depth, tactic, outputs: the preferred step of each discharged node whose outputs were all discharged before it."""
    return oracle_proofs(edges, discharged.select(F.lit(None).cast("string").alias("oracle"), "node", "depth")).drop("oracle")


def oracle_proofs(edges: DataFrame, discharged: DataFrame) -> DataFrame:
    """oracle, node, depth, tactic, outputs: of each discharged (oracle, node, depth) past depth 0 the preferred step
    whose outputs were all discharged before it, for that oracle."""
    levels = discharged.select(F.coalesce("oracle", F.lit("")).alias("key"), "oracle", "node", "depth")
    steps = edges.select("input", "tactic", "outputs", "occurrences", F.concat_ws("|", "outputs").alias("text"), F.size(F.array_distinct("outputs")).alias("needed"))
    outputs = steps.select("input", "tactic", "text", "needed", F.explode(F.array_distinct("outputs")).alias("node"))
    have = outputs.join(levels.select("key", "node", "depth"), "node").groupBy("key", "input", "tactic", "text", "needed").agg(F.max("depth").alias("latest"), F.count("*").alias("have")).where("have = needed")
    ready = have.join(levels.withColumnRenamed("node", "input"), ["key", "input"]).where("depth > 0 and latest < depth").join(steps.drop("needed"), ["input", "tactic", "text"])
    rank = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(preference())])
    return ready.groupBy("oracle", F.col("input").alias("node"), "depth").agg(F.min_by(F.struct("tactic", "outputs"), rank).alias("s")).select("oracle", "node", "depth", "s.tactic", "s.outputs")


def discharge_search(spark: SparkSession, edges: DataFrame, pairs: DataFrame, discharged: DataFrame, max_depth: int, max_expansions: int = 50_000) -> DataFrame:
    """start, target, solved, depth, expansions, exhausted of each distinct pair: start discharged where target is given.

    discharged: (oracle, node, depth) of ``discharge`` for the pairs' targets. A search of growing depth opens
    the states less than ``depth`` steps from the start (``max_depth`` where it does not succeed), each once,
    and neither the target nor what has no goals; expansions counts them. A pair that would open more than
    ``max_expansions`` is exhausted and not solved; depth is -1 where a pair is not solved.
    """
    pairs = cut(spark, pairs.select("start", "target").distinct(), "search-pairs")
    ends = F.col("node").isin(DONE) | (F.col("node") == F.col("target"))
    opened = bfs(spark, or_edges(edges), pairs.withColumn("node", F.col("start")), max(0, max_depth - 1), key=["start", "target"], stop=ends).where(~ends)
    got = pairs.join(discharged.select(F.col("oracle").alias("target"), F.col("node").alias("start"), F.col("depth").alias("reached")), ["start", "target"], "left").where(F.coalesce("reached", F.lit(0)) <= max_depth)
    near = opened.select("start", "target", F.col("depth").alias("away")).join(got, ["start", "target"]).where(F.col("away") < F.coalesce("reached", F.lit(max_depth)))
    counts = near.groupBy("start", "target").agg(F.count("*").alias("expansions"))
    rows = got.join(counts, ["start", "target"], "left").withColumn("expansions", F.coalesce("expansions", F.lit(0).cast("long")))
    over = F.col("expansions") > max_expansions
    solved = F.col("reached").isNotNull() & ~over
    return rows.select("start", "target", solved.alias("solved"), F.when(solved, F.col("reached")).otherwise(F.lit(-1)).cast("long").alias("depth"), "expansions", over.alias("exhausted"))


def proof_steps(spark: SparkSession, steps: DataFrame, pairs: DataFrame, max_depth: int) -> DataFrame:
    """start, target, node, depth, tactic, outputs: the steps of each pair's proof, every state of it once.

    steps: ``oracle_proofs``. From the start the chosen step's outputs are gone on from until all that is left
    is given; a proof of depth d takes d rounds, each a written table. Pairs without a proof have no rows.
    """
    steps = cut(spark, steps.select(F.col("oracle").alias("target"), "node", "depth", "tactic", "outputs"), "proof-steps")
    at = cut(spark, pairs.select("start", "target", F.col("start").alias("node")).distinct(), "proof")
    found = None
    for _ in range(max_depth):
        taken = at.join(steps, ["target", "node"])
        if found is not None:
            taken = taken.join(found.select("start", "target", "node"), ["start", "target", "node"], "left_anti")
        taken = cut(spark, taken.select("start", "target", "node", "depth", "tactic", "outputs"), "proof")
        found = taken if found is None else found.unionByName(taken)
        if taken.isEmpty():
            break
        at = taken.select("start", "target", F.explode("outputs").alias("node")).distinct()
    return found


def paired(names: DataFrame, rounds: int, most: int) -> DataFrame:
    """(a, b): in each round every one of ``most`` sampled names (name) meets another; a sampling operator.

    Names are ordered by hash twice a round and meet by rank; a name that meets itself is left out.
    """
    digest = lambda *c: F.md5(F.concat_ws(":", *[F.col(x).cast("string") if isinstance(x, str) else x for x in c]).cast("binary"))
    few = names.select("name").distinct().orderBy(digest("name"), "name").limit(most).select("name", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    side = lambda tag, out: few.select(F.col("name").alias(out), "round", F.row_number().over(Window.partitionBy("round").orderBy(digest("name", F.lit(tag), "round"), "name")).alias("rank"))
    return side("a", "a").join(side("b", "b"), ["round", "rank"]).where("a <> b").select("round", "a", "b")
