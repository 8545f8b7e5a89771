"""Graph operators: degrees, bounded traversals, discharge, components, geometry."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import cut, cut_by, forget
from ..plans.ship import ship_package
from .adjacency import Adjacency, indexed
from .learning import ranked
from .tiles import Tiles, packed, unpacked


def first_edges(occurrences: DataFrame, order: str) -> DataFrame:
    """Unique (source, target) with the head and order of the first sighting, and the count."""
    return occurrences.groupBy("source", "target").agg(F.min_by("head", order).alias("head"), F.min(order).alias("first_idx"), F.count("*").alias("occurrences"))


def degrees(edges: DataFrame, distinct: bool = False) -> DataFrame:
    """name, in_degree, out_degree over distinct edges; names without edges are not listed. ``distinct``: they are so already."""
    e = edges.select("source", "target")
    e = e if distinct else e.distinct()
    ends = e.select(F.col("source").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("target", F.lit(0), F.lit(1)))
    return ends.groupBy("name").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.where("source <> target").select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).distinct()


def symmetric(und: DataFrame) -> DataFrame:
    return und.select("u", "v").union(und.select(F.col("v"), F.col("u")))


def bfs(spark: SparkSession, edges: DataFrame, starts: DataFrame, max_edges: int, key: str | list[str] = "start", stop: Column | None = None) -> DataFrame:
    """(key, node, depth, parent) of all nodes within ``max_edges`` of each start, batched over starts.

    starts: (key, node), where key may be several columns. Nodes where ``stop`` (of key and node) holds are
    reached, not gone on from. The parent is the least predecessor on the level before. Every level is a
    written table; visited nodes are removed by an anti join. Hubs are expanded in chunks by many tasks.
    """
    keys = [key] if isinstance(key, str) else key
    around = Adjacency(spark, edges)
    none = F.lit(None).cast(edges.schema["source"].dataType)
    first = starts.select(*keys, "node").distinct()
    frontier = cut(spark, around.start(first).select(*keys, "node", F.lit(0).cast("long").alias("depth"), none.alias("parent"), "chunks"), "bfs")
    seen = frontier.drop("chunks")
    for depth in range(1, max_edges + 1):
        going = frontier if stop is None else frontier.where(~stop)
        step = around.expand(going.select(*keys, "node", "chunks"), *keys, F.col("node").alias("parent")).groupBy(*keys, F.col("to").alias("node")).agg(F.min("parent").alias("parent"), F.first("chunks").alias("chunks"))
        frontier = cut(spark, step.join(seen.select(*keys, "node"), [*keys, "node"], "left_anti").select(*keys, "node", F.lit(depth).cast("long").alias("depth"), "parent", "chunks"), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.drop("chunks"))
    around.drop()
    return seen


def fronts(spark: SparkSession, edges: DataFrame, starts: DataFrame, max_edges: int) -> tuple[DataFrame, DataFrame]:
    """(start, word, bit) and (node, word, depth, mask): which starts first reach a node at each depth up to ``max_edges``.

    starts: (start). 64 starts share a word, a bit each, so a level moves one row an edge and word instead of one
    an edge and start. Every level is a written table; ``reached`` tells a start's bit.
    """
    places = ranked(starts.select("start").distinct(), ["start"], "place")
    numbered = cut(spark, places.select("start", F.floor(F.col("place") / 64).cast("int").alias("word"), (F.col("place") % 64).cast("int").alias("bit")), "starts")
    around = Adjacency(spark, edges)
    first = numbered.groupBy(F.col("start").alias("node"), "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("fresh"))
    state = cut(spark, first.select("node", "word", F.col("fresh").alias("seen"), "fresh"), "fronts")
    levels = [state]
    for _ in range(max_edges):
        front = state.where("fresh <> 0").select("node", "word", F.col("fresh").alias("mask"))
        step = around.expand(around.start(front), "word", "mask").groupBy(F.col("to").alias("node"), "word").agg(F.bit_or("mask").alias("mask"))
        none = F.lit(0).cast("long")
        both = state.select("node", "word", "seen").join(step, ["node", "word"], "full").select("node", "word", F.coalesce("seen", none).alias("seen"), F.coalesce("mask", none).alias("mask"))
        state = cut(spark, both.select("node", "word", F.col("seen").bitwiseOR(F.col("mask")).alias("seen"), F.col("mask").bitwiseAND(F.bitwise_not("seen")).alias("fresh")), "fronts")
        if state.where("fresh <> 0").isEmpty():
            break
        levels.append(state)
    around.drop()
    depth = lambda k: F.lit(k).cast("long").alias("depth")
    return numbered, reduce(DataFrame.unionByName, [t.where("fresh <> 0").select("node", "word", depth(k), F.col("fresh").alias("mask")) for k, t in enumerate(levels)])


def reached() -> Column:
    """Whether the start of ``bit`` is in ``mask``; the words are equal."""
    return F.expr("(shiftrightunsigned(mask, bit) & 1) = 1")


def walk_back(spark: SparkSession, reached: DataFrame, goals: DataFrame, max_edges: int, key: str = "start") -> DataFrame:
    """(key, step, node) along the found path to each goal (key, node), step 0 at the start. Each step is a written table."""
    found = goals.join(reached, [key, "node"]).select(key, F.col("depth").alias("step"), "node", "parent")
    at = out = cut(spark, found, "back")
    for _ in range(max_edges):
        up = at.where("parent is not null").select(key, (F.col("step") - 1).alias("step"), F.col("parent").alias("node"))
        at = cut(spark, up.join(reached.select(key, "node", "parent"), [key, "node"]).select(key, "step", "node", "parent"), "back")
        if at.isEmpty():
            break
        out = out.unionByName(at)
    return out.select(key, "step", "node")


def paths_back(spark: SparkSession, edges: DataFrame, fronts: DataFrame, pairs: DataFrame, max_edges: int) -> DataFrame:
    """start, goal, step and the edge (source, target, ...) along one shortest path of each pair (start, goal, word, bit).

    From the goal back, the source is the least one of the level before, of ``fronts``. Pairs are few: a step reads
    the edges and fronts against a broadcast of a row a pair, and only the edges into the paths' nodes are written.
    """
    levels = cut(spark, fronts, "levels")
    at = levels.join(F.broadcast(pairs.withColumn("node", F.col("goal"))), ["node", "word"]).where(reached()).select("start", "goal", "word", "bit", "node", "depth")
    at, found = cut(spark, at, "back"), None
    rest = [c for c in edges.columns if c not in ("source", "target")]
    for _ in range(max_edges):
        into = cut(spark, edges.join(F.broadcast(at.where("depth > 0").withColumnRenamed("node", "target")), "target"), "into")
        before = levels.toDF("source", "word", "level", "mask")
        picked = into.join(before, ["source", "word"]).where((F.col("level") == F.col("depth") - 1) & reached())
        own = picked.groupBy("start", "goal", "word", "bit", "depth", "target").agg(F.min_by(F.struct("source", *rest), "source").alias("e"))
        step = cut(spark, own.select("start", "goal", "word", "bit", "depth", "target", "e.*"), "path-step")
        found = step if found is None else found.unionByName(step)
        if step.isEmpty():
            break
        at = step.select("start", "goal", "word", "bit", F.col("source").alias("node"), (F.col("depth") - 1).alias("depth"))
    return found.select("start", "goal", F.col("depth").alias("step"), "source", "target", *rest)


def discharge(spark: SparkSession, hyperedges: DataFrame, solved: DataFrame, rounds: int) -> DataFrame:
    """(node, depth) solvable within ``rounds``: an edge solves its input once all its outputs are solved."""
    members = cut(spark, hyperedges.select("id", "input", F.explode("outputs").alias("output")).distinct(), "members")
    sizes = members.groupBy("id", "input").agg(F.count("*").alias("needed"))
    known = cut(spark, solved.select("node", F.lit(0).cast("long").alias("depth")).distinct(), "solved")
    for depth in range(1, rounds + 1):
        have = members.join(known, members.output == known.node).groupBy("id").agg(F.count("*").alias("have"))
        ready = sizes.join(have, "id").where("have = needed").select(F.col("input").alias("node")).distinct()
        fresh = cut(spark, ready.join(known, "node", "left_anti").withColumn("depth", F.lit(depth).cast("long")), "solved")
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
    return known


def weak_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(name, component): least node reachable, by minimum labels with pointer jumping."""
    pairs = cut(spark, symmetric(undirected(edges)), "pairs")
    label = cut(spark, edges.select(F.col("source").alias("name")).union(edges.select("target")).distinct().withColumn("component", F.col("name")), "labels")
    while True:
        near = pairs.join(label, pairs.v == label.name).groupBy("u").agg(F.min("component").alias("m"))
        lower = label.join(near, label.name == near.u, "left").select("name", F.least("component", F.coalesce("m", "component")).alias("c"), "component")
        jump = label.select(F.col("name").alias("c"), F.col("component").alias("cc"))
        fresh = cut(spark, lower.join(jump, "c").select("name", F.least("c", "cc").alias("component"), (F.least("c", "cc") < F.col("component")).alias("moved")), "labels")
        moved = not fresh.where("moved").isEmpty()
        label = fresh.drop("moved")
        if not moved:
            return label


def neighbourhood_distance(und: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(u, v, x, y, d) for x around u and y around v of each edge (of all, or of ``edges``): d is 0, 1, 2 or 3.

    Two-step pairs are formed once for all edges, between the nodes that stand on the left and on the right
    of any, not once for each pair that an edge asks for. Pairs of one step are looked up between these nodes only.
    """
    s = symmetric(und)
    pairs = (und if edges is None else edges).join(s.toDF("u", "x"), "u").join(s.toDF("v", "y"), "v").select("u", "v", "x", "y")
    left, right = pairs.select("x").distinct(), pairs.select("y").distinct()
    one = s.toDF("x", "y")
    if edges is not None:  # few: their size decides how they are joined
        spark = und.sparkSession
        pairs, left, right = (cut(spark, t, "near") for t in (pairs, left, right))
        one = one.join(left, "x", "left_semi").join(right, "y", "left_semi")
    two = s.toDF("x", "mid").join(left, "x", "left_semi").join(s.toDF("mid", "y").join(right, "y", "left_semi"), "mid").select("x", "y").distinct()
    near = one.withColumn("steps", F.lit(1)).unionByName(two.withColumn("steps", F.lit(2))).groupBy("x", "y").agg(F.min("steps").alias("steps"))
    d = F.when(F.col("x") == F.col("y"), 0).otherwise(F.coalesce("steps", F.lit(3)))
    return pairs.join(near, ["x", "y"], "left").select("u", "v", "x", "y", d.cast("long").alias("d"))


def all_distances(spark: SparkSession, und: DataFrame) -> DataFrame:
    """``neighbourhood_distance`` over all edges: a pair leaves a task with its distance and is not shuffled."""
    rows = near_rows(spark, und).select("u", "v", "x", F.inline(F.arrays_zip("ys", "ds")))
    return rows.select("u", "v", "x", F.col("ys").alias("y"), F.col("ds").cast("long").alias("d"))


#: Edges that a task looks up around a node at once, about.
ASKED = 4096


def near_rows(spark: SparkSession, und: DataFrame) -> DataFrame:
    """(u, v, x, ys, ds) of each edge and neighbour x of u: all neighbours of v, in order, and their distances from x, 0 to 3.

    A row an edge and x meets the nodes within two steps of x, so pairs (x, y) are formed in tasks only. A node with
    many edges to answer is copied to several keys.
    """
    ship_package(spark)
    und = cut(spark, und.select("u", "v"), "und")
    s = cut(spark, symmetric(und).toDF("x", "y"), "arcs")
    own = und.groupBy(F.col("u").alias("y")).agg(F.count("*").alias("n"))
    parts = s.join(own, "y").groupBy("x").agg(F.ceil(F.sum("n") / ASKED).cast("int").alias("parts"))
    two = s.toDF("x", "mid").join(s.toDF("mid", "y"), "mid").select("x", "y", F.lit(2).alias("d"))
    near = s.withColumn("d", F.lit(1)).unionByName(two).groupBy("x", "y").agg(F.min("d").alias("d")).groupBy("x").agg(F.collect_list(F.struct("y", "d")).alias("near"))
    near = near.join(parts, "x").select("x", "near.y", "near.d", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    around = s.groupBy(F.col("x").alias("v")).agg(F.array_sort(F.collect_list("y")).alias("ys"))
    asked = und.join(around, "v").join(s.join(parts, "x").toDF("x", "u", "parts"), "u")
    asked = asked.select("u", "v", "x", "ys", F.pmod(F.xxhash64("u", "v"), F.col("parts")).cast("int").alias("part"))
    node = und.schema["u"].dataType.simpleString()
    kind = f"u {node}, v {node}, x {node}, ys array<{node}>, ds array<tinyint>"

    def look(near, asked):
        ys = asked["ys"].combine_chunks() if asked.num_rows else pa.array([], asked.schema.field("ys").type)
        flat = ys.flatten()
        if near.num_rows:
            at = pc.index_in(flat, value_set=near["y"].combine_chunks().flatten())
            d = pc.fill_null(pc.take(near["d"].combine_chunks().flatten(), at), 3)
            d = pc.if_else(pc.equal(flat, near["x"][0]), 0, d).cast(pa.int8())
        else:
            d = pa.array([], pa.int8())
        ends = pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(ys).to_numpy())]), pa.int32())
        return pa.table({"u": asked["u"], "v": asked["v"], "x": asked["x"], "ys": pa.ListArray.from_arrays(ends, flat), "ds": pa.ListArray.from_arrays(ends, d)})

    return near.groupBy("x", "part").cogroup(asked.groupBy("x", "part")).applyInArrow(look, kind)


def transport(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cheapest plan between two uniform measures, and what proves it: (units moved, row and column potentials).

    Whole costs (rows x columns); each row gives as many units as there are columns and each column takes as
    many as there are rows. Potentials sum to at most the cost everywhere and to the cost where units
    move, so their weighted sum equals the plan's cost. Primal-dual: a breadth-first search over tight
    cells augments along all of its tree's paths at once; where none ends, potentials give way.
    """
    cost = cost.astype(np.int64)
    m, n = cost.shape
    give, take, flow = np.full(m, n, np.int64), np.full(n, m, np.int64), np.zeros((m, n), np.int64)
    f = cost.min(axis=1)
    g = (cost - f[:, None]).min(axis=0)
    for i, j in zip(*np.nonzero(cost == f[:, None] + g), strict=True):  # a first plan on tight cells
        units = min(give[i], take[j])
        if units:
            flow[i, j], give[i], take[j] = units, give[i] - units, take[j] - units
    while give.any():
        tight = cost == f[:, None] + g
        rows, columns = give > 0, np.zeros(n, bool)
        from_row, from_column = np.full(n, -1), np.full(m, -1)
        fresh = np.flatnonzero(rows)
        while len(fresh):
            met = np.flatnonzero(tight[fresh].any(axis=0) & ~columns)
            from_row[met], columns[met] = fresh[tight[np.ix_(fresh, met)].argmax(axis=0)], True
            used = flow[:, met] > 0
            fresh = np.flatnonzero(used.any(axis=1) & ~rows) if len(met) else met
            from_column[fresh], rows[fresh] = met[used[fresh].argmax(axis=1)] if len(fresh) else -1, True
        moved = False
        for end in np.flatnonzero(columns & (take > 0)):
            path, row = [(from_row[end], end)], from_row[end]
            while from_column[row] >= 0:
                path.append((row, from_column[row]))
                row = from_row[from_column[row]]
                path.append((row, path[-1][1]))
            units = min(give[row], take[end], *[flow[p] for p in path[1::2]])
            if units > 0:
                for k, p in enumerate(path):
                    flow[p] += -units if k % 2 else units
                give[row], take[end], moved = give[row] - units, take[end] - units, True
        if not moved:
            slack = (cost - f[:, None] - g)[np.ix_(rows, ~columns)].min()
            f[rows] += slack
            g[columns] -= slack
    return flow, f, g


def transport_cost(cost: np.ndarray) -> float:
    """Least mean cost between two uniform measures over whole costs."""
    return float((transport(cost)[0] * cost).sum()) / cost.size


def matrices(spark: SparkSession, und: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(u, v, xs, ys, ds) of each edge (of all, or of ``edges``): the neighbours of u and of v, in order, and their distances, a list of each x."""
    if edges is None:
        rows = near_rows(spark, und)
    else:
        own = neighbourhood_distance(und, edges).groupBy("u", "v", "x").agg(F.array_sort(F.collect_list(F.struct("y", "d"))).alias("near"))
        rows = own.select("u", "v", "x", F.col("near.y").alias("ys"), F.col("near.d").cast("array<tinyint>").alias("ds"))
    m = rows.groupBy("u", "v").agg(F.first("ys").alias("ys"), F.array_sort(F.collect_list(F.struct("x", "ds"))).alias("cells"))
    return m.select("u", "v", F.col("cells.x").alias("xs"), "ys", F.col("cells.ds").alias("ds"))


def transports(spark: SparkSession, und: DataFrame, sample: DataFrame, max_neighbourhood: int) -> DataFrame:
    """``cheapest`` of sampled edges (u, v) whose ends have at most ``max_neighbourhood`` neighbours each."""
    und = cut(spark, und, "und")
    deg = symmetric(und).groupBy("u").agg(F.count("*").alias("deg"))
    small = cut(spark, sample.join(deg, "u").join(deg.toDF("v", "deg_v"), "v").where(F.greatest("deg", "deg_v") <= max_neighbourhood).select("u", "v"), "small")
    return cheapest(spark, matrices(spark, und, small))


def cheapest(spark: SparkSession, m: DataFrame) -> DataFrame:
    """u, v, m, n, total, plan (x, y, units), left (x, potential), right (y, potential) of the edges of ``matrices``; a written table.

    The m neighbours x of u and the n neighbours y of v carry uniform measures; ``total`` is the plan's cost in units
    of 1 / (m n), with distances 0 to 3. Potentials prove it: anyone can check by joins that they obey every distance
    and sum up to the total. One edge's matrix is solved at a time, so a task holds the largest of them.
    """
    ship_package(spark)
    node = m.schema["u"].dataType.simpleString()
    kind = f"u {node}, v {node}, m int, n int, total long, plan array<struct<x: {node}, y: {node}, units: long>>, left array<struct<node: {node}, potential: long>>, right array<struct<node: {node}, potential: long>>"

    def solve(parts):
        for part in (whole.iloc[at : at + 256] for whole in parts for at in range(0, len(whole), 256)):  # plans are many small objects
            out = []
            for u, v, x, y, cells in zip(part["u"], part["v"], part["xs"], part["ys"], part["cells"], strict=True):
                cost = np.asarray(cells).reshape(len(x), len(y))
                flow, f, g = transport(cost)
                plan = [{"x": x[i], "y": y[j], "units": int(flow[i, j])} for i, j in zip(*np.nonzero(flow), strict=True)]
                out.append((u, v, len(x), len(y), int((flow * cost).sum()), plan, [{"node": a, "potential": int(p)} for a, p in zip(x, f, strict=True)], [{"node": a, "potential": int(p)} for a, p in zip(y, g, strict=True)]))
            yield pd.DataFrame(out, columns=["u", "v", "m", "n", "total", "plan", "left", "right"])

    return cut(spark, m.select("u", "v", "xs", "ys", F.flatten("ds").alias("cells")).mapInPandas(solve, kind), "transports")


def ollivier_ricci(und: DataFrame, sample: DataFrame, max_neighbourhood: int) -> DataFrame:
    """(u, v, kappa) of sampled edges (u, v) whose ends have few enough neighbours."""
    t = transports(und.sparkSession, und, sample, max_neighbourhood)
    return t.select("u", "v", (1 - F.col("total") / (F.col("m") * F.col("n"))).alias("kappa"))


def _checked(parts):
    """Of each edge: the sum of its distances, how many its potentials exceed (a node without one exceeds all), and its plan's cost."""
    for part in parts:
        out = []
        for u, v, x, y, cells, left, right, plan in zip(*[part[c] for c in ("u", "v", "xs", "ys", "cells", "left", "right", "plan")], strict=True):
            d = np.asarray(cells, np.int64).reshape(len(x), len(y))
            f, g = ({p["node"]: p["potential"] for p in side} for side in (left, right))
            over = np.array([f.get(k, 1 << 32) for k in x])[:, None] + np.array([g.get(k, 1 << 32) for k in y]) > d
            row, column = ({k: i for i, k in enumerate(names)} for names in (x, y))
            cost = sum(p["units"] * int(d[row[p["x"]], column[p["y"]]]) for p in plan if p["x"] in row and p["y"] in column)
            out.append((u, v, int(d.sum()), int(over.sum()), int(cost)))
        yield pd.DataFrame(out, columns=["u", "v", "distances", "violated", "cost"])


def certificates(und: DataFrame, t: DataFrame, m: DataFrame | None = None) -> DataFrame:
    """u, v, m, n, distances, violated, misplaced, gap: a check of ``transports`` against the distances, without the solver.

    distances is the sum of all distances between the two sides; violated counts pairs (x, y) whose potentials
    exceed their distance; misplaced counts nodes of the plan that give or take another number of units than
    their measure's; gap is the plan's cost less the potentials' weighted sum. All three are 0 for a cheapest plan.
    ``m``: the edges' ``matrices``, where they are written already.
    """
    left, right = t.select("u", "v", F.inline("left")).toDF("u", "v", "x", "f"), t.select("u", "v", F.inline("right")).toDF("u", "v", "y", "g")
    m = matrices(und.sparkSession, und, t.select("u", "v")) if m is None else m
    plan = t.select("u", "v", F.inline("plan"))
    node = und.schema["u"].dataType.simpleString()
    held = m.join(t.select("u", "v", "left", "right", "plan"), ["u", "v"]).withColumn("cells", F.flatten("ds")).drop("ds")
    pairs = held.mapInPandas(_checked, f"u {node}, v {node}, distances long, violated long, cost long")
    sums = left.groupBy("u", "v").agg(F.sum("f").alias("f")).join(right.groupBy("u", "v").agg(F.sum("g").alias("g")), ["u", "v"])
    size = t.select("u", "v", "m", "n")
    odd = lambda side, name, units: plan.groupBy("u", "v", side).agg(F.sum("units").alias("units")).join(size, ["u", "v"]).groupBy("u", "v").agg((F.count_if(F.col("units") != F.col(units)) + F.abs(F.first("m" if units == "n" else "n") - F.count("*"))).alias(name))
    out = size.join(pairs, ["u", "v"]).join(sums, ["u", "v"]).join(odd("x", "giving", "n"), ["u", "v"]).join(odd("y", "taking", "m"), ["u", "v"])
    return out.select("u", "v", "m", "n", "distances", "violated", (F.col("giving") + F.col("taking")).alias("misplaced"), (F.col("cost") - F.col("n") * F.col("f") - F.col("m") * F.col("g")).alias("gap"))


def betweenness(spark: SparkSession, und: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, bc): unhalved dependency sums over the sources (node), by level-wise path counts on the graph's tiles.

    A source is a column of a vector, so their number is the caller's and small; as many at a time as tiles may
    hold. A level forward counts the paths to cells not seen before, a level back sums up dependencies, each by one
    product that moves every cell a few times in all, not a row an edge and source.
    """
    grid = Tiles(spark, und)
    ids = [r.id for r in grid.nodes.join(F.broadcast(sources.select("node").distinct()), "node").orderBy("id").select("id").collect()]  # a row a source
    size, wide = grid.size, grid.columns()
    kind = "chunk long, fresh long, depth binary, sigma binary, delta binary"
    parts = []
    for at in range(0, len(ids), wide):
        batch = ids[at : at + wide]
        k = len(batch)
        state = cut_by(spark, grid.packed(grid.nodes.select("id", "degree", F.array(F.lit(0.0)).alias("x")), "x").select("chunk"), ["chunk"], "bc")
        first = state
        state = grid.written(grid.mapped(first, _first_level(batch, size), kind), "bc")
        forget(spark, first)
        depth = 0
        while True:
            near = grid.sums(grid.mapped(state, _front(size, k, depth), "chunk long, x binary, want binary"), k)
            after = grid.written(grid.step(state, near, k, _next_level(size, k, depth + 1), kind), "bc")
            forget(spark, state)
            state = after
            if not state.agg(F.sum("fresh")).first()[0]:
                break
            depth += 1
        for level in range(depth - 1, 0, -1):  # level 0 is the source itself
            near = grid.sums(grid.mapped(state, _behind(size, k, level), "chunk long, x binary, want binary"), k)
            after = grid.written(grid.step(state, near, k, _dependencies(size, k, level), kind), "bc")
            forget(spark, state)
            state = after
        parts.append(cut(spark, grid.mapped(state, _totals(size, k), "id long, bc double"), "bc"))
        forget(spark, state)
    grid.drop()
    if not parts:
        return grid.nodes.select("node", F.lit(0.0).alias("bc")).limit(0)
    total = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("bc").alias("bc"))
    return total.join(grid.nodes, "id").select("node", "bc")


def _held(row: dict, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """depth (-1: not seen), sigma and delta of a chunk."""
    return np.frombuffer(row["depth"], np.int16).reshape(size, k), unpacked(row["sigma"], (size, k)), unpacked(row["delta"], (size, k))


def _cells(chunk: int, fresh: int, depth: np.ndarray, sigma: np.ndarray, delta: np.ndarray) -> dict:
    return {"chunk": chunk, "fresh": fresh, "depth": depth.astype(np.int16).tobytes(), "sigma": packed(sigma), "delta": packed(delta)}


def _first_level(ids: list[int], size: int):
    def change(row):
        depth = np.full((size, len(ids)), -1, np.int16)
        for j, n in enumerate(ids):
            if n // size == row["chunk"]:
                depth[n % size, j] = 0
        return [_cells(row["chunk"], int((depth == 0).sum()), depth, depth == 0, np.zeros(depth.shape))]

    return change


def _asked(chunk: int, x: np.ndarray, want: np.ndarray) -> list[dict]:
    return [{"chunk": chunk, "x": packed(x) if x.any() else None, "want": np.packbits(want).tobytes() if want.any() else None}]


def _front(size: int, k: int, level: int):
    def change(row):
        depth, sigma, _ = _held(row, size, k)
        return _asked(row["chunk"], sigma * (depth == level), depth < 0)

    return change


def _next_level(size: int, k: int, level: int):
    def change(row, y):
        depth, sigma, delta = _held(row, size, k)
        fresh = (depth < 0) & (y > 0)
        return _cells(row["chunk"], int(fresh.sum()), np.where(fresh, level, depth), np.where(fresh, y, sigma), delta)

    return change


def _behind(size: int, k: int, level: int):
    def change(row):
        depth, sigma, delta = _held(row, size, k)
        below = depth == level + 1
        return _asked(row["chunk"], np.where(below, (1 + delta) / np.where(below, sigma, 1.0), 0.0), depth == level)

    return change


def _dependencies(size: int, k: int, level: int):
    def change(row, y):
        depth, sigma, delta = _held(row, size, k)
        return _cells(row["chunk"], 0, depth, sigma, np.where(depth == level, sigma * y, delta))

    return change


def _totals(size: int, k: int):
    def change(row):
        depth, _, delta = _held(row, size, k)
        reached = np.flatnonzero((depth > 0).any(axis=1))
        total = np.where(depth > 0, delta, 0.0).sum(axis=1)
        return [{"id": int(row["chunk"] * size + n), "bc": float(total[n])} for n in reached]

    return change


def random_walks(spark: SparkSession, und: DataFrame, walks: int, length: int, seed: int = 0) -> DataFrame:
    """(start, walk, step, node): every step goes to the neighbour whose place, in order, is picked by md5.

    The place is the first 12 hex digits of md5 of "start:walk:step:seed" modulo the node's degree. A step is a
    join by (node, place) with a table of edges bucketed by both, so only walks move, a hub is as many keys as it has
    neighbours, and no list of them exists.
    """
    und = cut(spark, und.select("u", "v"), "und")
    placed = indexed(spark, symmetric(und).toDF("source", "target"))
    edges = cut_by(spark, placed, ["node", "pos"], "places")
    forget(spark, placed, und)
    digest = lambda step: F.conv(F.substring(F.md5(F.concat_ws(":", "start", "walk", F.lit(step), F.lit(seed)).cast("binary")), 1, 12), 16, 10).cast("long")
    starts = edges.where("pos = 0").select(F.col("node").alias("start"), "node", "degree")
    at = cut(spark, starts.select("start", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"), F.lit(0).alias("step"), "node", "degree"), "walks")
    steps = [at]
    for step in range(1, length):
        picked = at.withColumn("pos", digest(step) % F.col("degree")).drop("degree", "step")
        at = cut(spark, picked.join(edges.select("node", "pos", "to", F.col("to_degree").alias("degree")), ["node", "pos"]).select("start", "walk", F.lit(step).alias("step"), F.col("to").alias("node"), "degree"), "walks")
        steps.append(at)
    forget(spark, edges)
    return reduce(DataFrame.unionByName, [s.select("start", "walk", "step", "node") for s in steps])


def normalized_product(und: DataFrame, x: DataFrame) -> DataFrame:
    """(node, y) with y = D^-1/2 A D^-1/2 x for x (node, x)."""
    s = symmetric(und)
    deg = s.groupBy("u").agg(F.count("*").alias("d"))
    rows = s.join(deg, "u").join(deg.toDF("v", "dv"), "v").join(x.select(F.col("node").alias("v"), "x"), "v")
    return rows.groupBy(F.col("u").alias("node")).agg(F.sum(F.col("x") / F.sqrt(F.col("d") * F.col("dv"))).alias("y"))
