"""The stored adjacency: hubs in chunks, places of neighbours, and traversals over both against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracegraph.operators import adjacency as A
from tracegraph.operators import graphs as G


@pytest.fixture(scope="module")
def graph():
    rng = random.Random(3)
    pairs = {(0, k) for k in range(1, 60)} | {(rng.randrange(60), rng.randrange(60)) for _ in range(90)}
    return sorted((a, b) for a, b in pairs if a < b)


def around(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        out.setdefault(b, []).append(a)
    return {k: sorted(v) for k, v in out.items()}


def test_hubs_are_split(spark, graph):
    edges = spark.createDataFrame(graph + graph[:9], "source long, target long")
    held = A.Adjacency(spark, edges, chunk=8)
    assert held.split and held.table.groupBy("node", "chunk").count().agg(F.max("count")).first()[0] < 24
    got = sorted((r.node, r.to) for r in held.expand(held.start(edges.select(F.col("source").alias("node")).distinct()), "node").collect())
    assert got == graph
    chunks = {r.to: r.chunks for r in held.expand(held.start(edges.select(F.col("source").alias("node")).distinct()), "node").collect()}
    out = {}
    for a, _ in graph:
        out[a] = out.get(a, 0) + 1
    assert chunks == {b: max(1, -(-out.get(b, 0) // 8)) if out.get(b, 0) > 8 else 1 for _, b in graph}
    held.drop()
    assert not spark.catalog.tableExists(held.table._cut_table)


def test_star_of_a_million_edges(spark):
    """The hub's chunks lie evenly: no partition has twice the edges of the median one."""
    edges = spark.range(1, 1_000_001).select(F.lit(0).cast("long").alias("source"), F.col("id").alias("target"))
    held = A.Adjacency(spark, edges)
    at = held.start(spark.createDataFrame([(0,)], "node long"))
    assert at.first().chunks == 977
    dealt = held.table.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n")).orderBy("n").collect()
    assert len(dealt) == 4 and dealt[-1].n < 2 * dealt[len(dealt) // 2].n
    assert held.expand(at, "node").count() == 1_000_000
    held.drop()


def test_places(spark, graph):
    got = A.indexed(spark, G.symmetric(spark.createDataFrame(graph, "u long, v long")).toDF("source", "target")).collect()
    near = around(graph)
    assert sorted(tuple(r) for r in got) == sorted((n, k, m, len(near[n]), len(near[m])) for n in near for k, m in enumerate(near[n]))


def test_walks_can_be_replayed(spark, graph):
    near, got = around(graph), {}
    for r in G.random_walks(spark, spark.createDataFrame(graph, "u long, v long"), 3, 6).collect():
        got.setdefault((r.start, r.walk), {})[r.step] = r.node
    assert len(got) == 3 * len(near)
    for (start, walk), nodes in got.items():
        at = start
        assert nodes[0] == start and len(nodes) == 6
        for step in range(1, 6):
            at = near[at][int(hashlib.md5(f"{start}:{walk}:{step}:0".encode()).hexdigest()[:12], 16) % len(near[at])]
            assert nodes[step] == at


@pytest.mark.parametrize("chunk", [4, 1024])
def test_traversals(spark, graph, chunk, monkeypatch):
    monkeypatch.setattr(G, "Adjacency", lambda s, e: A.Adjacency(s, e, chunk))
    near = around(graph)

    def levels(a):
        dist, sigma, at = {a: 0}, {a: 1.0}, [a]
        order = [a]
        while at:
            nxt = []
            for n in at:
                for m in near[n]:
                    if m not in dist:
                        dist[m], sigma[m] = dist[n] + 1, 0.0
                        nxt.append(m)
                    if dist[m] == dist[n] + 1:
                        sigma[m] += sigma[n]
            order += nxt
            at = nxt
        return dist, sigma, order

    sources = sorted(near)[:7]
    edges = G.symmetric(spark.createDataFrame(graph, "u long, v long"))
    starts = spark.createDataFrame([(a, a) for a in sources], "start long, node long")
    got = {(r.start, r.node): (r.depth, r.parent) for r in G.bfs(spark, edges.toDF("source", "target"), starts, 9).collect()}
    want, bc = {}, {}
    for a in sources:
        dist, sigma, order = levels(a)
        want |= {(a, n): (d, min((m for m in near[n] if dist[m] == d - 1), default=None)) for n, d in dist.items()}
        delta = dict.fromkeys(dist, 0.0)
        for n in reversed(order):
            for m in near[n]:
                if dist[m] == dist[n] + 1:
                    delta[n] += sigma[n] / sigma[m] * (1 + delta[m])
        for n, x in delta.items():
            if n != a:
                bc[n] = bc.get(n, 0.0) + x
    assert got == want
    found = {r.node: r.bc for r in G.betweenness(spark, spark.createDataFrame(graph, "u long, v long"), spark.createDataFrame([(a,) for a in sources], "node long")).collect()}
    assert found.keys() == bc.keys() and all(abs(found[n] - bc[n]) < 1e-9 for n in bc)


def test_walk_back(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (5, 4)], "source long, target long")
    reached = G.bfs(spark, edges, spark.createDataFrame([(1, 1)], "start long, node long"), 7)
    got = G.walk_back(spark, reached, spark.createDataFrame([(1, 4), (1, 3), (1, 1)], "start long, node long"), 7).collect()
    assert sorted((r.step, r.node) for r in got) == [(0, 1), (0, 1), (0, 1), (1, 2), (1, 5), (2, 3), (2, 4)]
