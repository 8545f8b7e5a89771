"""Many starts in one search, a bit each: against a plain search for each start, and paths back from the goals."""

import random

from pyspark.sql import functions as F

from tracegraph.operators import graphs as G


def _graph(seed=5):
    rng = random.Random(seed)
    return sorted({(rng.randrange(120), rng.randrange(120)) for _ in range(300)})


def _depths(pairs, start, most):
    out, front = {start: 0}, [start]
    for depth in range(1, most + 1):
        front = sorted({b for a, b in pairs if a in front and b not in out})
        out |= {b: depth for b in front}
    return out


def test_fronts_of_more_starts_than_a_word_has_bits(spark):
    pairs = _graph()
    starts = sorted({a for a, _ in pairs})[:100] + [500]
    numbered, fronts = G.fronts(spark, spark.createDataFrame(pairs, "source long, target long"), spark.createDataFrame([(s,) for s in starts], "start long"), 4)
    fronts = fronts.cache()
    got = {(r.start, r.node, r.depth) for r in fronts.join(numbered, "word").where(G.reached()).collect()}
    assert got == {(s, n, d) for s in starts for n, d in _depths(pairs, s, 4).items()}
    # a row a node, word and depth at most, not one a start: 101 starts take two words
    assert fronts.count() <= 121 * 2 * 5 < len(got)
    assert fronts.groupBy("node", "word", "depth").count().agg(F.max("count")).first()[0] == 1


def test_paths_back_take_the_least_sources(spark):
    pairs = _graph(6)
    edges = spark.createDataFrame([(a, b, a * b) for a, b in pairs], "source long, target long, uses long")
    asked = [(a, b) for a in (1, 2, 3) for b in range(0, 120, 7) if a != b]
    numbered, fronts = G.fronts(spark, edges, spark.createDataFrame([(1,), (2,), (3,)], "start long"), 7)
    rows = G.paths_back(spark, edges, fronts, spark.createDataFrame(asked, "start long, goal long").join(numbered, "start"), 7).collect()
    want = set()
    for start, goal in asked:
        depths, at = _depths(pairs, start, 7), goal
        while depths.get(at, 0) > 0:
            source = min(a for a, b in pairs if b == at and depths.get(a) == depths[at] - 1)
            want.add((start, goal, depths[at], source, at, source * at))
            at = source
    assert {tuple(r) for r in rows} == want and want


def test_paths_of_unreached_goals_are_empty(spark):
    edges = spark.createDataFrame([(1, 2), (3, 4)], "source long, target long")
    numbered, fronts = G.fronts(spark, edges, spark.createDataFrame([(1,)], "start long"), 3)
    pairs = spark.createDataFrame([(1, 4)], "start long, goal long").join(numbered, "start")
    assert G.paths_back(spark, edges, fronts, pairs, 3).columns == ["start", "goal", "step", "source", "target"]
    assert G.paths_back(spark, edges, fronts, pairs, 3).count() == 0
