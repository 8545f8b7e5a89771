"""Hand-checked fixtures and brute force for column functions and graph operators."""

import hashlib
import itertools

import numpy as np
from pyspark.sql import functions as F

from tracegraph.functions import text as T
from tracegraph.operators import graphs as G

TWO = "2 goals\ncase a\nx : ℕ\n⊢ x = x\n\ncase b\ny : ℕ\n⊢ y =\n  y"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()[0]


def test_text(spark):
    for name, want in (("Nat.add_comm", 2), ("Eq.symm", 5), ("rfl", 7), ("CategoryTheory.isIso₂", 8)):
        assert one(spark, name, T.stable_bucket) == want == int(hashlib.md5(name.encode()).hexdigest(), 16) % 10
    assert one(spark, TWO, T.state_id) == "87512fc24449fa30"
    assert one(spark, " no goals\n", T.state_id) == T.NO_GOALS
    assert one(spark, TWO, T.extract_goals) == ["x = x", "y =\n  y"]
    assert one(spark, TWO, T.split_state) == ["case a\nx : ℕ\n⊢ x = x", "case b\ny : ℕ\n⊢ y =\n  y"]
    assert one(spark, "", T.split_state) == ["no goals"]
    assert one(spark, "foo", T.goal_id) is None
    assert one(spark, "foo", lambda c: T.goal_id(c, "state")) == hashlib.sha256(b"foo").hexdigest()[:16]
    assert [one(spark, p, T.category) for p in ("Mathlib/A/B.lean", "Mathlib/B.lean", "Init/X.lean")] == ["A", "B.lean", "UNKNOWN"]
    assert one(spark, "Mathlib/B.lean", lambda c: T.category(c, min_parts=3)) == "UNKNOWN"
    assert one(spark, "rw [<a>U.c</a>, ← <a>P.x</a>]", T.premise_directions) == ["fwd", "rev"]
    assert one(spark, "```lean\na\n```\nx\n```lean4\nb\n```", T.last_code_block) == "b"


def test_discharge_and_paths(spark):
    hyper = spark.createDataFrame([("a", "s3", ["s4", "s5"]), ("b", "s4", ["s1"]), ("c", "s5", ["end"]), ("d", "s1", ["end"])], "id string, input string, outputs array<string>")
    got = {r.node: r.depth for r in G.discharge(spark, hyper, spark.createDataFrame([("end",)], "node string"), 5).collect()}
    assert got == {"end": 0, "s1": 1, "s5": 1, "s4": 2, "s3": 3}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 3)], "source long, target long")
    got = {r.node: r.depth for r in G.bfs(spark, edges, spark.createDataFrame([(1, 1)], "start long, node long"), 7).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}


def test_components_and_betweenness(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 6)], "source long, target long")
    assert {r.name: r.component for r in G.weak_components(spark, edges).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
    path = spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")
    got = {r.node: r.bc for r in G.betweenness(spark, path, spark.createDataFrame([(1,), (2,), (3,)], "node long")).groupBy("node").agg(F.sum("bc").alias("bc")).collect()}
    assert got == {1: 0.0, 2: 2.0, 3: 0.0}


def test_curvature(spark):
    def kappa(pairs, edge):
        und = spark.createDataFrame(pairs, "u long, v long")
        return G.ollivier_ricci(und, spark.createDataFrame([edge], "u long, v long"), 80).first().kappa

    assert abs(kappa([(1, 2), (2, 3), (1, 3)], (1, 2)) - 0.5) < 1e-9
    assert abs(kappa([(1, 2), (2, 3), (3, 4)], (2, 3))) < 1e-9
    assert abs(kappa([(1, 2), (1, 3), (1, 4), (2, 5), (2, 6)], (1, 2)) + 2 / 3) < 1e-9


def test_transport():
    """Plans keep to both measures and potentials prove them; equal sides against all assignments."""
    rng = np.random.default_rng(5)
    for k in range(120):
        m, n = (4, 4) if k < 30 else rng.integers(1, 12, 2)
        cost = rng.integers(0, 4, (m, n))
        flow, f, g = G.transport(cost)
        assert (flow >= 0).all() and (flow.sum(axis=1) == n).all() and (flow.sum(axis=0) == m).all()
        assert (f[:, None] + g <= cost).all() and (flow * cost).sum() == n * f.sum() + m * g.sum()
        if k < 30:
            best = min(sum(cost[i, p[i]] for i in range(4)) for p in itertools.permutations(range(4))) / 4
            assert abs(G.transport_cost(cost) - best) < 1e-9


def test_certificates_find_faults(spark):
    """A moved unit and raised or lowered potentials are seen by the check."""
    rng = np.random.default_rng(1)
    pairs = sorted({tuple(sorted(map(int, rng.choice(14, 2, replace=False)))) for _ in range(30)})
    und = spark.createDataFrame(pairs, "u long, v long")
    t = G.transports(spark, und, und, 80)
    good = G.certificates(und, t).collect()
    assert len(good) == len(pairs) and all((r.violated, r.misplaced, r.gap) == (0, 0, 0) for r in good)
    by = lambda side, k: t.withColumn(side, F.transform(side, lambda x: F.struct(x["node"].alias("node"), (x["potential"] + k).alias("potential"))))
    assert all(r.violated and r.gap < 0 for r in G.certificates(und, by("left", 4)).collect())
    assert all(r.gap > 0 for r in G.certificates(und, by("right", -1)).collect())
    moved = t.withColumn("plan", F.transform("plan", lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), (p["units"] + F.when(i == 0, 1).otherwise(0)).alias("units"))))
    assert all(r.misplaced for r in G.certificates(und, moved).collect())
