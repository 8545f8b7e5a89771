"""Feature-set regressions, ranks by ranges, centroids and numeric helpers against NumPy and plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegraph.functions import arrays as A
from tracegraph.operators import learning as L


def plain(x, y, train, penalty):
    """(n, r2, pearson, rmse) of the training and the test side."""
    if x.shape[1]:
        mean, spread = x[train].mean(0), x[train].std(0)
        z = (x - mean) / np.where(spread < 1e-8, 1, spread)
        zt, u = z[train], y[train] - y[train].mean()
        p = y[train].mean() + z @ np.linalg.solve(zt.T @ zt + penalty * np.eye(x.shape[1]), zt.T @ u)
    else:
        p = np.full(len(y), y[train].mean())
    out = {}
    for side, at in (("train", train), ("test", ~train)):
        e = y[at] - p[at]
        r2 = 1 - (e**2).sum() / ((y[at] - y[at].mean()) ** 2).sum() if x.shape[1] else 0.0
        out[side] = (at.sum(), r2, np.corrcoef(p[at], y[at])[0, 1] if x.shape[1] else 0.0, np.sqrt((e**2).mean()))
    return out


@pytest.mark.parametrize("penalty", [1.0, 2.0])
def test_regression_sets(spark, penalty):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)) * [1, 5, 0.1, 1, 1, 0] + [0, 3, 0, 0, 100, 7]  # the last column is constant
    y = x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=300)
    train = rng.random(300) < 0.8
    rows = spark.createDataFrame([(v.tolist(), float(t), bool(s)) for v, t, s in zip(x, y, train)], "x array<double>, y double, train boolean")
    sets = {"none": [], "one": [1], "constant": [5], "some": [0, 1, 4], "all": list(range(6))}
    got = {(r.feature_set, r.side): r for r in L.regression_sets(rows, sets, penalty).collect()}
    assert len(got) == 10
    for name, columns in sets.items():
        for side, (n, r2, rho, rmse) in plain(x[:, columns], y, train, penalty).items():
            r = got[name, side]
            assert (r.n_features, r.n) == (len(columns), n) and r.r2 == pytest.approx(r2, abs=1e-8) and r.rmse == pytest.approx(rmse)
            assert r.pearson == pytest.approx(0.0 if np.isnan(rho) or name == "constant" else rho, abs=1e-8)
    assert L.regression_sets(rows.limit(0), sets).count() == 0


def test_ranks_by_ranges(spark):
    rng = np.random.default_rng(1)
    keys = rng.permutation(5000)[:2000]
    rows = spark.createDataFrame([(int(k), int(k) % 5) for k in keys], "k long, n long").repartition(7)
    got = {r.k: r.before for r in L.prefix_sums(rows, "k", F.col("n")).collect()}
    total, want = 0, {}
    for k in sorted(keys.tolist()):
        want[k] = total
        total += k % 5
    assert got == want
    assert {r.k: r.id for r in L.dense_ids(rows.union(rows), "k").collect()} == {k: i for i, k in enumerate(sorted(keys.tolist()))}
    assert L.prefix_sums(rows.limit(0), "k", F.col("n")).count() == 0
    x, y = rng.integers(0, 40, 500) / 7, rng.integers(0, 2, 500)
    pairs = spark.createDataFrame([(int(b), float(a)) for a, b in zip(x, y)], "y int, x double")
    wins = [(a > b) + 0.5 * (a == b) for a in x[y == 1] for b in x[y == 0]]
    assert L.roc_auc(pairs).first().auc == pytest.approx(np.mean(wins))
    counts = pairs.groupBy("x").agg(F.count("*").alias("n"))
    assert {r.x: round(r.p, 9) for r in L.ccdf(counts, "x", "n").collect()} == {v: round(float((x >= v).mean()), 9) for v in set(x.tolist())}


def test_centroids_and_priors(spark):
    rng = np.random.default_rng(2)
    x, y, train = rng.normal(size=(200, 4)), rng.integers(0, 5, 200), rng.random(200) < 0.7
    rows = spark.createDataFrame([(k, a.tolist(), int(b), bool(t), k % 9) for k, (a, b, t) in enumerate(zip(x, y, train))], "id long, x array<double>, label int, train boolean, ns long")
    means = np.stack([x[train & (y == c)].mean(0) for c in range(5)])
    order = np.argsort(np.round(((x[:, None] - means[None]) ** 2).sum(2), 6), axis=1, kind="stable")
    got = {(r.id, r.rk): r.predicted for r in L.nearest_centroids(rows, "id", "x", "label", 2, train="train").collect()}
    assert got == {(k, j + 1): int(order[k, j]) for k in range(200) for j in range(2)}
    best = lambda at: min(range(5), key=lambda c: (-(at & (y == c)).sum(), c))
    assert L.majority(rows.where("train"), "label").first().label == best(train)
    known = spark.createDataFrame([(500, None, None, False, 77)], rows.schema)
    guess = {r.id: r.guess for r in L.prefix_majority(rows.union(known), "ns", "label", "train").collect()}
    ns = np.arange(200) % 9
    assert guess == {k: best(train & (ns == k % 9)) for k in range(200)} | {500: best(train)}


def test_array_helpers(spark):
    rows = spark.createDataFrame([([1.0, 1000.0], "b", [3, -2]), ([0.0, 0.0], None, []), ([-5.0, 5.0], "z", None)], "x array<double>, c string, k array<int>")
    got = rows.select(A.softmax(F.col("x")).alias("p"), A.sigmoid(F.col("x")[0]).alias("s"), A.one_hot(F.col("c"), ["a", "b"]).alias("h"), A.index_range(F.col("k")).alias("r")).collect()
    assert got[0].p == [0.0, 1.0] and got[1].p == [0.5, 0.5] and got[2].p[1] == pytest.approx(1 / (1 + np.exp(-10)))
    assert got[1].s == 0.5 and [r.h for r in got] == [[0.0, 1.0], [0.0, 0.0], [0.0, 0.0]] and [tuple(r.r) for r in got] == [(-2, 3), (-1, -1), (-1, -1)]


def test_graph_families(spark):
    """Every node has all families; betweenness and resistances are those of their operators."""
    from tracegraph.operators import graphs as G
    from tracegraph.plans import models as M

    rng = np.random.default_rng(2)
    pairs = sorted({(i, i + 1) for i in range(29)} | {tuple(sorted(map(int, rng.choice(30, 2, replace=False)))) for _ in range(40)})
    und = spark.createDataFrame(pairs, "u long, v long")
    got = {r.name: r for r in M.graph_families(spark, und).collect()}
    assert set(got) == set(range(30))
    assert all((len(r.walk), len(r.spec), len(r.resist)) == (M.WALK_SIZE, 20, M.HUBS) for r in got.values())
    bc = {r.node: r.bc for r in G.betweenness(spark, und, spark.createDataFrame([(k,) for k in range(30)], "node long")).collect()}
    assert all(abs(got[n].bc - bc.get(n, 0.0)) < 1e-9 for n in got)
    degree = {n: sum(n in p for p in pairs) for n in got}
    hubs = sorted(sorted(got, key=lambda n: (-degree[n], n))[: M.HUBS])
    assert all(got[h].resist[k] == 0 for k, h in enumerate(hubs)) and all(x >= 0 for r in got.values() for x in r.resist)
