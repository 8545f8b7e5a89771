"""Spectra, resistance, classifiers and link samples against NumPy and small brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegraph.operators import learning as L
from tracegraph.operators import spectral as S
from tracegraph.operators import tiles

RNG = np.random.default_rng(3)
N = 24
RING = {(i, i + 1) for i in range(N - 1)} | {tuple(sorted(map(int, RNG.choice(N, 2, replace=False)))) for _ in range(30)}


@pytest.fixture(scope="module")
def und(spark):
    return spark.createDataFrame(sorted(RING), "u long, v long")


def _dense():
    a = np.zeros((N, N))
    for u, v in RING:
        a[u, v] = a[v, u] = 1
    d = a.sum(1)
    return a / np.sqrt(np.outer(d, d))


def test_subspace(spark, und):
    want = np.linalg.eigvalsh(_dense())
    values, x = S.subspace(spark, und, 5, 25)
    assert np.allclose(values[:2], want[::-1][:2], atol=1e-3) and np.all(values <= want[::-1][:5] + 1e-9)
    rows = np.array([r.x for r in x.orderBy("node").collect()])
    assert np.allclose(rows.T @ rows, np.eye(5), atol=1e-6)
    assert np.linalg.norm(_dense() @ rows[:, 0] - values[0] * rows[:, 0]) < 1e-2
    values, _ = S.subspace(spark, und, 5, 25, high=True)
    assert np.allclose(values[:1], want[:1], atol=1e-2)
    few, rest = S.subspace(spark, spark.createDataFrame([(1, 2)], "u long, v long"), 5, 3)
    assert np.allclose(few, [1, -1]) and rest.count() == 2
    none, rest = S.subspace(spark, spark.createDataFrame([], "u long, v long"), 5, 3)
    assert len(none) == 0 and rest.count() == 0


def test_both_ends_and_residuals(spark, und):
    """Against NumPy: values, residual norms as they are, a filter that leaves little of them, and few jobs for both ends."""
    want, a = np.linalg.eigvalsh(_dense()), _dense()
    spark.sparkContext.setJobGroup("spectrum", "")
    e = S.spectrum(spark, und, 4, 3, 30)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("spectrum"))
    spark.sparkContext.setJobGroup("other", "")
    assert jobs < 200
    assert np.allclose(e.low, want[::-1][:4], atol=1e-6) and np.allclose(e.high, want[:3], atol=1e-6)
    rows = e.rows.orderBy("node").collect()
    low, high = np.array([r.low for r in rows]), np.array([r.high for r in rows])
    for x, values, residuals in ((low, e.low, e.low_residuals), (high, e.high, e.high_residuals)):
        assert np.allclose(np.linalg.norm(a @ x - x * values, axis=0), residuals, atol=1e-6) and (residuals < 1e-3).all()
        assert np.allclose(x.T @ x, np.eye(x.shape[1]), atol=1e-8)


def test_products_move_chunks_not_edges(spark, und, monkeypatch):
    """Columns two at a time give the same residuals, and no product sends more than a row a chunk and tile."""
    pairs = [(0, 5), (3, 17), (23, 1)]
    want = S.resistances(spark, und, pairs, most=1).orderBy("a").collect()
    moved, sums = [], tiles.Tiles.sums
    monkeypatch.setattr(tiles.Tiles, "sums", lambda self, x, k: moved.append((sums(self, x, k).count(), self.side**2 * self.per, k)) or sums(self, x, k))
    monkeypatch.setattr(tiles, "CELLS", 16)
    got = S.resistances(spark, und, pairs, most=1).orderBy("a").collect()
    assert np.allclose([r.residual for r in got], [r.residual for r in want], atol=1e-12)
    assert len(moved) == 4 and all(rows <= most and k <= 2 for rows, most, k in moved)


def test_effective_resistance(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0, 2.0]), ("b", [0.0, 2.0, 5.0])], "name string, x array<double>")
    got = {r.name: r.r for r in S.effective_resistance(rows, spark.createDataFrame([("b",)], "hub string"), np.array([0.5, 2.0, 1e-6])).collect()}
    assert np.isclose(got["a"], np.log1p(1 / 0.5 + 4 / 2.0)) and got["b"] == 0


def test_resistances(spark, und):
    """Against the pseudo-inverse of the Laplacian; pairs without a path, unknown nodes and a node with itself."""
    pairs = [(0, 5), (3, 17), (23, 1), (4, 4), (0, 100), (0, 77)]
    apart = und.unionByName(spark.createDataFrame([(100, 101)], "u long, v long"))
    got = {(r.a, r.b): r for r in S.resistances(spark, apart, pairs, most=36).collect()}
    a = (_dense() > 0).astype(float)
    inverse = np.linalg.pinv(np.diag(a.sum(1)) - a)
    assert all(abs(got[p].r - (inverse[p[0], p[0]] + inverse[p[1], p[1]] - 2 * inverse[p])) < 1e-9 and got[p].residual <= 1e-10 for p in pairs[:3])
    assert got[4, 4].r == 0 and got[0, 100].r is None and got[0, 77].r is None
    assert S.resistances(spark, und, []).count() == 0


def test_walk_embeddings(spark, und):
    got = S.walk_embeddings(spark, und, 2, 4, size=8).collect()
    assert {r.name for r in got} == {str(n) for e in RING for n in e} and all(len(r.x) == 8 for r in got)


def test_walk_embeddings_train_on_all_cores(spark, monkeypatch):
    """A partition a core, and nodes of one clique still lie nearer to each other than to those of the other."""
    import pyspark.ml.feature as ml

    seen, fit = [], ml.Word2Vec.fit
    monkeypatch.setattr(ml.Word2Vec, "fit", lambda self, rows: seen.append(self.getNumPartitions()) or fit(self, rows))
    cliques = [(a + c, b + c) for c in (0, 100) for a in range(12) for b in range(a + 1, 12)]
    rows = S.walk_embeddings(spark, spark.createDataFrame([*cliques, (0, 100)], "u long, v long"), 10, 40, size=16).collect()
    assert seen == [spark.sparkContext.defaultParallelism] and len(rows) == 24
    x = np.array([r.x for r in sorted(rows, key=lambda r: int(r.name))])
    cos = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    own = np.kron(np.eye(2), np.ones((12, 12))) > 0
    assert cos[own & ~np.eye(24, dtype=bool)].mean() > cos[~own].mean() + 0.1


def test_gram_and_specs(spark):
    x = RNG.normal(size=(50, 7))
    rows = spark.createDataFrame([(list(map(float, r)),) for r in x] + [(None,)], "x array<double>")
    got = {(r.i, r.j): r.g for r in L.gram_blocks(rows, "x").collect()}
    assert len(got) == 28 and all(np.isclose(g, x[:, i - 1] @ x[:, j - 1]) for (i, j), g in got.items())
    row = spark.createDataFrame([([1.0, 2.0, 3.0], 4)], "low array<double>, degree int")
    assert np.allclose(row.select(L.feature_spec("low2+degree", {"low": 3}).alias("f")).first().f, [1, 2, np.log1p(4)])
    for bad in ("low4", "mid2", "low", ""):
        with pytest.raises(ValueError):
            L.feature_spec(bad, {"low": 3})


def test_classifiers(spark):
    means = np.array([[0, 0], [4, 0], [0, 4], [4, 4]])
    data = [([float(v) for v in means[i % 4] + RNG.normal(size=2) / 4], f"c{i % 4}", i % 5 > 0) for i in range(200)] + [([9.0, 9.0], "rare", True)]
    rows = L.kept_classes(spark.createDataFrame(data, "x array<double>, label string, train boolean"), "label", 5)
    for model in ("logistic", "mlp"):
        r = L.classifier_report(rows, model, hidden=8).first()
        assert r.n == 40 and r.accuracy > 0.9 and r.top3 >= r.accuracy and r.macro_f1 > 0.9
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "y string, p string")
    assert np.isclose(L.macro_f1(pairs).first()[0], 2 / 3) and np.isclose(L.macro_f1_over(pairs, 3).first()[0], 4 / 9)


def test_links(spark, und):
    got = L.sampled_links(und, 40).collect()
    linked, free = {(r.a, r.b) for r in got if r.label}, {(r.a, r.b) for r in got if not r.label}
    assert len(linked) == min(40, len(RING)) and linked <= RING and free and not free & RING and all(a < b for a, b in free)
    vectors = spark.createDataFrame([(n, [float(n), 1.0], n) for n in range(N)], "name long, x array<double>, degree long")
    r = L.link_features(spark.createDataFrame([(2, 5, 1)], "a long, b long, label int"), vectors).first()
    assert np.allclose(r.x, [2, 1, 5, 1, 10, 1, 3, 0, np.log1p(2), np.log1p(5)])
    assert np.isclose(spark.range(1).select(L.power_tail(F.lit(4.0), 0.5, 2.0, 3.0).alias("p")).first().p, 0.125)
