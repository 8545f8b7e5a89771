"""The rectified network against finite differences, one process, and data no linear model can tell apart."""

import numpy as np
import pytest

from tracegraph.operators import learning as L
from tracegraph.operators import network as N

RNG = np.random.default_rng(5)
SCHEMA = "key long, x array<double>, y double, train boolean"


def frame(spark, x, y, train):
    return spark.createDataFrame([(k, [float(v) for v in a], float(b), bool(t)) for k, (a, b, t) in enumerate(zip(x, y, train))], SCHEMA)


def ring(n):
    """Two classes, within and beyond a circle."""
    x = RNG.normal(size=(n, 2))
    return x, (np.hypot(*x.T) > 1.18).astype(int)


def test_gradient_is_the_slope_of_the_loss(spark):
    x, y = RNG.normal(size=(50, 3)), RNG.integers(0, 4, 50)
    layers = [w + RNG.normal(size=w.shape) / 10 for w in N.start(3, 6, 4)]
    n, loss, slopes = N.gradient(frame(spark, x, y, [True] * 50).repartition(7), layers)
    mean = lambda: N.loss_sums(layers, x, y)[1] / 50
    assert n == 50 and np.isclose(loss, mean())
    for w, g in zip(layers, slopes):
        for cell in np.ndindex(w.shape):
            kept, step = w[cell], 1e-6
            w[cell] = kept + step
            above = mean()
            w[cell] = kept - step
            below = mean()
            w[cell] = kept
            assert abs((above - below) / (2 * step) - g[cell]) < 1e-6


def test_cells_name_the_gradient(spark):
    x, y = RNG.normal(size=(30, 3)), RNG.integers(0, 2, 30)
    rows, layers = frame(spark, x, y, [True] * 30), N.start(3, 5, 2)
    _, _, slopes = N.gradient(rows, layers)
    got = {(r.layer, r.i, r.j): r.g for r in N.gradient_cells(spark, rows, layers).collect()}
    assert len(got) == sum(w.size for w in layers)
    assert all(np.isclose(slopes[a - 1][i - 1, j - 1], g) for (a, i, j), g in got.items())


def test_training_does_not_depend_on_partitions(spark):
    x, y = ring(120)
    rows = frame(spark, x, y, [True] * 120)
    runs = [N.train(spark, rows.repartition(k), N.start(2, 8, 2), epochs=4, batches=3, rate=0.3) for k in (1, 6)]
    assert all(np.allclose(a, b) for a, b in zip(runs[0][0], runs[1][0])) and np.allclose(runs[0][1], runs[1][1])


def test_one_batch_is_plain_descent(spark):
    x, y = ring(80)
    got, losses = N.train(spark, frame(spark, x, y, [True] * 80), N.start(2, 8, 2), epochs=6, rate=0.4, decay=0.01)
    layers, want = N.start(2, 8, 2), []
    for epoch in range(6):
        sums = N.loss_sums(layers, x, y) / 80
        want.append(sums[1])
        slopes = sums[2:26].reshape(3, 8), sums[26:].reshape(9, 2)
        rate = [0.4, 0.2, 0.1][epoch // 2]
        for w, g in zip(layers, slopes):
            pull = w.copy()
            pull[-1] = 0
            w -= rate * (g + 0.01 * pull)
    assert np.allclose(losses, want) and all(np.allclose(a, b) for a, b in zip(got, layers))


def test_learns_what_no_plane_divides(spark):
    x, y = ring(400)
    rows = frame(spark, x, y, [k % 4 > 0 for k in range(400)])
    flat = L.classifier_report(rows, "logistic").first()
    r = N.network_report(spark, rows, 2, 2, hidden=32, epochs=40, batches=1, rate=1.0).first()
    assert r.n == 100 and r.accuracy > 0.9 and r.macro_f1 > 0.9 and r.accuracy > flat.accuracy + 0.2


def test_rows_that_cannot_be_used(spark):
    bad = [(90, None, 0.0, True), (91, [1.0], 0.0, True), (92, [1.0, float("nan")], 1.0, True), (93, [1.0, None], 1.0, False), (94, [float("inf"), 0.0], 0.0, True), (95, [1.0, 2.0], None, True)]
    good = [(k, [float(k), 5.0], float(k % 2), k < 6) for k in range(8)]
    rows = N.prepared(spark.createDataFrame(good + bad, SCHEMA), 2)
    got = {r.key: r.x for r in rows.collect()}
    assert sorted(got) == list(range(8)) and all(v[1] == 0 for v in got.values())
    assert np.isclose(np.mean([got[k][0] for k in range(6)]), 0) and np.isclose(np.std([got[k][0] for k in range(6)]), 1)
    empty = spark.createDataFrame([], SCHEMA)
    start = N.start(2, 4, 2)
    layers, losses = N.train(spark, empty, start, epochs=2)
    assert losses == [0, 0] and all((a == b).all() for a, b in zip(layers, start))
    assert N.network_report(spark, empty, 2, 2, hidden=4, epochs=1).first().n == 0


@pytest.mark.parametrize("layer, n", [(0, 400), (1, 300)])
def test_first_weights(layer, n):
    w = N.start(400, 300, 20)[layer]
    assert (w[-1] == 0).all() and np.isclose(w[:-1].var(), 2 / n, rtol=0.05) and np.abs(w).max() <= np.sqrt(6 / n)
