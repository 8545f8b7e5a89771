"""Whitening against fractions and NumPy: exact sums, the transform, and rows that are left out."""

from fractions import Fraction

import numpy as np
import pytest

from tracegraph.llm import whitening

SF = "/root/testdata/sf0.001"


def test_cross_products_are_exact():
    rng = np.random.default_rng(0)
    for most in (10, 2**20, 2**25, 2**30, 2**61):
        y = rng.integers(-most, most, (300, 3))
        want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(3)] for i in range(3)]
        assert whitening.cross(y).tolist() == want


@pytest.mark.parametrize("value", [0, 1, -1, 2**40, -(2**40), 2**90 + 12345, -(2**90) - 7])
def test_limbs(value):
    parts = whitening.limbs(value)
    assert sum(x << (whitening.LIMB * k) for k, x in enumerate(parts)) == value and all(abs(x) < 2**63 for x in parts)


def test_rank():
    a = np.array([[2, 4, 6], [1, 2, 3], [0, 1, 5]], object)
    assert whitening.rank_of(a) == 2 and whitening.rank_of(np.zeros((2, 2), object)) == 0 and whitening.rank_of(np.eye(3, dtype=int).astype(object)) == 3


@pytest.mark.parametrize("shift", [None, 0, 123])
def test_query(spark, shift):
    """Deviations by fractions, values by NumPy on centred rows; the shift changes nothing."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    e = rows.toPandas().sort_values("vec_id")
    x = np.floor(64 * np.stack(e.embedding).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), [int(v) for v in x.sum(axis=0)]
    c = np.array([[float(Fraction(n * int(v) - t, n)) for v, t in zip(row, s, strict=True)] for row in x])
    values, axes = np.linalg.eigh(c.T @ c / n)
    want = c @ axes[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    got = whitening.whiten(spark, rows, shift=shift).orderBy("vec_id").collect()
    w = np.array([r.white.whitened for r in got])
    assert np.allclose(w * np.sign((w * want).sum(axis=0)), want, atol=1e-8)
    assert [int(r.white.deviation) for r in got] == [sum((n * int(v) - t) ** 2 for v, t in zip(row, s, strict=True)) for row in x]
    assert np.allclose(got[0].white.explained, values[::-1][:32] / values.sum(), rtol=1e-9)
    assert {r.white.identity_error for r in got} == {got[0].white.identity_error} and got[0].white.identity_error < 1e-9
    assert np.abs(w.T @ w / n - np.eye(32)).max() < 1e-9


def test_query_columns(spark):
    q = whitening.op12_whitening(spark, SF)
    assert q.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(q.dtypes)["deviation"] == "bigint" and q.count() == 500 * 32


def test_rows_left_out_and_kept(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [float(k % 5), 0.5 * (k % 3), 1.0], k) for k in range(30)] + [(None, [9.0, 1.0, 1.0], 1), (0, [0.0, 0.0, 1.0], 2)]
    bad = [(90, None, 0), (91, [], 0), (92, [1.0, None, 1.0], 0), (93, [nan, 1.0, 1.0], 0), (94, [inf, 1.0, 1.0], 0), (95, [1.0, 1e300, 1.0], 0), (96, [1.0, 2.0], 0)]
    rows = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, n long")
    got = whitening.whiten(spark, rows).collect()
    assert sorted(map(str, [(r.vec_id, r.n) for r in got])) == sorted(map(str, [(a, c) for a, _, c in good]))
    assert all(len(r.white.whitened) == 2 and r.white.n == 32 for r in got)  # the constant entry has no component
    w = np.array([r.white.whitened for r in got])
    assert np.abs(w.T @ w / len(w) - np.eye(2)).max() < 1e-12
    pair = [r.white.whitened for r in got if r.vec_id == 0]
    assert len(pair) == 2 and pair[0] == pair[1]


def test_nothing_varies_and_nothing_there(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(4)], "vec_id long, embedding array<double>")
    assert [(r.white.whitened, r.white.identity_error, int(r.white.deviation)) for r in whitening.whiten(spark, same).collect()] == [([], 0.0, 0)] * 4
    empty = whitening.whiten(spark, same.limit(0), column="vec_id")
    assert empty.count() == 0 and empty.columns == ["embedding", "vec_id"]


def test_large_entries_stay_exact(spark):
    rows = [(0, [2.0**50, 1.0]), (1, [-(2.0**50), 3.0]), (2, [0.25, -7.0])]
    got = {r.vec_id: r.white for r in whitening.whiten(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = {k: [int(64 * c) + 1_000_000 for c in v] for k, v in rows}
    s = [sum(v[j] for v in x.values()) for j in range(2)]
    assert {k: int(w.deviation) for k, w in got.items()} == {k: sum((3 * v[j] - s[j]) ** 2 for j in range(2)) for k, v in x.items()}
