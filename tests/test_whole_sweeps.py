"""Sweeps and matrices take every start and every edge, not a sample."""

import random

import duckdb
import pytest

from tracegraph.operators import graphs as G
from tracegraph.plans import catalogue, reports
from tracegraph.plans import views as V

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    return c


def test_every_start_is_swept(spark, con):
    got = catalogue.QUERIES["path_sweep_frontier"](spark, SF).orderBy("depth").toPandas()
    want = con.sql(catalogue.SQL["path_sweep_frontier"]).df().sort_values("depth").reset_index(drop=True)
    assert got.astype(float).equals(want[got.columns].astype(float))
    assert got["n_sources"][0] == V.succession(spark, SF).select("source").distinct().count() > 64


def test_every_edge_has_its_matrix(spark, monkeypatch):
    """Against breadth-first distances, on a graph with a hub whose edges are looked up in parts."""
    monkeypatch.setattr(G, "ASKED", 5)
    rng = random.Random(4)
    pairs = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(40)} | {(0, k) for k in range(1, 100)})
    near = {k: set() for p in pairs for k in p}
    for u, v in pairs:
        near[u].add(v)
        near[v].add(u)
    two = {k: set().union(*[near[m] for m in near[k]]) for k in near}
    d = lambda x, y: 0 if x == y else 1 if y in near[x] else 2 if y in two[x] else 3
    got = [tuple(r) for r in G.all_distances(spark, spark.createDataFrame(pairs, "u long, v long")).collect()]
    assert sorted(got) == sorted((u, v, x, y, d(x, y)) for u, v in pairs for x in near[u] for y in near[v])


def test_every_edge_has_its_certificate(spark, con, monkeypatch):
    """A hub of more than 80 neighbours is not left out."""
    pairs = [(0, k) for k in range(1, 100)] + [(k, k + 1) for k in range(1, 60)]
    monkeypatch.setattr(V, "succession", lambda s, d: s.createDataFrame(pairs, "source long, target long"))
    got = reports.curvature_certificates(spark, SF).collect()
    assert {(r.u, r.v) for r in got} == set(pairs) and max(r.m for r in got) == 99
    assert all((r.violated, r.misplaced, r.gap) == (0, 0, 0) for r in got)
