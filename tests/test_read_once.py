"""Queries that read their source tables once, and steps that move no more than is asked for."""

import random

import pytest
from pyspark.sql import functions as F

from tracegraph.operators import graphs as G
from tracegraph.operators import runs
from tracegraph.plans import catalogue, models, searches
from tracegraph.plans import views as V

SF = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


def _first_argument(monkeypatch, module, name, place):
    """What a function is first called with."""

    def stop(*args, **_):
        stop.seen = args[place]
        raise Seen

    monkeypatch.setattr(module, name, stop)
    return stop


def test_small_sets_are_written_before_their_passes(spark, monkeypatch):
    stop = _first_argument(monkeypatch, models.L, "regression_sets", 0)
    with pytest.raises(Seen):
        models.proof_length_small_sets(spark, SF)
    assert not any(SF in f for f in stop.seen.inputFiles()) and stop.seen.count() > 0


def test_non_edges_drop_far_edges_before_the_shuffle(spark):
    rows = catalogue.non_edges_anti(spark, SF)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "IN (1,-1)" in plan
    edges = {(r.source, r.target) for r in V.succession(spark, SF).collect()}
    keys = {r.p_partkey for r in V.table(spark, SF, "part").select("p_partkey").collect()}
    assert {tuple(r) for r in rows.collect()} == {(k, k + 1) for k in keys if (k, k + 1) not in edges and (k + 1, k) not in edges}


def test_feature_sets_are_written_before_their_passes(spark, monkeypatch):
    stop = _first_argument(monkeypatch, catalogue.L, "ridge_report", 1)
    with pytest.raises(Seen):
        catalogue.feature_set_comparison(spark, SF)
    assert not any(SF in f for f in stop.seen.inputFiles()) and stop.seen.count() > 0


def test_distances_of_few_edges(spark, monkeypatch):
    """As over all edges, with one-step pairs looked up between the asked nodes only."""
    rng = random.Random(2)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(90)})
    und = spark.createDataFrame(pairs, "u long, v long")
    few = spark.createDataFrame(pairs[::20], "u long, v long")
    written = []
    monkeypatch.setattr(G, "cut", lambda s, df, name, cut=G.cut: written.append(name) or cut(s, df, name))
    got = {tuple(r) for r in G.neighbourhood_distance(und, few).collect()}
    asked = set(pairs[::20])
    assert got == {tuple(r) for r in G.neighbourhood_distance(und).collect() if (r.u, r.v) in asked}
    assert written == ["near"] * 3


def test_a_run_reads_its_traces_once(spark, monkeypatch, tmp_path):
    stop = _first_argument(monkeypatch, runs.R, "trace_edges", 0)
    traces = V.traces(spark, SF)
    with pytest.raises(Seen):
        runs.proof_graph(runs.Run(spark, str(tmp_path / "run")), traces, SF, 2)
    assert not any(SF in f for f in stop.seen.inputFiles()) and stop.seen.columns == traces.columns
    assert stop.seen.count() == traces.where(runs.part_of(F.col("full_name"), 2) == 0).count()


def test_or_paths_need_no_theorems(spark, monkeypatch):
    stop = _first_argument(monkeypatch, searches.H, "or_paths", 1)
    with pytest.raises(Seen):
        searches.state_sweep(spark, SF)
    assert stop.seen.columns == ["input", "outputs"] and stop.seen.count() == stop.seen.distinct().count()
