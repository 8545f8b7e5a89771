"""Runs of stages: finished parts are kept, what is missing or changed is made, an interrupted write is not taken for a result."""

import pytest
from pyspark.sql import functions as F

from tracegraph.operators import runs
from tracegraph.operators import traces as R
from tracegraph.plans import views as V

SF = "/root/testdata/sf0.001"


def test_a_stopped_run_goes_on(spark, tmp_path):
    made = []

    def part(k, fail=False):
        def make():
            made.append(k)
            if fail:
                raise RuntimeError("stopped")
            return spark.range(k).select(F.col("id"), F.lit(k).alias("k"))

        return make

    run = runs.Run(spark, str(tmp_path / "run"))
    assert run.ledger().count() == 0
    with pytest.raises(RuntimeError):
        run.stage("a", "v1", {"1": part(1), "2": part(2), "3": part(3, fail=True)})
    assert made == [1, 2, 3] and {r.key for r in run.ledger().collect()} == {"1", "2"}
    spark.range(99).write.parquet(f"{run.folder}/a/v1/3")  # what an interrupted write may leave
    again = runs.Run(spark, str(tmp_path / "run"))
    assert again.stage("a", "v1", {"1": part(1), "2": part(2), "3": part(3)}).count() == 6 and made == [1, 2, 3, 3]
    assert again.stage("a", "v1", {"1": part(1), "2": part(2), "3": part(3)}).count() == 6 and made == [1, 2, 3, 3]
    assert again.stage("a", "v2", {"1": part(1)}).count() == 1 and made[-1] == 1
    assert sorted((r.stage, r.key, r.version, r.rows) for r in again.ledger().collect()) == [("a", "1", "v1", 1), ("a", "1", "v2", 1), ("a", "2", "v1", 2), ("a", "3", "v1", 3)]


def test_proof_graph_end_to_end(spark, tmp_path, monkeypatch):
    """All stages equal their operators; stopped before mining and started again, edges and DAGs are not made anew."""
    traces = V.traces(spark, SF)
    options = {"min_support": 2, "min_theorems": 1, "min_gain": -9, "max_edges": 2, "max_tree_edges": 2}
    run = runs.Run(spark, str(tmp_path / "run"))
    real, calls = R.mine, []
    monkeypatch.setattr(R, "mine", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        runs.proof_graph(run, traces, "t1", 3, mining=options)
    monkeypatch.setattr(R, "mine", real)
    edges, dag = R.trace_edges, R.dag_edges
    monkeypatch.setattr(R, "trace_edges", lambda *a: calls.append("edges") or edges(*a))
    monkeypatch.setattr(R, "dag_edges", lambda *a: calls.append("dags") or dag(*a))
    out = runs.proof_graph(run, traces, "t1", 3, mining=options)
    assert calls == []
    want = edges(traces)
    key = lambda t: sorted((r.theorem, r.edge, r.kind) for r in t.collect())
    assert key(out["edges"]) == key(want) and out["dags"].count() == want.count()
    motifs = real(spark, dag(want), **options)
    assert {(r.signature, r.support) for r in out["motifs"].collect()} == {(r.signature, r.support) for r in motifs.collect()}
    assert {r.stage for r in run.ledger().collect()} == {"edges", "dags", "motifs"}
    runs.proof_graph(run, traces, "t2", 3)
    assert calls == ["edges"] * 3 + ["dags"]
