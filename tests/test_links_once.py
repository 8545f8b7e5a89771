"""The graph and the pairs of link prediction are made once, not again in every pass of the fit."""

from tracegraph.operators import learning as L
from tracegraph.operators import spectral as S
from tracegraph.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_graph_and_pairs_are_written(spark, monkeypatch):
    seen = []

    def coordinates(s, und):
        seen.append(und)
        degree = und.selectExpr("u as name").union(und.select("v")).distinct()
        return degree.selectExpr("name", "2L as degree", "array(name % 3D) as low", "array(name % 5D) as high"), None

    monkeypatch.setattr(S, "coordinates", coordinates)
    monkeypatch.setattr(L, "logistic_report", lambda rows: seen.append(rows) or rows)
    catalogue.QUERIES["link_prediction"](spark, SF)
    assert all("Window" not in (plan := f._jdf.queryExecution().executedPlan().toString()) and "lineitem" not in plan for f in seen)
    assert {"embedding", "label", "train"} == set(seen[1].columns) and seen[1].count() > 0


def test_coordinates_read_the_graph_once(spark):
    und = spark.createDataFrame([(k, (k + 1) % 9) for k in range(9)] + [(0, 4)], "u long, v long")
    c, _ = S.coordinates(spark, und, 2, 4)
    assert {r.name: r.degree for r in c.collect()} == {k: 3 if k in (0, 4) else 2 for k in range(9)}
    assert "Aggregate" not in c._jdf.queryExecution().executedPlan().toString()
