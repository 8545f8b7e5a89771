"""Audits of result tables against values written by hand."""

from pyspark.sql import functions as F

from tracegraph.operators import audits
from tracegraph.plans import catalogue


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_numbers(spark):
    r = spark.createDataFrame([("a", 1, 2, 0.5, True), (None, 2, None, 1.5, False)], "spec string, fold int, n int, r2 double, ok boolean")
    assert rows(audits.numbers(r, "fit", ["spec", "fold"])) == [("fit", "spec=, fold=2", "r2", 1.5), ("fit", "spec=a, fold=1", "n", 2.0), ("fit", "spec=a, fold=1", "r2", 0.5)]
    assert rows(audits.numbers(r.limit(1).select("n"), "all", [])) == [("all", "", "n", 2.0)]
    assert rows(audits.numbers(r.select("spec", "ok"), "none", ["spec"])) == [] and rows(audits.numbers(r.limit(0), "none", ["spec"])) == []


def test_gathered_and_best(spark):
    r = spark.createDataFrame([("b", 0.9), ("a", 0.9), ("c", 0.1)], "spec string, accuracy double")
    found = audits.gathered(spark, {"one": (r, ["spec"]), "two": (r.agg(F.max("accuracy").alias("top")), [])})
    assert found.count() == 4
    assert rows(audits.best_of(found, "one", "accuracy")) == [("one", "spec=a", "accuracy", 0.9)]


def test_checked(spark):
    schema = "artifact string, case string, metric string, value double"
    found = spark.createDataFrame([("a", "", m, v) for m, v in (("w", 1.0), ("x", 1e9), ("y", 2.0), ("z", 0.0))], schema)
    claims = spark.createDataFrame([("a", "", m, v) for m, v in (("w", 1.0 + 1e-9), ("x", 1e9 + 1), ("y", 2.1), ("v", 3.0), ("u", None))], schema)
    assert {r.metric: r.status for r in audits.checked(found, claims).collect()} == {"w": "same", "x": "same", "y": "differs", "z": "new", "v": "gone", "u": "gone"}
    assert audits.checked(found.limit(0), claims.limit(0)).count() == 0


def test_reports_name_registered_queries():
    assert all(q in catalogue.SQL for q, _, _ in catalogue.audit.REPORTS.values())
