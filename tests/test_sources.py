"""Readers and writers on files: splits, malformed lines, last lines, features, payloads and sources."""

import json

import pytest
from pyspark.sql import functions as F

from tracegraph.functions import text as T
from tracegraph.sources import artifacts as S


def test_splits_and_theorem_scan(spark, tmp_path):
    step = {"tactic": "rfl", "state_before": "⊢ x", "state_after": "no goals", "annotated_tactic": {"text": "rfl", "premises": []}}
    (tmp_path / "val.json").write_text(json.dumps([{"full_name": "b", "file_path": "f", "traced_tactics": [step, step]}, {"full_name": "", "file_path": "f", "traced_tactics": [step]}]))
    (tmp_path / "train.json").write_text(json.dumps([{"full_name": "a", "file_path": "f", "traced_tactics": []}]))
    rows = S.read_traces(spark, str(tmp_path))
    assert [(r.split, r.full_name) for r in rows.orderBy("ordinal").collect()] == [("train", "a"), ("val", "b"), ("val", "")]
    assert [tuple(r) for r in S.theorem_scan(rows).collect()] == [("b", "f", 2, 3, ["rfl", "rfl"])]
    assert S.read_traces(spark, str(tmp_path / "none")).count() == 0


def test_json_lines(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"k": 1, "v": "a"}\n\n{"k": 2, "v"\n{"k": 1, "v": "c"}\n')
    assert sorted((r.k, r.v) for r in S.read_jsonl(spark, str(path), "k long, v string", strict=False).collect()) == [(1, "a"), (1, "c")]
    with pytest.raises(Exception, match="[Mm]alformed"):
        S.read_jsonl(spark, str(path), "k long, v string").collect()
    assert S.read_jsonl(spark, str(tmp_path / "none"), "k long", missing_ok=True).count() == 0
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "b.json").write_text('{"k": 1, "v": "late"}\n{"k": 2, "v": "x"}\n')
    (folder / "a.json").write_text('{"k": 1, "v": "early"}\n{"k": 3, "v": "1"}\n{"k": 3, "v": "2"}\n')
    assert {r.k: r.v for r in S.read_last(spark, str(folder), "k long, v string", "k").collect()} == {1: "late", 2: "x", 3: "2"}


def test_features_payloads_and_sources(spark, tmp_path):
    (tmp_path / "f.csv").write_text("name,file_path,category,degree,low_1,low_2,high_1\na,f,C,3,1.5,2,7\nb,f,C,4,,2,7\n")
    assert [tuple(r) for r in S.read_features(spark, str(tmp_path / "f.csv")).collect()] == [("a", "f", "C", 3, [1.5, 2.0], [7.0])]
    rows = spark.createDataFrame([(k, f"n{k}", None) for k in range(25)], "k long, name string, extra string").repartition(4)
    S.write_payloads(rows, str(tmp_path / "p"), "k", 10, ["k", "name"])
    got = {r.k: (r.batch, r.name) for r in spark.read.json(str(tmp_path / "p")).collect()}
    assert got == {k: (k // 10, f"n{k}") for k in range(25)}
    (tmp_path / "src" / "A").mkdir(parents=True)
    for name in ("B.lean", "A/C.lean", "A/D.txt"):
        (tmp_path / "src" / name).write_text(name)
    assert sorted(r.content for r in S.read_sources(spark, str(tmp_path / "src"), ".lean").collect()) == ["A/C.lean", "B.lean"]
    assert [r.content for r in S.read_sources(spark, str(tmp_path / "src"), ".lean", limit=1).collect()] == ["A/C.lean"]
    assert S.read_sources(spark, str(tmp_path / "src")).count() == 3
    S.write_csv(rows.drop("extra"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 25
    S.write_summary(spark, {"a": [1, 2], "b": "é"}, str(tmp_path / "summary"))
    assert S.read_metadata(spark, str(tmp_path / "summary")) == {"a": [1, 2], "b": "é"}


def test_suggestions(spark):
    texts = ["Try this: simp only [a, b]", "Try this: simp only [a,\n    f (x, y), c]\nmore [z]", "Try this: simp only [a,\nb]", "nothing", None, "x\nTry this: aesop [[p, q], r] at h"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, m string")
    got = [r.x for r in rows.orderBy("k").select(T.suggested_lemmas(F.col("m")).alias("x")).collect()]
    assert got == [["a", "b"], ["a", "f (x, y)", "c"], None, None, None, ["[p, q]", "r"]]
    assert [r.x for r in rows.orderBy("k").select(T.has_brackets(F.col("m")).alias("x")).collect()] == [True, True, True, False, False, True]
