"""Motifs of theorems with equal DAGs: enumerated once, counted for all."""

from pyspark.sql import functions as F

from tracegraph.operators import traces as R

DDL = "theorem string, file_path string, edge string, in_node string, out_nodes array<string>, label struct<kind: string, head: string, lemma_tuple: array<string>, direction_tuple: array<string>>"


def _edges(theorem, path, steps, names):
    return [(theorem, path, name, at, outs, ("structural", head, [], [])) for name, (at, outs, head) in zip(names, steps)]


def test_equal_dags_are_enumerated_once(spark, monkeypatch):
    steps = [("1", ["2", "3"], "A"), ("2", ["4", "5"], "B"), ("3", ["6", "7"], "A")]
    rows = _edges("t2", "M/X/a", steps, "abc") + _edges("t1", "M/X/b", steps[::-1], "pqr") + _edges("t3", "M/Y/a", steps, "cab") + _edges("t4", "M/Y/a", steps[:2], "ab") + _edges("t4", None, [("9", [], "C")], "z")
    dag = spark.createDataFrame(rows, DDL)
    given, sets = [], R.branch_sets
    monkeypatch.setattr(R, "branch_sets", lambda s, d, high: given.append({r.theorem for r in d.select("theorem").distinct().collect()}) or sets(s, d, high))
    got = {(r.motif_kind, tuple(x.head for x in r.edge_labels), r.edge_count): r for r in R.mine(spark, dag, 2, 3, 3, min_support=1, min_theorems=1, min_gain=-9, max_examples=2).collect()}
    assert given[0] == {"t1", "t4"}  # the rest have the DAG of t1, whatever their edges are called
    path = got["path", ("A", "B"), 2]
    assert (path.support, path.distinct_theorems, path.distinct_files, path.node_count) == (5, 4, 3, 3)  # t4 stands in two files, one without a name
    assert [(e.theorem, e.edges) for e in path.examples] == [("t1", ["r", "q"]), ("t2", ["a", "b"])]
    three = next(r for k, r in got.items() if k[0] == "subtree" and k[2] == 3)
    assert (three.support, three.distinct_theorems, three.distinct_files, sum(three.categories.values())) == (3, 3, 3, 3)
    _, classes, members = R.alike(spark, dag)
    assert sorted((r.theorem, r.theorems, r.places) for r in classes.collect()) == [("t1", 3, 3), ("t4", 1, 2)]
    assert members.agg(F.sum("head")).first()[0] == 4
