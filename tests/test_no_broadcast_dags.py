"""Tables of edges and classes grow with the input and are not sent through the driver, however small their files are."""

import pytest

from tracegraph.operators import traces as R
from tracegraph.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["branch_subtrees", "dag_path_labels"])
def test_dags_are_not_broadcast(spark, monkeypatch, name):
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(R, "cut", lambda s, df, *rest, cut=R.cut: plans.append(plan(df)) or cut(s, df, *rest))
    plans.append(plan(catalogue.QUERIES[name](spark, SF)))
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
