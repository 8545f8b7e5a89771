"""Walks move over a table of edges that is bucketed once, not dealt anew at each step."""

from tracegraph.operators import graphs as G


def test_edges_of_walks_are_bucketed_by_place(spark, monkeypatch):
    tables = []

    def noted(s, df, keys, name, cut_by=G.cut_by):
        tables.append((keys, cut_by(s, df, keys, name)))
        return tables[-1][1]

    monkeypatch.setattr(G, "cut_by", noted)
    und = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (4, 5)], "u long, v long")
    walks = {(r.start, r.walk, r.step): r.node for r in G.random_walks(spark, und, 2, 5).collect()}
    around = {1: {2, 3}, 2: {1, 3}, 3: {1, 2}, 4: {5}, 5: {4}}
    assert len(walks) == 5 * 2 * 5
    assert all(walks[s, w, k + 1] in around[n] for (s, w, k), n in walks.items() if k < 4)
    assert [keys for keys, _ in tables] == [["node", "pos"]]
    assert not spark.catalog.tableExists(tables[0][1]._cut_table)
