"""Walks are made from one reading of the graph, and sentences are gathered once for vocabulary and training."""

from tracegraph.operators import graphs as G
from tracegraph.operators import spectral as S


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_graph_is_read_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(G, "indexed", lambda s, edges, indexed=G.indexed: seen.append(_plan(edges)) or indexed(s, edges))
    und = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 2)], "u long, v long").distinct()
    assert G.random_walks(spark, und, 2, 3).count() == 4 * 2 * 3
    assert "Aggregate" not in seen[0] and "parquet" in seen[0]


def test_sentences_are_written(spark, monkeypatch):
    import pyspark.ml.feature as ml

    seen, fit = [], ml.Word2Vec.fit
    monkeypatch.setattr(ml.Word2Vec, "fit", lambda self, rows: seen.append(rows) or fit(self, rows))
    und = spark.createDataFrame([(k, (k + 1) % 8) for k in range(8)], "u long, v long")
    assert S.walk_embeddings(spark, und, 2, 4, size=4).count() == 8
    assert "Exchange" not in _plan(seen[0]) and seen[0].count() == 16 and {len(r.tokens) for r in seen[0].collect()} == {4}
