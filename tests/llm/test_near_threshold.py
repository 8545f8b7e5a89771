"""The threshold of near-duplicates as an argument, and the pipeline's own."""

import pytest

import corpus_pipeline
from tracegraph.llm import neardup


@pytest.fixture(scope="module")
def docs(spark):
    base = [f"w{k}" for k in range(104)]  # 100 shingles; a changed word at the end costs one, inside up to five
    near = [*base[:50], "other", *base[51:]]  # 95 of 105 shared: 0.905
    mid = [*base[:30], "one", *base[31:60], "two", *base[61:]]  # 90 of 110: 0.818
    far = [*mid[:80], "three", *mid[81:]]  # 85 of 115 with base: 0.739; with mid 95 of 105
    rows = [(1, base), (2, near), (3, mid), (4, [f"x{w}" for w in base])]
    return spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(base)), (4, " ".join(far))], "doc_id long, text string")


def test_plan():
    assert [(p.rows, p.bands, p.least(p.coordinates), p.least(neardup.LONG)) for p in map(neardup.Plan, (85, 80))] == [(6, 32, 0.73, 0.79), (5, 38, 0.66, 0.73)]


def test_thresholds(spark, docs):
    kept = lambda rows: sorted(r.doc_id for r in rows.collect() if r.kept)
    assert kept(neardup.near_duplicates(spark, docs[0], 85)) == [1, 3, 4]
    assert kept(neardup.near_duplicates(spark, docs[0], 80)) == [1, 4]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs[0], "").collect()) == [1, 4]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs[1], "").collect()) == [1, 4]
