"""Letters of rules in either case are those of ASCII, in the query and in its twin."""

import duckdb

from tracegraph.llm import queries, secrets

TEXTS = ["paſsword=abcdefghij", "toKen=abcdefgh1", "PassWord = 'abcdefghij'", "API_KEY: abcdefgh12 apikey=12345678 api_key=1234567", "ſecret=abcdefghij secret=abcdefghij", None]


def test_letters(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in secrets.op1_secrets(spark, str(tmp_path)).collect()}
    assert {k: r.n_assign for k, r in got.items()} == {0: 0, 1: 0, 2: 1, 3: 2, 4: 1, 5: 0}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    names = list(got[0].asDict())
    want = con.execute(f"select {', '.join(names)} from ({queries.SQL['op1_secrets']})").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in got.values())
