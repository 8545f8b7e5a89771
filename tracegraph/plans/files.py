"""Queries that write an artifact into the shared folder and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import traces as R
from ..operators.runs import Run, proof_graph
from ..sources import artifacts as S
from . import views as V
from .iterate import shared_dir
from .registry import query


def _path(s, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {V.TAC} SELECT 'T' || theorem AS full_name, count(*) AS tactic_count, CAST(3 AS BIGINT) AS statement_len, string_agg(head, ',' ORDER BY idx) AS heads FROM tac GROUP BY theorem")
def theorem_scan(s, d):
    t = S.theorem_scan(V.traces(s, d))
    return t.select("full_name", F.col("tactic_count").cast("long").alias("tactic_count"), F.col("statement_len").cast("long").alias("statement_len"), F.concat_ws(",", "tactics").alias("heads"))


_ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"


def _orders(s, d):
    return V.table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def jsonl_sorted(s, d):
    S.write_sorted_jsonl(_orders(s, d), path := _path(s, "orders"), "o_orderkey")
    return S.read_jsonl(s, path, _ORDERS)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 0")
def jsonl_malformed_skipped(s, d):
    """Every tenth line is torn, and blank lines stand between."""
    line = F.to_json(F.struct(*_orders(s, d).columns))
    torn = F.when(F.col("o_orderkey") % 10 == 0, F.substring(line, 1, 20)).otherwise(line)
    _orders(s, d).select(F.explode(F.array(torn, F.lit(""))).alias("value")).write.text(path := _path(s, "torn"))
    return S.read_jsonl(s, path, _ORDERS, strict=False)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0")
def jsonl_missing_file(s, d):
    """Two shards of an artifact, of which one was never written: what there is is read."""
    S.append_jsonl(_orders(s, d).where("o_orderkey % 2 = 0"), path := _path(s, "shard"))
    return S.read_jsonl(s, path, _ORDERS, missing_ok=True).unionByName(S.read_jsonl(s, _path(s, "nowhere"), _ORDERS, missing_ok=True))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1")
def jsonl_last_wins(s, d):
    """Files in ranges of the order key, sorted: a customer's last line is that of the largest key."""
    _orders(s, d).repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").write.json(path := _path(s, "last"))
    return S.read_last(s, path, _ORDERS, "o_custkey")


@query("SELECT doc_id, lang, source FROM documents")
def jsonl_unsorted_and_appended(s, d):
    """Two writers add to one artifact; nothing is lost or written twice."""
    docs = V.table(s, d, "documents").select("doc_id", "lang", "source")
    path = _path(s, "appended")
    for k in range(2):
        S.append_jsonl(docs.where(F.col("doc_id") % 2 == k), path)
    return S.read_jsonl(s, path, "doc_id long, lang string, source string")


@query("WITH e AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 7 <> 3) SELECT CAST(vec_id AS VARCHAR) AS name, label AS degree, round(list_sum(list_transform(embedding[1:10], lambda v: CAST(v AS DOUBLE))), 4) + 0.0 AS low, round(list_sum(list_transform(embedding[33:42], lambda v: CAST(v AS DOUBLE))), 4) + 0.0 AS high FROM e")
def feature_csv(s, d):
    """A wide table of features; rows that lack a column (every seventh) are skipped on reading."""
    e = V.table(s, d, "embeddings").select(F.col("vec_id").alias("name"), F.lit("x.lean").alias("file_path"), F.lit("Area").alias("category"), F.col("label").alias("degree"), F.slice(F.col("embedding").cast("array<double>"), 1, 32).alias("low"), F.slice(F.col("embedding").cast("array<double>"), 33, F.when(F.col("vec_id") % 7 == 3, 5).otherwise(32)).alias("high"))
    S.write_features(e, path := _path(s, "features"), {"low": 32, "high": 32})
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v), 4) + 0.0
    return S.read_features(s, path).select("name", F.col("degree").cast("long").alias("degree"), total("low").alias("low"), total("high").alias("high"))


@query("SELECT 'rows' AS key, CAST(count(*) AS DOUBLE) AS value FROM embeddings UNION ALL SELECT 'width', CAST(max(len(embedding)) AS DOUBLE) FROM embeddings UNION ALL SELECT 'mean_' || k, round(avg(CAST(embedding[k] AS DOUBLE)), 6) + 0.0 FROM embeddings, (SELECT unnest(range(1, 4)) AS k) q GROUP BY k")
def feature_metadata(s, d):
    """A summary written as one JSON document beside a feature table."""
    means = [F.round(F.avg(F.col("embedding")[k].cast("double")), 6) + 0.0 for k in range(3)]
    first = V.table(s, d, "embeddings").agg(F.count("*"), F.max(F.size("embedding")), *means).first()
    S.write_summary(s, {"rows": first[0], "width": first[1], "means": list(first[2:])}, path := _path(s, "metadata"))
    held = S.read_metadata(s, path)
    pairs = [("rows", float(held["rows"])), ("width", float(held["width"])), *[(f"mean_{k}", float(v)) for k, v in enumerate(held["means"], 1)]]
    return s.createDataFrame(pairs, "key string, value double")


@query("SELECT vec_id AS name, len(embedding) AS width, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings")
def matrix_artifact(s, d):
    S.write_matrix(V.table(s, d, "embeddings"), path := _path(s, "matrix"), "vec_id", "embedding")
    return S.read_matrix(s, path).select("name", F.size("vec").cast("long").alias("width"), F.col("vec")[0].cast("double").alias("first"))


@query("SELECT CAST((row_number() OVER (ORDER BY p_partkey) - 1) // 64 AS BIGINT) AS batch, p_partkey, p_name, p_brand, p_type FROM part")
def batch_payloads(s, d):
    """Four fields in batches of 64 rows."""
    columns = ["p_partkey", "p_name", "p_brand", "p_type"]
    S.write_payloads(V.table(s, d, "part"), path := _path(s, "payload"), "p_partkey", 64, columns)
    return s.read.schema("p_partkey long, p_name string, p_brand string, p_type string, batch long").json(path).select("batch", *columns)


@query("SELECT source || '/' || doc_id || '.lean' AS path, sha256(text) AS content FROM documents WHERE doc_id % 2 = 0 ORDER BY path LIMIT 100")
def lean_files(s, d):
    """Names with the suffix, the first hundred by path."""
    docs = V.table(s, d, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".lean").otherwise(".txt"))
    return docs.select(path.alias("path"), F.sha2("text", 256).alias("content")).where(F.col("path").endswith(".lean")).orderBy("path").limit(100)


@query("SELECT doc_id, contains(text, '[') AS brackets FROM documents")
def explicit_brackets(s, d):
    return V.table(s, d, "documents").select("doc_id", T.has_brackets(F.col("text")).alias("brackets"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE len(string_split(trim(p_name), ' ')) END AS n, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE string_split(trim(p_name), ' ')[-1] END AS last FROM part WHERE len(trim(p_name)) > 0")
def suggested_lemmas(s, d):
    """Bracketed suggestions, some wrapped on indented lines; every third is not closed."""
    words = F.regexp_replace(F.trim("p_name"), " ", F.lit(",\n    "))
    close = F.when(F.col("p_partkey") % 3 == 0, "").otherwise("] at h")
    message = F.concat(F.lit("Try this: simp only ["), words, close, F.lit("\nnext line]"))
    lemmas = T.suggested_lemmas(message)
    parts = V.table(s, d, "part").where(F.length(F.trim("p_name")) > 0)
    return parts.select("p_partkey", F.coalesce(F.size(lemmas), F.lit(-1)).cast("long").alias("n"), F.element_at(lemmas, -1).alias("last"))


# ---- typed edges and figures of a trace ----------------------------------------------------------

_KINDS = "typed AS (SELECT *, CASE head WHEN 'click' THEN 'simp' WHEN 'view' THEN 'rw' WHEN 'error' THEN 'omega' WHEN 'signup' THEN 'exact' ELSE 'intro' END AS tactic FROM tac)"
_KIND = "CASE tactic WHEN 'omega' THEN 'decision_opaque' WHEN 'simp' THEN 'simp_bundle' WHEN 'rw' THEN 'rewrite_step' WHEN 'exact' THEN 'term' ELSE 'structural' END"


def typed_traces(s, d):
    """The traces with tactics of all five kinds."""
    names = {"click": "simp", "view": "rw", "error": "omega", "signup": "exact", "purchase": "intro"}
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    rename = lambda t: t.withField("tactic", F.create_map(*pairs)[t["tactic"]])
    return V.traces(s, d).withColumn("traced_tactics", F.transform("traced_tactics", rename))


@query(f"WITH {V.TAC}, {_KINDS} SELECT {_KIND} AS kind, count(*) AS n, CAST(count_if(tactic = 'simp') AS BIGINT) AS fallbacks, CAST(count_if(premise % 3 = 2) AS BIGINT) AS branching FROM typed GROUP BY 1")
def typed_edges(s, d):
    """Edges by kind, with how many stand for a whole bundle and how many branch."""
    e = R.trace_edges(typed_traces(s, d))
    return e.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("is_fallback").alias("fallbacks"), F.count_if("is_branching").alias("branching"))


@query(f"WITH {V.TAC}, {_KINDS} SELECT 'T' || theorem AS theorem, count(*) AS edges, count(DISTINCT tactic) AS heads, CAST(count_if(tactic IN ('simp', 'rw')) AS BIGINT) AS lemmas FROM typed GROUP BY 1")
def enrich_summary(s, d):
    """What an enrichment run reports for each theorem."""
    e = R.trace_edges(typed_traces(s, d))
    return e.groupBy("theorem").agg(F.count("*").alias("edges"), F.count_distinct("head").alias("heads"), F.sum(F.size("lemmas")).alias("lemmas"))


#: Parts of a run's edges.
PARTS = 4


@query(f"""WITH {V.TAC}, {_KINDS}, part AS (SELECT CAST('0x' || substr(md5('T' || theorem), 1, 8) AS BIGINT) % {PARTS} AS k FROM typed)
 SELECT 'edges' AS stage, CAST(p AS VARCHAR) AS key, (SELECT count(*) FROM part WHERE k = p) AS rows FROM range({PARTS}) r(p) UNION ALL SELECT 'dags', 'all', count(*) FROM part""")
def run_stage_counts(s, d):
    """Rows of each finished stage of a run over all traces, from its ledger."""
    run = Run(s, f"{shared_dir(s)}/run-{uuid.uuid4().hex}")
    proof_graph(run, typed_traces(s, d), d, PARTS)
    return run.ledger().select("stage", "key", "rows")
