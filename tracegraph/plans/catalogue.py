"""The query catalogue: for each key a DataFrame query and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import declarations as D
from ..operators import graphs as G
from ..operators import learning as L
from ..operators import mining as M
from ..operators import spectral as S
from ..operators import traces as R
from . import files, models, reports, searches, texts  # noqa: F401  (they register their queries)
from . import views as V
from .iterate import cut
from .registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]


def _occurrences(s: SparkSession, d: str) -> DataFrame:
    return V.tactics(s, d).select(F.col("theorem").alias("source"), F.col("premise").alias("target"), "head", "idx", "ord")


# ---- dependency graph -------------------------------------------------------------------------


@query(f"WITH {V.TAC} SELECT theorem AS source, premise AS target, arg_min(head, ord) AS head, min(ord) AS first_idx, count(*) AS occurrences FROM tac GROUP BY 1, 2")
def dep_edges(s, d):
    return G.first_edges(_occurrences(s, d), "ord")


@query(f"WITH {V.TAC} SELECT theorem AS source, premise AS target, count(*) AS occurrences FROM tac GROUP BY 1, 2 ORDER BY occurrences DESC, source, target LIMIT 20")
def top_dep_edges(s, d):
    return G.first_edges(_occurrences(s, d), "ord").select("source", "target", "occurrences").orderBy(F.desc("occurrences"), "source", "target").limit(20)


@query(f"WITH {V.TAC}, sight AS (SELECT theorem AS name, 'theorem' AS kind, 2 * ord AS o FROM tac UNION ALL SELECT premise, 'premise', 2 * ord + 1 FROM tac) SELECT name, arg_min(kind, o) AS kind, count(*) AS sightings FROM sight GROUP BY 1")
def dep_nodes(s, d):
    t = V.tactics(s, d)
    sight = t.select(F.col("theorem").alias("name"), F.lit("theorem").alias("kind"), (2 * F.col("ord")).alias("o")).union(t.select("premise", F.lit("premise"), 2 * F.col("ord") + 1))
    return sight.groupBy("name").agg(F.min_by("kind", "o").alias("kind"), F.count("*").alias("sightings"))


@query(f"WITH {V.TAC} SELECT count(DISTINCT theorem) AS theorems, count(*) AS occurrences, count(DISTINCT (theorem, premise)) AS edges, count(DISTINCT premise) AS premises FROM tac")
def dep_stats(s, d):
    e = V.tactics(s, d).groupBy("theorem", "premise").agg(F.count("*").alias("n"))
    return e.agg(F.count_distinct("theorem").alias("theorems"), F.sum("n").alias("occurrences"), F.count("*").alias("edges"), F.count_distinct("premise").alias("premises"))


@query(f"WITH {V.TAC} SELECT head, count(*) AS n FROM tac GROUP BY head ORDER BY n DESC, min(ord) LIMIT 20")
def top_heads(s, d):
    return V.tactics(s, d).groupBy("head").agg(F.count("*").alias("n"), F.min("ord").alias("o")).orderBy(F.desc("n"), "o").limit(20).select("head", "n")


@query(f"WITH {V.TAC}, {V.CAT} SELECT category, count(*) AS n FROM tac JOIN cat ON theorem = name GROUP BY category ORDER BY n DESC, category LIMIT 20")
def top_source_categories(s, d):
    n = V.tactics(s, d).groupBy("theorem").agg(F.count("*").alias("n"))
    return n.join(V.categories(s, d), n.theorem == F.col("name")).groupBy("category").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "category").limit(20)


_DEG = f"""WITH {V.SUC}, e AS (SELECT DISTINCT source, target FROM suc), ends AS (SELECT source AS name, 1 AS o, 0 AS i FROM e UNION ALL SELECT target, 0, 1 FROM e),
 deg AS (SELECT name, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM ends GROUP BY name)"""


@query(f"{_DEG} SELECT * FROM deg")
def in_out_degree(s, d):
    return G.degrees(V.succession(s, d))


@query(f"{_DEG} SELECT name, in_degree + out_degree AS degree FROM deg")
def total_degree(s, d):
    return G.degrees(V.succession(s, d)).select("name", (F.col("in_degree") + F.col("out_degree")).alias("degree"))


_UND = f"{V.SUC}, und AS (SELECT DISTINCT least(source, target) AS u, greatest(source, target) AS v FROM suc WHERE source <> target), sym AS (SELECT u, v FROM und UNION ALL SELECT v, u FROM und)"


@query(f"WITH {_UND} SELECT u, v FROM und")
def undirected_edges(s, d):
    return G.undirected(V.succession(s, d))


@query(f"WITH {_UND} SELECT u AS name, count(*) AS degree FROM sym GROUP BY u ORDER BY degree DESC, name LIMIT 30")
def top_hubs(s, d, arcs=None):
    return G.symmetric(G.undirected(V.succession(s, d) if arcs is None else arcs)).groupBy(F.col("u").alias("name")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "name").limit(30)


# ---- joins ----------------------------------------------------------------------------------


@query(f"WITH {V.TAC}, {V.CAT}, n AS (SELECT theorem AS name FROM tac UNION SELECT premise FROM tac) SELECT n.name, coalesce(category, 'UNKNOWN') AS category FROM n LEFT JOIN cat ON n.name = cat.name")
def node_meta_left(s, d):
    t = V.tactics(s, d)
    n = t.select(F.col("theorem").alias("name")).union(t.select("premise")).distinct()
    return n.join(V.categories(s, d), "name", "left").select("name", F.coalesce("category", F.lit("UNKNOWN")).alias("category"))


@query(f"WITH {V.SUC}, f AS (SELECT p_partkey AS k FROM part WHERE p_size <= 25) SELECT DISTINCT source, target FROM suc WHERE source IN (SELECT k FROM f) AND target IN (SELECT k FROM f)")
def both_endpoints_semi(s, d):
    f = V.table(s, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("k"))
    e = V.succession(s, d).distinct()
    return e.join(f, e.source == f.k, "left_semi").join(f, e.target == f.k, "left_semi")


@query(f"WITH {V.SUC}, e AS (SELECT DISTINCT source, target FROM suc), c AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part) SELECT a, b FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE (source = a AND target = b) OR (source = b AND target = a))")
def non_edges_anti(s, d):
    c = V.table(s, d, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    gap = F.col("target") - F.col("source")  # other edges cannot be a pair (a, a + 1)
    e = V.succession(s, d).where(gap.isin(1, -1))
    both = e.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return c.join(both, ["a", "b"], "left_anti")


@query("WITH p AS (SELECT p_partkey, p_name, regexp_extract(p_name, '([^ ]+)$', 1) AS suffix FROM part), u AS (SELECT suffix, min(p_partkey) AS only_key FROM p GROUP BY suffix HAVING count(*) = 1) SELECT p_partkey, only_key FROM p LEFT JOIN u ON p.suffix = u.suffix")
def unique_suffix_lookup(s, d):
    p = V.table(s, d, "part").select("p_partkey", F.regexp_extract("p_name", "([^ ]+)$", 1).alias("suffix"))
    u = p.groupBy("suffix").agg(F.count("*").alias("n"), F.min("p_partkey").alias("only_key")).where("n = 1").drop("n")
    return p.join(u, "suffix", "left").select("p_partkey", "only_key")


@query(f"{_DEG} SELECT p_partkey AS name, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree FROM part LEFT JOIN deg ON p_partkey = name")
def degree_default_zero(s, d):
    p = V.table(s, d, "part").select(F.col("p_partkey").alias("name"))
    zero = F.lit(0).cast("long")
    return p.join(G.degrees(V.succession(s, d)), "name", "left").select("name", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))


# ---- matrices and statistics ----------------------------------------------------------------

_AREA = f"""{V.TAC}, {V.CAT}, area AS (SELECT category AS src, p_brand AS tgt, head, count(*) AS n FROM tac JOIN cat ON theorem = name JOIN part ON premise = p_partkey GROUP BY 1, 2, 3)"""


def _areas(s, d):
    n = V.tactics(s, d).groupBy("theorem", "premise", "head").agg(F.count("*").alias("n"))
    p = V.table(s, d, "part").select(F.col("p_partkey").alias("premise"), F.col("p_brand").alias("tgt"))
    return n.join(V.categories(s, d), n.theorem == F.col("name")).join(p, "premise").groupBy(F.col("category").alias("src"), "tgt", "head").agg(F.sum("n").alias("n"))


@query(f"WITH {_AREA} SELECT src, tgt, CAST(sum(n) AS BIGINT) AS n FROM area GROUP BY 1, 2")
def cross_area_matrix(s, d):
    return _areas(s, d).groupBy("src", "tgt").agg(F.sum("n").alias("n"))


@query(f"WITH {_AREA}, m AS (SELECT src, tgt, sum(n) AS n FROM area GROUP BY 1, 2) SELECT src, tgt, round(n / sum(n) OVER (PARTITION BY src), 6) AS share FROM m")
def cross_area_row_norm(s, d):
    m = _areas(s, d).groupBy("src", "tgt").agg(F.sum("n").alias("n"))
    return m.select("src", "tgt", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("src")), 6).alias("share"))


@query(f"WITH {_AREA}, top AS (SELECT head FROM area GROUP BY head ORDER BY sum(n) DESC, head LIMIT 3), m AS (SELECT src, head, sum(n) AS n FROM area WHERE head IN (SELECT head FROM top) GROUP BY 1, 2) SELECT src, head, round(n / sum(n) OVER (PARTITION BY src), 6) AS share FROM m")
def tactic_mix_top(s, d):
    a = _areas(s, d)
    top = a.groupBy("head").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "head").limit(3).select("head")
    m = a.join(top, "head", "left_semi").groupBy("src", "head").agg(F.sum("n").alias("n"))
    return m.select("src", "head", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("src")), 6).alias("share"))


@query(f"WITH {_AREA} SELECT src, head, CAST(sum(n) AS BIGINT) AS n FROM area GROUP BY 1, 2")
def weighted_pair_counts(s, d):
    return _areas(s, d).groupBy("src", "head").agg(F.sum("n").alias("n"))


@query(f"WITH {_AREA} SELECT src, head, CAST(sum(n) AS BIGINT) AS n FROM area GROUP BY GROUPING SETS ((src), (head), (src, head), ())")
def grouping_sets_counts(s, d):
    return _areas(s, d).groupingSets([["src"], ["head"], ["src", "head"], []], "src", "head").agg(F.sum("n").alias("n"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS most FROM events GROUP BY 1")
def depth_percentiles(s, d):
    n = V.table(s, d, "events").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)), F.col("n")).alias("p")
    g = n.groupBy("event_type").agg(F.round(F.sum(F.col("value") * F.col("n")) / F.sum("n"), 6).alias("mean"), p, F.max("value").alias("most"))
    return g.select("event_type", "mean", *[F.round(F.col("p")[k], 6).alias(c) for k, c in enumerate(("median", "p90", "p99"))], "most")


@query("WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT CAST(least(19, floor((o_totalprice - lo) / ((hi - lo) / 20))) AS BIGINT) AS bin, count(*) AS n FROM orders, r GROUP BY 1")
def equal_width_hist20(s, d):
    o = V.table(s, d, "orders")
    r = o.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    b = F.least(F.lit(19), F.floor((F.col("o_totalprice") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 20))).cast("long")
    return o.join(F.broadcast(r)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))  # one row


@query(f"{_DEG}, h AS (SELECT in_degree + out_degree AS x, count(*) AS n FROM deg GROUP BY 1) SELECT x, round(sum(n) OVER (ORDER BY x DESC) / (SELECT sum(n) FROM h), 6) AS p FROM h")
def ccdf_degree(s, d, arcs=None):
    h = G.degrees(V.succession(s, d) if arcs is None else arcs, arcs is not None).groupBy((F.col("in_degree") + F.col("out_degree")).alias("x")).agg(F.count("*").alias("n"))
    return L.ccdf(h, "x", "n").select("x", F.round("p", 6).alias("p"))


@query("SELECT event_type, round(avg(CAST(value < 50 AS DOUBLE)), 6) AS below, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def fraction_below(s, d):
    return V.table(s, d, "events").groupBy("event_type").agg(F.round(F.avg((F.col("value") < 50).cast("double")), 6).alias("below"), F.min("value").alias("low"), F.max("value").alias("high"))


# ---- sampling -------------------------------------------------------------------------------

_BUCKET = "((((CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT) % 10) * 6 + CAST(('0x' || substr(md5({0}), 9, 8)) AS BIGINT)) % 10 * 6 + CAST(('0x' || substr(md5({0}), 17, 8)) AS BIGINT)) % 10 * 6 + CAST(('0x' || substr(md5({0}), 25, 8)) AS BIGINT)) % 10"


@query(f"SELECT doc_id, CAST({_BUCKET.format('CAST(doc_id AS VARCHAR)')} AS BIGINT) AS bucket FROM documents")
def hash_split(s, d):
    return V.table(s, d, "documents").select("doc_id", T.stable_bucket(F.col("doc_id").cast("string")).alias("bucket"))


@query(f"WITH e AS (SELECT *, {_BUCKET.format('CAST(vec_id AS VARCHAR)')} < 8 AS train FROM embeddings), k AS (SELECT label FROM e WHERE train GROUP BY label HAVING count(*) >= 25) SELECT vec_id, label, train FROM e WHERE label IN (SELECT label FROM k)")
def class_min_support(s, d):
    e = V.table(s, d, "embeddings").select("vec_id", "label", (T.stable_bucket(F.col("vec_id").cast("string")) < 8).alias("train"))
    return e.join(e.where("train").groupBy("label").count().where("count >= 25"), "label", "left_semi").select("vec_id", "label", "train")


@query("WITH c AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n, count(*) OVER () AS total FROM documents) SELECT doc_id, lang FROM c WHERE rn <= greatest(1, round_even(100.0 * n / total, 0))")
def stratified_proportional(s, d):
    return L.stratified_share(V.table(s, d, "documents").select("doc_id", "lang"), "lang", 100, F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").select("doc_id", "lang")


@query("WITH c AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n, min(doc_id) OVER (PARTITION BY source) AS f FROM documents) SELECT doc_id, source FROM c ORDER BY rn, n DESC, f LIMIT 50")
def stratified_round_robin(s, d):
    return L.round_robin(V.table(s, d, "documents").select("doc_id", "source"), "source", "doc_id", 50).select("doc_id", "source")


@query("SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '::7'), doc_id LIMIT 40")
def hash_sample_pairs(s, d):
    return V.table(s, d, "documents").select("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("::7")).cast("binary")), "doc_id").limit(40)


# ---- text -----------------------------------------------------------------------------------


@query(r"SELECT doc_id, regexp_extract(text, '^\s*(\S+)', 1) AS head FROM documents")
def tactic_head(s, d):
    return V.table(s, d, "documents").select("doc_id", T.tactic_head(F.col("text")).alias("head"))


@query("SELECT page_id, CASE WHEN len(string_split(url, '/')) >= 4 THEN string_split(url, '/')[3] ELSE 'UNKNOWN' END AS host FROM pages")
def category_from_path(s, d):
    parts = F.split("url", "/")
    return V.table(s, d, "pages").select("page_id", F.when(F.size(parts) >= 4, parts[2]).otherwise("UNKNOWN").alias("host"))


@query("SELECT p_partkey, split_part(p_type, ' ', 1) AS prefix, regexp_extract(p_type, '([^ ]*)$', 1) AS segment FROM part")
def namespace_prefix(s, d):
    return V.table(s, d, "part").select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("prefix"), F.substring_index("p_type", " ", -1).alias("segment"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS state FROM documents")
def state_hash16(s, d):
    return V.table(s, d, "documents").select("doc_id", T.sha16(F.col("text")).alias("state"))


@query(r"SELECT doc_id, substr(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), 1, 220) AS excerpt FROM documents")
def excerpt(s, d):
    return V.table(s, d, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query("SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), 1, 140) AS name FROM pages")
def safe_name(s, d):
    return V.table(s, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}_][\p{L}\p{N}_''.]*')) AS n FROM documents")
def identifier_tokens(s, d):
    return V.table(s, d, "documents").select("doc_id", F.size(T.identifiers(F.col("text"))).cast("long").alias("n"))


@query(r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS lines FROM documents")
def multi_line_split(s, d):
    return V.table(s, d, "documents").select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("long").alias("lines"))


@query("SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS code FROM conversations WHERE role = 'assistant'")
def fenced_code_last(s, d):
    c = V.table(s, d, "conversations").where("role = 'assistant'")
    wrapped = F.concat(F.lit("```lean\nold\n```\n```lean4\n"), F.col("text"), F.lit("\n```"))
    return c.select("conv_id", "turn", T.last_code_block(wrapped).alias("code"))


@query(r"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '\b(idiot|trash)\b')")
def sorry_filter(s, d):
    return V.table(s, d, "documents").where(~F.col("text").rlike(r"\b(idiot|trash)\b")).select("doc_id")


@query("SELECT item_id, 'Complete:' || chr(10) || text || chr(10) || 'by' AS prompt FROM benchmark")
def prompt_build(s, d):
    return V.table(s, d, "benchmark").select("item_id", F.concat(F.lit("Complete:\n"), F.col("text"), F.lit("\nby")).alias("prompt"))


@query("SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events")
def json_props(s, d):
    return V.table(s, d, "events").select("event_id", F.from_json("props", "k long").k.alias("k"))


# ---- states ---------------------------------------------------------------------------------

_NODE = f"""WITH {V.STA}, side AS (SELECT before AS state FROM sta UNION ALL SELECT after FROM sta WHERE after <> 'no goals'), nodes AS (
 SELECT substr(sha256(state), 1, 16) AS id, state, count(*) AS occurrences FROM side GROUP BY state UNION ALL SELECT 'NOGOALS__________', 'no goals', 0)"""


@query(f"{_NODE} SELECT id, state, occurrences FROM nodes")
def state_nodes(s, d):
    return M.state_nodes(V.states(s, d))


_HYPER = f"WITH {V.STA} SELECT before AS input, head, after AS output, count(*) AS occurrences, count(DISTINCT theorem) AS theorems FROM sta GROUP BY 1, 2, 3"


@query(_HYPER)
def state_hyperedges(s, d):
    return M.hyperedges(V.states(s, d)).select("input", "head", F.col("outputs")[0].alias("output"), "occurrences", "theorems")


@query(f"WITH h AS ({_HYPER}), g AS (SELECT input, head, count(*) AS outs FROM h GROUP BY 1, 2) SELECT outs, count(*) AS n FROM g GROUP BY 1")
def output_size_hist(s, d):
    g = M.hyperedges(V.states(s, d)).groupBy("input", "head").agg(F.count("*").alias("outs"))
    return g.groupBy("outs").agg(F.count("*").alias("n"))


@query(f"WITH h AS ({_HYPER}) SELECT split_part(input, ':', 2) AS source, CASE WHEN output = 'no goals' THEN output ELSE split_part(output, ':', 2) END AS target, CAST(sum(occurrences) AS BIGINT) AS n FROM h GROUP BY 1, 2")
def state_goal_remap(s, d):
    h = M.hyperedges(V.states(s, d)).select("input", F.explode("outputs").alias("output"), "occurrences")
    goal = lambda c: F.when(F.col(c) == "no goals", F.col(c)).otherwise(F.split_part(c, F.lit(":"), F.lit(2)))
    return h.groupBy(goal("input").alias("source"), goal("output").alias("target")).agg(F.sum("occurrences").alias("n"))


@query(f"WITH {V.STA} SELECT theorem, substr(sha256(before), 1, 16) AS initial FROM sta WHERE idx = 0")
def initial_states(s, d):
    return V.states(s, d).where("idx = 0").select("theorem", T.state_id(F.col("before")).alias("initial"))


@query(f"WITH {V.STA} SELECT c_custkey AS name, before AS state, head FROM customer LEFT JOIN (SELECT * FROM sta WHERE idx = 0) f ON theorem = c_custkey")
def lookup_by_name(s, d):
    names = V.table(s, d, "customer").select(F.col("c_custkey").alias("name"))
    return names.join(V.states(s, d).where("idx = 0"), F.col("name") == F.col("theorem"), "left").select("name", F.col("before").alias("state"), "head")


# ---- paths ----------------------------------------------------------------------------------

_STARTS = "starts AS (SELECT source AS start FROM (SELECT DISTINCT source FROM e) x ORDER BY md5(CAST(source AS VARCHAR)), source LIMIT 200)"
_BFS = f"""WITH RECURSIVE {V.SUC}, e AS (SELECT DISTINCT source, target FROM suc), {_STARTS},
 r AS (SELECT start, start AS node, 0 AS depth FROM starts UNION SELECT r.start, e.target, r.depth + 1 FROM r JOIN e ON r.node = e.source WHERE r.depth < 2),
 b AS (SELECT start, node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY 1, 2)"""


def _starts(e):
    """A hash-ordered sample of 200 starts, the operator's default."""
    order = F.md5(F.col("source").cast("string").cast("binary"))
    return e.select("source").distinct().orderBy(order, "source").limit(200).select(F.col("source").alias("start"), F.col("source").alias("node"))


@query(f"{_BFS} SELECT start, node, depth FROM b")
def bfs_levels(s, d):
    e = V.succession(s, d)
    return G.bfs(s, e, _starts(e), 2).select("start", "node", "depth")


@query(f"{_BFS} SELECT start, depth, count(*) AS n FROM b GROUP BY 1, 2")
def frontier_sizes(s, d):
    e = V.succession(s, d)
    return G.bfs(s, e, _starts(e), 2).groupBy("start", "depth").agg(F.count("*").alias("n"))


@query(f"""{_BFS}, g AS (SELECT start, max(node) AS node FROM b WHERE depth = 2 GROUP BY start), m AS (SELECT g.start, g.node, min(e.source) AS mid FROM g JOIN e ON e.target = g.node JOIN b ON b.start = g.start AND b.node = e.source AND b.depth = 1 GROUP BY 1, 2)
 SELECT start, CAST(0 AS BIGINT) AS step, start AS node FROM m UNION ALL SELECT start, 1, mid FROM m UNION ALL SELECT start, 2, node FROM m""")
def bfs_shortest_path(s, d):
    e = V.succession(s, d)
    reached = G.bfs(s, e, _starts(e), 2)
    goals = reached.where("depth = 2").groupBy("start").agg(F.max("node").alias("node"))
    return G.walk_back(s, reached, goals, 2)


@query(f"{_BFS}, p AS (SELECT start, goal FROM (SELECT start, lead(start) OVER (ORDER BY md5(CAST(start AS VARCHAR)), start) AS goal FROM starts) x WHERE goal IS NOT NULL) SELECT p.start, p.goal, depth IS NOT NULL AS found, coalesce(depth, -1) AS depth FROM p LEFT JOIN b ON b.start = p.start AND b.node = p.goal")
def pair_reachability(s, d):
    e = V.succession(s, d)
    w = Window.orderBy(F.md5(F.col("start").cast("string").cast("binary")), "start")  # 200 sampled starts
    pairs = _starts(e).select("start", F.lead("start").over(w).alias("goal")).where("goal is not null")
    b = G.bfs(s, e, _starts(e), 2).select("start", F.col("node").alias("goal"), "depth")
    return pairs.join(b, ["start", "goal"], "left").select("start", "goal", F.col("depth").isNotNull().alias("found"), F.coalesce("depth", F.lit(-1).cast("long")).alias("depth"))


_OR = f"""WITH RECURSIVE {V.STA}, e AS (SELECT DISTINCT before AS source, after AS target FROM sta),
 r AS (SELECT before AS start, before AS node, 0 AS depth FROM sta WHERE idx = 0 UNION SELECT r.start, e.target, r.depth + 1 FROM r JOIN e ON r.node = e.source WHERE r.depth < 2)"""


@query(f"{_OR} SELECT start, node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY 1, 2")
def or_reachability(s, d):
    t = V.states(s, d)
    e = t.select(F.col("before").alias("source"), F.col("after").alias("target"))
    b = t.where("idx = 0").select(F.col("before").alias("start"), F.col("before").alias("node")).distinct()
    return M.text_bfs(s, e, b, 2)


@query(f"""WITH {V.STA}, m AS (SELECT DISTINCT before AS input, head, after AS output FROM sta), n AS (SELECT input, head, count(*) AS needed FROM m GROUP BY 1, 2),
 s0 AS (SELECT 'no goals' AS node, 0 AS depth), s1 AS (SELECT * FROM s0 UNION ALL SELECT DISTINCT n.input, 1 FROM n JOIN (SELECT input, head, count(*) AS have FROM m JOIN s0 ON output = node GROUP BY 1, 2) h ON n.input = h.input AND n.head = h.head WHERE have = needed AND n.input NOT IN (SELECT node FROM s0)),
 s2 AS (SELECT * FROM s1 UNION ALL SELECT DISTINCT n.input, 2 FROM n JOIN (SELECT input, head, count(*) AS have FROM m JOIN s1 ON output = node GROUP BY 1, 2) h ON n.input = h.input AND n.head = h.head WHERE have = needed AND n.input NOT IN (SELECT node FROM s1))
 SELECT node, CAST(depth AS BIGINT) AS depth FROM s2""")
def discharge_fixpoint(s, d):
    m = V.states(s, d).groupBy(F.col("before").alias("input"), "head").agg(F.collect_set("after").alias("outputs")).withColumn("id", F.concat_ws("/", "input", "head"))
    return G.discharge(s, m, s.createDataFrame([("no goals",)], "node string"), 2)


@query(f"WITH {V.STA} SELECT head, count(*) AS n, CAST(count_if(after = 'no goals') AS BIGINT) AS found, round(avg(CAST(after = 'no goals' AS DOUBLE)), 6) AS rate FROM sta GROUP BY head HAVING count(*) >= 5")
def reach_rate_by_head(s, d):
    done = F.col("after") == "no goals"
    return V.states(s, d).groupBy("head").agg(F.count("*").alias("n"), F.count_if(done).alias("found"), F.round(F.avg(done.cast("double")), 6).alias("rate")).where("n >= 5")


@query(f"""WITH RECURSIVE {_UND}, root AS (SELECT u FROM sym GROUP BY u HAVING min(v) > u), r AS (SELECT u AS root, u AS node FROM root UNION SELECT r.root, sym.v FROM r JOIN sym ON r.node = sym.u) SELECT node AS name, min(root) AS component FROM r GROUP BY node""")
def wcc(s, d):
    """Of the whole succession graph. The twin starts from local minima, among which every component's least node is."""
    return G.weak_components(s, V.succession(s, d))


# ---- mining ---------------------------------------------------------------------------------

_STEP = f"{V.TAC}, st AS (SELECT theorem, idx, head FROM tac)"


@query(f"WITH {_STEP} SELECT a.head || '>' || b.head || '>' || c.head AS motif, count(*) AS support, count(DISTINCT a.theorem) AS theorems FROM st a JOIN st b ON a.theorem = b.theorem AND b.idx = a.idx + 1 JOIN st c ON c.theorem = b.theorem AND c.idx = b.idx + 1 GROUP BY 1 HAVING count(*) >= 3")
def path_motifs_len3(s, d):
    return M.path_motifs(V.tactics(s, d), 3).where("support >= 3").select("motif", "support", "theorems")


@query(f"WITH {_STEP} SELECT a.head || '>' || b.head AS motif, count(*) AS support, (2 - 1) * count(*) - 2 AS gain FROM st a JOIN st b ON a.theorem = b.theorem AND b.idx = a.idx + 1 GROUP BY 1 ORDER BY gain DESC, motif LIMIT 100")
def motif_support_gain(s, d):
    m = M.path_motifs(V.tactics(s, d), 2)
    return m.select("motif", "support", T.motif_gain(F.lit(2), F.col("support")).alias("gain")).orderBy(F.desc("gain"), "motif").limit(100)


@query(f"WITH {_STEP}, m AS (SELECT a.head || '>' || b.head AS motif, a.theorem, a.idx, row_number() OVER (PARTITION BY a.head || '>' || b.head ORDER BY a.theorem, a.idx) AS rn FROM st a JOIN st b ON a.theorem = b.theorem AND b.idx = a.idx + 1) SELECT motif, theorem, idx FROM m WHERE rn <= 5")
def motif_examples(s, d):
    return M.path_examples(V.tactics(s, d), 2, 5)


@query(f"WITH {V.TAC} SELECT CASE WHEN head IN ('click', 'view') THEN 'bundle' WHEN premise % 2 = 0 THEN 'step' ELSE 'structural' END AS kind, count(*) AS n FROM tac GROUP BY 1")
def edges_by_kind(s, d):
    return V.tactics(s, d).groupBy(F.when(F.col("head").isin("click", "view"), "bundle").when(F.col("premise") % 2 == 0, "step").otherwise("structural").alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {V.TRE}, e AS (SELECT theorem, edge, pos, label, unnest([2 * pos, 2 * pos + 1]) AS nxt FROM tre), p AS (SELECT DISTINCT a.theorem, a.edge AS start, a.pos AS root, b.edge AS e2, a.pos || a.label AS p1, b.pos || b.label AS p2, b.pos AS pos2, a.pos AS pos1 FROM e a JOIN tre b ON a.theorem = b.theorem AND a.nxt = b.pos AND a.edge <> b.edge),
 q AS (SELECT DISTINCT p.theorem, p.start, p.root, least(e2, c.edge) AS x, greatest(e2, c.edge) AS y, p1, least(p2, c.pos || c.label) AS p2, greatest(p2, c.pos || c.label) AS p3 FROM p JOIN tre c ON p.theorem = c.theorem AND c.edge <> p.start AND c.edge <> p.e2 AND (c.pos // 2 = p.pos1 OR c.pos // 2 = p.pos2) AND c.pos > 1),
 m AS (SELECT theorem, root, 2 AS edges, p1 || '+' || p2 AS shape FROM p UNION ALL SELECT theorem, root, 3, p1 || '+' || p2 || '+' || p3 FROM q)
 SELECT root, CAST(edges AS BIGINT) AS edges, shape, count(*) AS support, count(DISTINCT theorem) AS theorems FROM m GROUP BY 1, 2, 3""")
def branch_subtrees(s, d):
    first, classes, _ = R.alike(s, V.tree(s, d))
    sets = R.branch_sets(s, first, 3)
    part = lambda p: F.concat(p["in_node"], p["label"]["head"])
    root = F.element_at(F.col("parts"), 1)  # the branching edge a set grew from stays first
    shape = F.concat_ws("+", part(root), F.array_join(F.array_sort(F.transform(F.slice("parts", 2, 9), part)), "+"))
    per = sets.groupBy(F.col("root").cast("long").alias("root"), F.size("edges").cast("long").alias("edges"), shape.alias("shape"), "theorem").agg(F.count("*").alias("n"))
    per = per.join(R.sorted_side(classes), "theorem")
    return per.groupBy("root", "edges", "shape").agg(F.sum(F.col("n") * F.col("theorems")).alias("support"), F.sum("theorems").alias("theorems"))


@query()
def mined_motifs(s, d):
    return R.mine(s, V.tree(s, d), max_edges=6, max_tree_edges=5).select("motif_kind", "signature", "edge_count", "node_count", "support", "distinct_theorems", "complexity_gain")


@query(f"""WITH {V.TRE}, h AS (SELECT theorem, edge, pos, label, unnest([2 * pos, 2 * pos + 1]) AS nxt FROM tre), two AS (SELECT a.label || '>' || b.label AS labels, a.theorem FROM h a JOIN h b ON a.theorem = b.theorem AND a.nxt = b.pos AND a.edge <> b.edge)
 SELECT labels, count(*) AS support, count(DISTINCT theorem) AS theorems FROM two GROUP BY 1""")
def dag_path_labels(s, d):
    labels = F.array_join(F.transform("labels", lambda x: x["head"]), ">")
    first, classes, _ = R.alike(s, V.tree(s, d))
    per = R.dag_paths(s, first, 2, 2).groupBy(labels.alias("labels"), "theorem").agg(F.count("*").alias("n")).join(R.sorted_side(classes), "theorem")
    return per.groupBy("labels").agg(F.sum(F.col("n") * F.col("theorems")).alias("support"), F.sum("theorems").alias("theorems"))


@query(f"""WITH RECURSIVE {V.TAC}, r AS (SELECT theorem, 0 AS i, [0] AS held, [0] AS layers, 0 AS leaves, 0 AS steps, 0 AS widest FROM tac WHERE idx = 0
 UNION ALL SELECT r.theorem, i + 1, CASE WHEN premise % 3 = 0 THEN held[2:] ELSE list_concat(list_transform(range(premise % 3), lambda x: held[1] + 1), held[2:]) END, list_concat(layers, list_transform(range(greatest(premise % 3, 1)), lambda x: held[1] + 1)),
 leaves + CAST(premise % 3 = 0 AS INTEGER), CAST(steps + greatest(premise % 3, 1) AS INTEGER), CAST(greatest(widest, premise % 3, 1) AS INTEGER) FROM r JOIN tac ON tac.theorem = r.theorem AND tac.idx = r.i WHERE len(held) > 0),
 f AS (SELECT theorem, arg_max(layers, i) AS layers, arg_max(leaves, i) AS leaves, arg_max(steps, i) AS steps, arg_max(widest, i) AS widest FROM r GROUP BY 1), w AS (SELECT theorem, max(n) AS width FROM (SELECT theorem, d, count(*) AS n FROM (SELECT theorem, unnest(layers) AS d FROM f) q GROUP BY 1, 2) q GROUP BY 1)
 SELECT 'T' || f.theorem AS theorem, CAST(list_max(layers) AS BIGINT) AS depth, width, CAST(steps AS BIGINT) AS n_tactic_steps, CAST(greatest(leaves, 1) AS BIGINT) AS n_leaves, CAST(widest AS BIGINT) AS max_branching FROM f JOIN w USING (theorem)""")
def tree_replay(s, d):
    m = R.tree_metrics(V.traces(s, d))
    return m.select("theorem", *[F.col(c).cast("long").alias(c) for c in ("depth", "width", "n_tactic_steps", "n_leaves", "max_branching")])


_USES = f"{V.TAC}, u AS (SELECT 'T' || theorem AS source, 'P' || premise AS target, head, idx, ord FROM tac)"


@query(f"WITH {_USES} SELECT source, target, min(idx) AS tactic_index, arg_min(head, idx) AS tactic_head, count(*) AS occurrences FROM u GROUP BY 1, 2")
def traced_dependencies(s, d):
    return R.dependency_edges(V.traces(s, d)).select("source", "target", F.col("tactic_index").cast("long").alias("tactic_index"), "tactic_head", "occurrences")


@query(f"WITH {_USES} SELECT 'structural' AS kind, count(*) AS n FROM u")
def traced_edge_kinds(s, d):
    return R.trace_edges(V.traces(s, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source || '.d' || doc_id AS full_name, CAST(2 AS BIGINT) AS line, 'theorem d' || doc_id || ' : P := by' AS header FROM documents")
def decl_extract(s, d):
    """One declaration in a namespace before each whole text."""
    head = F.concat(F.lit("namespace "), F.col("source"), F.lit("\ntheorem d"), F.col("doc_id").cast("string"), F.lit(" : P := by\n"))
    sources = V.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(head, F.coalesce("text", F.lit(""))).alias("content"))
    return D.declarations(sources).select(F.col("file_path").cast("long").alias("doc_id"), "full_name", F.col("line").cast("long").alias("line"), F.col("declaration_header").alias("header"))


# ---- learning -------------------------------------------------------------------------------

_LONG = "x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS j FROM embeddings)"


@query(f"WITH {_LONG}, m AS (SELECT j, avg(CAST(v AS DOUBLE)) AS mu, CASE WHEN stddev_pop(CAST(v AS DOUBLE)) < 1e-8 THEN 1 ELSE stddev_pop(CAST(v AS DOUBLE)) END AS sd FROM x GROUP BY j) SELECT vec_id, CAST(x.j AS BIGINT) AS j, round((CAST(v AS DOUBLE) - mu) / sd, 4) + 0.0 AS z FROM x JOIN m ON x.j = m.j")
def standardized_features(s, d):
    x = L.long_form(V.table(s, d, "embeddings"), "vec_id", "embedding")
    return L.standardize(x).select("vec_id", F.col("j").cast("long").alias("j"), (F.round("z", 4) + 0.0).alias("z"))


@query(f"WITH {_LONG} SELECT CAST(a.j AS BIGINT) AS i, CAST(b.j AS BIGINT) AS j, round(sum(CAST(a.v AS DOUBLE) * CAST(b.v AS DOUBLE)), 4) + 0.0 AS g FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.j <= b.j GROUP BY 1, 2")
def gram_matrix(s, d):
    return L.gram_blocks(V.table(s, d, "embeddings"), "embedding").select("i", "j", (F.round("g", 4) + 0.0).alias("g"))


@query("WITH c AS (SELECT l_orderkey AS k, CAST(count(*) AS DOUBLE) AS x, sum(l_extendedprice) AS y FROM lineitem GROUP BY 1), m AS (SELECT count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my FROM c), f AS (SELECT sum((x - mx) / sx * (y - my)) / (sum((x - mx) / sx * (x - mx) / sx) + 1.0) AS w FROM c, m) SELECT round(w, 3) AS weight, round(1 - sum(pow(y - my - w * (x - mx) / sx, 2)) / sum(pow(y - my, 2)), 6) AS r2 FROM c, m, f GROUP BY w")
def ridge_fit_metrics(s, d):
    c = V.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("double").alias("x"), F.sum("l_extendedprice").alias("y"))
    return L.ridge_report(s, c.select(F.array("x").alias("x"), "y"), 1, 1.0).select(F.round(F.col("weights")[0], 3).alias("weight"), F.round("r2", 6).alias("r2"))


@query()
def feature_set_comparison(s, d):
    p = V.table(s, d, "part").select(F.col("p_partkey").alias("name"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("y"))
    rows = p.join(G.degrees(V.succession(s, d)), "name").select("y", F.array(F.log1p(F.col("in_degree").cast("double")), F.log1p(F.col("out_degree").cast("double"))).alias("degree"), F.array("size").alias("size"), F.array(F.col("size"), F.log1p(F.col("in_degree").cast("double")), F.log1p(F.col("out_degree").cast("double"))).alias("all"))
    rows, out = cut(s, rows, "feature-sets"), None  # two passes a set
    for name, k in (("degree", 2), ("size", 1), ("all", 3)):
        part = L.ridge_report(s, rows.select(F.col(name).alias("x"), "y"), k, 1.0).select(F.lit(name).alias("features"), "n", "r2", "rmse")
        out = part if out is None else out.unionByName(part)
    return out


@query("WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS j FROM embeddings), c AS (SELECT label AS cl, j, avg(CAST(v AS DOUBLE)) AS m FROM x GROUP BY 1, 2), dd AS (SELECT vec_id, cl, round(sum(pow(CAST(v AS DOUBLE) - m, 2)), 6) AS d2 FROM x JOIN c ON x.j = c.j GROUP BY 1, 2), k AS (SELECT vec_id, cl, row_number() OVER (PARTITION BY vec_id ORDER BY d2, cl) AS rk FROM dd) SELECT vec_id, cl AS predicted, CAST(rk AS BIGINT) AS rk FROM k WHERE rk <= 3")
def nearest_centroid_top3(s, d):
    return L.nearest_centroids(V.table(s, d, "embeddings"), "vec_id", "embedding", "label", 3)


@query("WITH p AS (SELECT *, split_part(p_type, ' ', 1) AS ns FROM part), c AS (SELECT ns, p_brand, count(*) AS n FROM p GROUP BY 1, 2), m AS (SELECT ns, arg_max(p_brand, (n, -CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT))) AS guess FROM c GROUP BY ns) SELECT p_partkey, guess FROM p JOIN m ON p.ns = m.ns")
def namespace_prior(s, d):
    p = V.table(s, d, "part").withColumn("ns", F.split_part("p_type", F.lit(" "), F.lit(1)))
    rank = F.struct("n", (-F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long")).alias("tie"))
    m = p.groupBy("ns", "p_brand").agg(F.count("*").alias("n")).groupBy("ns").agg(F.max_by("p_brand", rank).alias("guess"))
    return p.join(m, "ns").select("p_partkey", "guess")


@query("WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), m AS (SELECT lang FROM c ORDER BY n DESC, lang LIMIT 1) SELECT m.lang AS guess, round(avg(CAST(d.lang = m.lang AS DOUBLE)), 6) AS accuracy FROM documents d, m GROUP BY 1")
def majority_baseline(s, d):
    docs = V.table(s, d, "documents")
    best = L.majority(docs, "lang")
    return best.join(F.broadcast(docs.agg(F.count("*").alias("total")))).select(F.col("label").alias("guess"), F.round(F.col("n") / F.col("total"), 6).alias("accuracy"))  # one row


@query("WITH p AS (SELECT quality AS y, CAST(n_chars > 500 AS INT) AS g FROM labels JOIN documents USING (doc_id)), k AS (SELECT y AS c FROM p UNION SELECT g FROM p), f AS (SELECT c, count_if(y = c AND g = c) AS tp, count_if(y <> c AND g = c) AS fp, count_if(y = c AND g <> c) AS fn FROM p, k GROUP BY c) SELECT round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END), 6) AS macro_f1 FROM f")
def macro_f1(s, d):
    p = V.table(s, d, "labels").join(V.table(s, d, "documents"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") > 500).cast("int").alias("p"))
    return L.macro_f1(p).select(F.round("macro_f1", 6).alias("macro_f1"))


@query("WITH p AS (SELECT quality AS y, n_chars AS x FROM labels JOIN documents USING (doc_id)), r AS (SELECT y, avg(rn) OVER (PARTITION BY x) AS rk FROM (SELECT y, x, row_number() OVER (ORDER BY x) AS rn FROM p) q) SELECT round((sum(rk) FILTER (y = 1) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0) / (count_if(y = 1) * count_if(y = 0)), 6) AS auc FROM r")
def roc_auc_rank(s, d):
    p = V.table(s, d, "labels").join(V.table(s, d, "documents"), "doc_id").select(F.col("quality").alias("y"), F.col("n_chars").alias("x"))
    return L.roc_auc(p).select(F.round("auc", 6).alias("auc"))


@query("SELECT a.vec_id AS u, b.vec_id AS v, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 4) + 0.0 AS dot, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))), 4) AS l1 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def pair_features(s, d):
    a = V.table(s, d, "embeddings").select(F.col("vec_id").alias("u"), F.col("embedding").cast("array<double>").alias("x"))
    b = a.select((F.col("u") - 1).alias("u"), F.col("u").alias("v"), F.col("x").alias("y"))
    total = lambda f: F.aggregate(F.zip_with("x", "y", f), F.lit(0.0), lambda acc, z: acc + z)
    return a.join(b, "u").select("u", "v", (F.round(total(lambda p, q: p * q), 4) + 0.0).alias("dot"), F.round(total(lambda p, q: F.abs(p - q)), 4).alias("l1"))


@query()
def logreg_metrics(s, d):
    e = V.table(s, d, "embeddings").select("embedding", (F.col("label") < 5).cast("double").alias("label"), (T.stable_bucket(F.col("vec_id").cast("string")) < 8).alias("train"))
    return L.logistic_report(e)


def _labelled(s, d):
    e = V.table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("x"), "label", (T.stable_bucket(F.col("vec_id").cast("string")) < 8).alias("train"))
    return L.kept_classes(e, "label", 25)


@query()
def multinomial_metrics(s, d):
    return L.classifier_report(_labelled(s, d))


@query()
def mlp_metrics(s, d):
    return L.classifier_report(_labelled(s, d), "mlp")


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE) + CAST(embedding[3] AS DOUBLE) + ln(1 + label), 5) + 0.0 AS total, CAST(4 AS BIGINT) AS width FROM embeddings")
def feature_spec(s, d):
    x = L.feature_spec("low3+degree", {"low": 64})
    e = V.table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("low"), F.col("label").alias("degree"))
    return e.select("vec_id", (F.round(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v), 5) + 0.0).alias("total"), F.size(x).cast("long").alias("width"))


@query()
def link_prediction(s, d):
    und = cut(s, G.undirected(V.succession(s, d)), "und")
    c, _ = S.coordinates(s, und)
    pairs = L.link_features(L.sampled_links(und, 10_000), c.select("name", F.concat("low", "high").alias("x"), "degree"))
    train = T.stable_bucket(F.concat_ws("::", F.col("a").cast("string"), F.col("b").cast("string"))) < 8
    return L.logistic_report(cut(s, pairs.select(F.col("x").alias("embedding"), F.col("label").cast("double").alias("label"), train.alias("train")), "links"))


@query("SELECT event_type AS model, round(avg(value), 6) AS score FROM events GROUP BY 1 ORDER BY avg(value) DESC, 1 LIMIT 1")
def argmax_model(s, d):
    return V.table(s, d, "events").groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("score")).orderBy(F.desc("score"), "model").limit(1).select("model", F.round("score", 6).alias("score"))


# ---- geometry -------------------------------------------------------------------------------

@query(f"""WITH {_UND}, p AS (SELECT und.u, und.v, a.v AS x, b.v AS y FROM und JOIN sym a ON a.u = und.u JOIN sym b ON b.u = und.v), want AS (SELECT DISTINCT x, y FROM p),
 two AS (SELECT DISTINCT x, y FROM want JOIN sym a ON a.u = x JOIN sym b ON b.u = a.v AND b.v = y) SELECT p.u, p.v, p.x, p.y, CAST(CASE WHEN p.x = p.y THEN 0 WHEN one.u IS NOT NULL THEN 1 WHEN two.x IS NOT NULL THEN 2 ELSE 3 END AS BIGINT) AS d
 FROM p LEFT JOIN sym one ON one.u = p.x AND one.v = p.y LEFT JOIN two ON two.x = p.x AND two.y = p.y""")
def two_hop_distance_matrix(s, d):
    """Of every edge, so a row for each pair of neighbours of its two ends."""
    return G.all_distances(s, G.undirected(V.succession(s, d)))


@query()
def ollivier_ricci_sample(s, d):
    u = G.undirected(V.succession(s, d))
    return G.ollivier_ricci(u, u.orderBy(F.xxhash64("u", "v"), "u", "v").limit(5000), 80)


@query()
def betweenness_sampled(s, d):
    u = G.undirected(V.succession(s, d))
    src = G.symmetric(u).select(F.col("u").alias("node")).distinct().orderBy(F.xxhash64("node"), "node").limit(200)
    return G.betweenness(s, u, src)


#: Walks of a node and their nodes: fixed values.
WALKS, WALK_LENGTH = 10, 40


@query(f"""WITH RECURSIVE {_UND}, ix AS MATERIALIZED (SELECT u AS node, row_number() OVER (PARTITION BY u ORDER BY v) - 1 AS pos, v AS next, count(*) OVER (PARTITION BY u) AS degree FROM sym),
 w AS (SELECT node AS start, k AS walk, 0 AS step, node, degree FROM ix, range({WALKS}) r(k) WHERE pos = 0
 UNION ALL SELECT w.start, w.walk, w.step + 1, ix.next, d.degree FROM w JOIN ix ON ix.node = w.node AND ix.pos = CAST('0x' || substr(md5(w.start || ':' || w.walk || ':' || (w.step + 1) || ':0'), 1, 12) AS BIGINT) % w.degree JOIN ix d ON d.node = ix.next AND d.pos = 0 WHERE w.step < {WALK_LENGTH - 1})
 SELECT start, CAST(walk AS INTEGER) AS walk, step, node FROM w""")
def random_walks(s, d):
    return G.random_walks(s, G.undirected(V.succession(s, d)), WALKS, WALK_LENGTH)


@query()
def spectral_coords(s, d):
    return S.coordinates(s, G.undirected(V.succession(s, d)))[0]


@query()
def effective_resistance(s, d):
    c, laplacian = S.coordinates(s, G.undirected(V.succession(s, d)))
    hubs = c.orderBy(F.desc("degree"), "name").limit(15).select(F.col("name").alias("hub"))
    return S.effective_resistance(c.select("name", F.concat("low", "high").alias("x")), hubs, laplacian)


@query()
def walk_embeddings(s, d):
    return S.walk_embeddings(s, G.undirected(V.succession(s, d)), 10, 40)


@query(f"WITH {_UND}, g AS (SELECT u, count(*) AS n FROM sym GROUP BY u) SELECT sym.u AS node, round(sum(sym.v % 7 / sqrt(CAST(a.n * b.n AS DOUBLE))), 6) AS y FROM sym JOIN g a ON a.u = sym.u JOIN g b ON b.u = sym.v GROUP BY 1")
def spmv_normalized(s, d):
    u = G.undirected(V.succession(s, d))
    x = G.symmetric(u).select(F.col("u").alias("node"), (F.col("u") % 7).cast("double").alias("x")).distinct()
    return G.normalized_product(u, x).select("node", F.round("y", 6).alias("y"))


@query("SELECT l_orderkey AS name, count(*) AS steps, CAST(max(l_linenumber) AS BIGINT) AS depth, count(DISTINCT l_partkey) AS leaves FROM lineitem GROUP BY 1")
def proof_tree_metrics(s, d):
    return V.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(F.count("*").alias("steps"), F.max("l_linenumber").cast("long").alias("depth"), F.count_distinct("l_partkey").alias("leaves"))


@query("WITH h AS (SELECT vec_id AS hub, embedding AS e FROM embeddings ORDER BY vec_id LIMIT 5) SELECT vec_id, hub, round(ln(1 + greatest(list_sum(list_transform(list_zip(embedding, e), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2))), 0)), 5) AS r FROM embeddings, h")
def resistance_to_hubs(s, d):
    e = V.table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    hubs = F.broadcast(e.orderBy("vec_id").limit(5).toDF("hub", "h"))  # five rows
    gap = F.aggregate(F.zip_with("x", "h", lambda a, b: F.pow(a - b, F.lit(2.0))), F.lit(0.0), lambda acc, z: acc + z)
    return e.join(hubs).select("vec_id", "hub", F.round(F.log1p(F.greatest(gap, F.lit(0.0))), 5).alias("r"))


# ---- evaluation books -----------------------------------------------------------------------


@query("SELECT n.doc_id, n.source FROM documents n WHERE NOT EXISTS (SELECT 1 FROM documents o JOIN labels USING (doc_id) WHERE o.text = n.text)")
def new_decl_antijoin(s, d):
    t = V.table(s, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("key"))
    base = t.join(V.table(s, d, "labels"), "doc_id", "left_semi").select("key").distinct()
    return t.join(base, "key", "left_anti").select("doc_id", "source")


@query("SELECT source AS category, count(*) AS n FROM documents GROUP BY 1")
def manifest_stats(s, d):
    return V.table(s, d, "documents").groupBy(F.col("source").alias("category")).agg(F.count("*").alias("n"))


@query("SELECT p_brand, count(e.vec_id) AS anchors, round(avg(CAST(e.embedding[1] AS DOUBLE)), 6) + 0.0 AS low_1 FROM part LEFT JOIN embeddings e ON p_partkey = e.vec_id * 3 GROUP BY 1")
def anchor_means(s, d):
    e = V.table(s, d, "embeddings").select((F.col("vec_id") * 3).alias("p_partkey"), F.col("embedding")[0].cast("double").alias("x"))
    return V.table(s, d, "part").join(e, "p_partkey", "left").groupBy("p_brand").agg(F.count("x").alias("anchors"), (F.round(F.avg("x"), 6) + 0.0).alias("low_1"))


@query("SELECT item_id, sample_id FROM benchmark, (SELECT unnest(range(8)) AS sample_id) r")
def sample_fanout(s, d):
    return V.table(s, d, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("sample_id"))


@query("SELECT source, bool_or(quality = 1) AS solved, CAST(count_if(quality = 1) AS BIGINT) AS passed, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def pass_at_n(s, d):
    ok = F.col("quality") == 1
    return V.table(s, d, "labels").join(V.table(s, d, "documents"), "doc_id").groupBy("source").agg(F.bool_or(ok).alias("solved"), F.count_if(ok).alias("passed"), F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(s, d):
    return V.table(s, d, "documents").join(V.table(s, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT CASE WHEN toxic IS NULL THEN 'not run' WHEN toxic = 1 THEN 'verified' ELSE 'failed' END AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def verify_status_counts(s, d):
    status = F.when(F.col("toxic").isNull(), "not run").when(F.col("toxic") == 1, "verified").otherwise("failed")
    return V.table(s, d, "documents").join(V.table(s, d, "labels"), "doc_id", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


from . import audit  # noqa: E402, F401  (last: its twins are made of those above)
