"""Report numbers, figure data and evaluation books as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators import learning as L
from ..operators import searches as H
from . import models, searches
from . import views as V
from .iterate import cut
from .registry import SQL, query


def _twin(name: str) -> str:
    return f"({SQL[name]})"


# ---- centrality and curvature -------------------------------------------------------------------

_SOURCES, _LEVELS = 50, 6


def _betweenness_sql() -> str:
    out = f"""{V.SUC}, und AS (SELECT DISTINCT least(source, target) AS u, greatest(source, target) AS v FROM suc WHERE source <> target), sym AS MATERIALIZED (SELECT u AS a, v AS b FROM und UNION ALL SELECT v, u FROM und), nodes AS (SELECT DISTINCT a AS node FROM sym),
 l0 AS MATERIALIZED (SELECT node AS src, node, 1.0::DOUBLE AS sigma FROM nodes ORDER BY md5(CAST(node AS VARCHAR)), node LIMIT {_SOURCES}), s0 AS MATERIALIZED (SELECT src, node FROM l0)"""
    for k in range(1, _LEVELS + 1):
        out += f""", l{k} AS MATERIALIZED (SELECT l.src, b AS node, sum(sigma) AS sigma FROM l{k - 1} l JOIN sym ON l.node = a WHERE NOT EXISTS (SELECT 1 FROM s{k - 1} s WHERE s.src = l.src AND s.node = b) GROUP BY 1, 2), s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL SELECT src, node FROM l{k})"""
    out += f", t{_LEVELS} AS MATERIALIZED (SELECT src, node, sigma, 0.0::DOUBLE AS delta FROM l{_LEVELS})"
    for k in range(_LEVELS - 1, -1, -1):
        out += f", t{k} AS MATERIALIZED (SELECT l.src, l.node, l.sigma, coalesce(sum(l.sigma / w.sigma * (1 + w.delta)), 0) AS delta FROM l{k} l LEFT JOIN (sym JOIN t{k + 1} w ON w.node = b) ON w.src = l.src AND a = l.node GROUP BY 1, 2, 3)"
    return out + ", bc AS (" + " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(_LEVELS + 1)) + ")"


@query(f"WITH {_betweenness_sql()} SELECT node, round(sum(delta) * (SELECT count(*) FROM nodes) / (SELECT count(*) FROM l0), 3) AS bc FROM bc WHERE src <> node GROUP BY node ORDER BY sum(delta) DESC, node LIMIT 30")
def central_nodes(s, d):
    """The thirty nodes of highest betweenness from sampled sources, scaled to all sources."""
    und = cut(s, G.undirected(V.succession(s, d)), "und")
    nodes = G.symmetric(und).select(F.col("u").alias("node")).distinct()
    sources = cut(s, nodes.orderBy(F.md5(F.col("node").cast("string").cast("binary")), "node").limit(_SOURCES), "sources")
    scale = nodes.count() / max(1, sources.count())
    return G.betweenness(s, und, sources).orderBy(F.desc("bc"), "node").limit(30).select("node", F.round(F.col("bc") * scale, 3).alias("bc"))


#: Edges whose curvature is summed up, and the most neighbours of an end: the reference's defaults.
CURVED, AROUND = 5000, 80


def _sampled_edges(s, d):
    """The written undirected graph, and CURVED of its edges by md5: a sampling operator."""
    u = cut(s, G.undirected(V.succession(s, d)), "und")
    return u, u.orderBy(F.md5(F.concat_ws(":", F.col("u").cast("string"), F.col("v").cast("string")).cast("binary")), "u", "v").limit(CURVED)


def _kappa(s, d) -> DataFrame:
    u, edges = _sampled_edges(s, d)
    return G.ollivier_ricci(u, edges, AROUND).where(~F.isnan("kappa"))


@query(f"""WITH {V.SUC}, und AS MATERIALIZED (SELECT DISTINCT least(source, target) AS u, greatest(source, target) AS v FROM suc WHERE source <> target), sym AS MATERIALIZED (SELECT u AS a, v AS b FROM und UNION ALL SELECT v, u FROM und), g AS MATERIALIZED (SELECT a, count(*) AS n FROM sym GROUP BY 1),
 few AS MATERIALIZED (SELECT u, v, x.n AS m, y.n AS n FROM und JOIN g x ON x.a = u JOIN g y ON y.a = v),
 near AS MATERIALIZED (SELECT x, y, min(d) AS d FROM (SELECT a AS x, b AS y, 1 AS d FROM sym UNION ALL SELECT DISTINCT p.a, q.b, 2 FROM sym p JOIN sym q ON p.b = q.a) q GROUP BY 1, 2)
 SELECT few.u, few.v, CAST(any_value(m) AS INTEGER) AS m, CAST(any_value(n) AS INTEGER) AS n, CAST(sum(CASE WHEN p.b = q.b THEN 0 ELSE coalesce(d, 3) END) AS BIGINT) AS distances, 0 AS violated, 0 AS misplaced, 0 AS gap FROM few JOIN sym p ON p.a = few.u JOIN sym q ON q.a = few.v LEFT JOIN near ON x = p.b AND y = q.b GROUP BY 1, 2""")
def curvature_certificates(s, d):
    """The proof that each edge's transport is cheapest, checked by joins: nothing violated, misplaced or left over."""
    u = cut(s, G.undirected(V.succession(s, d)), "und")
    m = cut(s, G.matrices(s, u), "matrices")
    return G.certificates(u, G.cheapest(s, m), m)


@query()
def curvature_summary(s, d):
    """Finite curvatures only: count, mean, median, range, share below 0 and below the bottleneck threshold."""
    k = F.col("kappa")
    share = lambda t: F.avg((k < t).cast("double"))
    return _kappa(s, d).agg(F.count("*").alias("n_evaluated"), F.avg(k).alias("mean"), F.median(k).alias("median"), F.min(k).alias("least"), F.max(k).alias("most"), share(0.0).alias("fraction_negative"), share(-0.5).alias("fraction_below_threshold"))


@query()
def curvature_bottom(s, d):
    return _kappa(s, d).orderBy("kappa", "u", "v").limit(30)


@query()
def curvature_histogram(s, d):
    """Figure data: sampled edges in bins of a tenth."""
    return _kappa(s, d).groupBy((F.floor(F.col("kappa") * 10) / 10).alias("low")).agg(F.count("*").alias("n"))


# ---- areas --------------------------------------------------------------------------------------

_HEADS = f"{V.TAC}, {V.CAT}, n AS (SELECT CASE WHEN theorem % 7 = 0 THEN 'UNKNOWN' ELSE coalesce(category, 'UNKNOWN') END AS area, head, count(*) AS n FROM tac LEFT JOIN cat ON name = theorem GROUP BY 1, 2)"


@query(f"WITH {_HEADS}, top AS (SELECT head FROM n GROUP BY head ORDER BY sum(n) DESC, head LIMIT 15), k AS (SELECT * FROM n WHERE area <> 'UNKNOWN' AND head IN (SELECT head FROM top)) SELECT area, head, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY area), 6) AS share FROM k")
def tactic_by_area(s, d):
    """Heads are ranked over all areas, UNKNOWN among them; then its rows go, and shares are of the heads kept."""
    t = V.tactics(s, d).groupBy("theorem", "head").agg(F.count("*").alias("n")).join(V.categories(s, d).withColumnRenamed("name", "theorem"), "theorem", "left")
    area = F.when(F.col("theorem") % 7 == 0, "UNKNOWN").otherwise(F.coalesce("category", F.lit("UNKNOWN")))
    n = cut(s, t.groupBy(area.alias("area"), "head").agg(F.sum("n").alias("n")), "areas")
    top = n.groupBy("head").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "head").limit(15).select("head")
    kept = n.where("area <> 'UNKNOWN'").join(F.broadcast(top), "head", "left_semi")  # fifteen rows
    total = kept.groupBy("area").agg(F.sum("n").alias("total"))
    return kept.join(total, "area").select("area", "head", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query(f"WITH {V.TAC}, {V.CAT} SELECT DISTINCT coalesce(category, 'UNKNOWN') AS area FROM tac LEFT JOIN cat ON name = theorem WHERE category IS NOT NULL UNION SELECT p_brand FROM tac JOIN part ON p_partkey = premise WHERE p_brand <> 'UNKNOWN'")
def area_union(s, d):
    """Areas of either side of an edge, without UNKNOWN."""
    t = V.tactics(s, d)
    own = t.select("theorem").distinct().join(V.categories(s, d).withColumnRenamed("name", "theorem"), "theorem", "left").select(F.coalesce("category", F.lit("UNKNOWN")).alias("area"))
    used = t.select(F.col("premise").alias("p_partkey")).distinct().join(V.table(s, d, "part"), "p_partkey").select(F.col("p_brand").alias("area"))
    return own.union(used).distinct().where("area <> 'UNKNOWN'")


# ---- evaluation books ---------------------------------------------------------------------------


@query("WITH b AS (SELECT DISTINCT d.text FROM documents d JOIN labels USING (doc_id)), n AS (SELECT * FROM documents WHERE text NOT IN (SELECT text FROM b WHERE text IS NOT NULL)) SELECT (SELECT count(*) FROM documents) AS declarations, count(*) AS fresh, count(DISTINCT source) AS categories, count(DISTINCT lang) AS files, CASE WHEN count(*) = 0 THEN 'blocked' ELSE 'ready' END AS status, CASE WHEN count(*) = 0 THEN 'no declaration after the cutoff' ELSE '' END AS reason FROM n")
def manifest_stats_row(s, d):
    """One row on the declarations that the base does not have; without any, a blocked record with its reason."""
    docs = V.table(s, d, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("key"))
    base = docs.join(V.table(s, d, "labels").select("doc_id"), "doc_id", "left_semi").select("key").distinct()
    fresh = docs.join(base, "key", "left_anti")
    row = fresh.agg(F.count("*").alias("fresh"), F.count_distinct("source").alias("categories"), F.count_distinct("lang").alias("files"))
    none = F.col("fresh") == 0
    return docs.agg(F.count("*").alias("declarations")).join(row).withColumn("status", F.when(none, "blocked").otherwise("ready")).withColumn("reason", F.when(none, "no declaration after the cutoff").otherwise(""))  # one row each


@query("SELECT p_brand, count(e.vec_id) AS anchors, round(avg(CAST(e.embedding[1] AS DOUBLE)), 6) + 0.0 AS low_1, round(avg(CAST(e.embedding[2] AS DOUBLE)), 6) + 0.0 AS low_2, round(avg(CAST(e.embedding[63] AS DOUBLE)), 6) + 0.0 AS high_1, round(avg(CAST(e.embedding[64] AS DOUBLE)), 6) + 0.0 AS high_2 FROM part LEFT JOIN embeddings e ON p_partkey = e.vec_id * 3 GROUP BY 1")
def anchor_coordinates(s, d):
    """Means of the low and the high coordinates of the anchors found, an area a row."""
    e = V.table(s, d, "embeddings").select((F.col("vec_id") * 3).alias("p_partkey"), F.col("embedding").cast("array<double>").alias("x"))
    mean = lambda k, name: (F.round(F.avg(F.element_at("x", k)), 6) + 0.0).alias(name)
    return V.table(s, d, "part").join(e, "p_partkey", "left").groupBy("p_brand").agg(F.count("x").alias("anchors"), mean(1, "low_1"), mean(2, "low_2"), mean(-2, "high_1"), mean(-1, "high_2"))


@query("WITH m AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM benchmark), g AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) SELECT m.item_id, g.doc_id FROM m JOIN g ON m.pos = g.pos")
def positional_zip(s, d):
    """Rows of two tables by their places, without one task that sorts either."""
    place = lambda t, c: L.ranked(V.table(s, d, t).select(c), [c], "pos")
    return place("benchmark", "item_id").join(place("documents", "doc_id"), "pos").select("item_id", "doc_id")


# ---- figures and numbers ------------------------------------------------------------------------


def _points(figure: str, label, value) -> list:
    return [F.lit(figure).alias("figure"), label.alias("label"), value.cast("double").alias("value")]


_FIGURES = f"""WITH RECURSIVE {V.TAC}, shape AS (SELECT theorem, count_if(premise % 3 = 2) AS b, count(*) AS n FROM tac GROUP BY 1)
 SELECT 'category_prediction_accuracy' AS figure, spec AS label, accuracy AS value FROM {_twin("category_sweep")} q
 UNION ALL SELECT 'pathfinding_reachability', 'random pairs', found_fraction FROM {_twin("path_sweep_pairs")} q UNION ALL SELECT 'pathfinding_reachability', 'cited edges', found_fraction FROM {_twin("dep_reach_overall")} q
 UNION ALL SELECT 'proof_length_r2', feature_set, r2 FROM {_twin("proof_length_small_sets")} q WHERE side = 'test'
 UNION ALL SELECT 'proof_shape_distribution', CASE WHEN b = 0 THEN 'linear' WHEN b = 1 THEN 'one branch' ELSE 'branching' END, CAST(count(*) AS DOUBLE) FROM shape GROUP BY 2
 UNION ALL SELECT 'corpus_comparison', CASE WHEN theorem % 2 = 0 THEN 'even' ELSE 'odd' END || ' mean length', round(avg(n), 6) FROM shape GROUP BY 2
 UNION ALL SELECT 'corpus_comparison', CASE WHEN theorem % 2 = 0 THEN 'even' ELSE 'odd' END || ' unique tactics', CAST(count(DISTINCT head) AS DOUBLE) FROM tac GROUP BY 2"""


@query(_FIGURES)
def figure_points(s, d):
    """The data of the bar figures: accuracy, reachability, fit, proof shapes and the comparison of two corpora."""
    col = F.col
    t = cut(s, V.tactics(s, d).select("theorem", "premise", "head"), "tactics")
    arcs = V.arcs(s, d)  # of the pairs and of the degrees
    shape = cut(s, t.groupBy("theorem").agg(F.count_if(col("premise") % 3 == 2).alias("b"), F.count("*").alias("n")), "shapes")
    side = F.when(col("theorem") % 2 == 0, "even").otherwise("odd")
    kind = F.when(col("b") == 0, "linear").when(col("b") == 1, "one branch").otherwise("branching")
    parts = [
        models.category_sweep(s, d).select(*_points("category_prediction_accuracy", col("spec"), col("accuracy"))),
        searches.path_sweep_pairs(s, d, arcs).select(*_points("pathfinding_reachability", F.lit("random pairs"), col("found_fraction"))),
        searches.dep_reach_overall(s, d).select(*_points("pathfinding_reachability", F.lit("cited edges"), col("found_fraction"))),
        models.proof_length_small_sets(s, d, arcs).where("side = 'test'").select(*_points("proof_length_r2", col("feature_set"), col("r2"))),
        shape.groupBy(kind.alias("k")).agg(F.count("*").alias("n")).select(*_points("proof_shape_distribution", col("k"), col("n"))),
        shape.groupBy(side.alias("k")).agg(F.round(F.avg("n"), 6).alias("n")).select(*_points("corpus_comparison", F.concat("k", F.lit(" mean length")), col("n"))),
        t.groupBy(side.alias("k")).agg(F.count_distinct("head").alias("n")).select(*_points("corpus_comparison", F.concat("k", F.lit(" unique tactics")), col("n"))),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(f"SELECT figure, count(*) AS points, round(min(value), 6) AS least, round(max(value), 6) AS most FROM ({_FIGURES}) f GROUP BY 1")
def figure_manifest(s, d):
    return figure_points(s, d).groupBy("figure").agg(F.count("*").alias("points"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))


@query(f"""WITH RECURSIVE dep AS (SELECT theorem, premise, count(*) AS n FROM (SELECT user_id AS theorem, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS premise FROM events) q GROUP BY 1, 2), he AS (SELECT * FROM {_twin("hyperedge_table")} q), sw AS (SELECT * FROM {_twin("state_sweep")} q), cs AS (SELECT * FROM {_twin("category_sweep")} q), ms AS (SELECT * FROM {_twin("manifest_stats_row")} q)
 SELECT 'dependency graph' AS section, 'edges' AS metric, CAST(count(*) AS DOUBLE) AS value FROM dep UNION ALL SELECT 'dependency graph', 'occurrences', CAST(sum(n) AS DOUBLE) FROM dep
 UNION ALL SELECT 'state graph', 'hyperedges', CAST(count(*) AS DOUBLE) FROM he UNION ALL SELECT 'state graph', 'multi-output', CAST(count_if(contains(outputs, '|')) AS DOUBLE) FROM he
 UNION ALL SELECT 'pathfinding', 'pairs', CAST(pairs AS DOUBLE) FROM sw UNION ALL SELECT 'pathfinding', 'found', CAST(found AS DOUBLE) FROM sw
 UNION ALL SELECT 'category prediction', 'best accuracy', max(accuracy) FROM cs WHERE spec NOT IN ('majority', 'namespace_prior') UNION ALL SELECT 'category prediction', 'majority', accuracy FROM cs WHERE spec = 'majority'
 UNION ALL SELECT 'prover evaluation', 'fresh', CAST(fresh AS DOUBLE) FROM ms WHERE status = 'ready'""")
def number_audit(s, d):
    """Every headline number with its source; the last section is there only if something was evaluated."""
    col = F.col
    dep = V.tactics(s, d).groupBy("theorem", "premise").agg(F.count("*").alias("n")).agg(F.count("*").alias("edges"), F.sum("n").alias("occurrences"))
    edges = H.hyperedges(V.hyper(s, d)).agg(F.count("*").alias("hyperedges"), F.count_if(F.size("outputs") > 1).alias("multi"))
    dep, edges = cut(s, dep, "dep"), cut(s, edges, "edges")  # a row each, read twice
    sweep, cats = cut(s, searches.state_sweep(s, d), "sweep"), cut(s, models.category_sweep(s, d), "categories")
    best = cats.where("spec not in ('majority', 'namespace_prior')").agg(F.max("accuracy").alias("best"))
    rows = [
        (dep, "dependency graph", "edges", "edges"),
        (dep, "dependency graph", "occurrences", "occurrences"),
        (edges, "state graph", "hyperedges", "hyperedges"),
        (edges, "state graph", "multi-output", "multi"),
        (sweep, "pathfinding", "pairs", "pairs"),
        (sweep, "pathfinding", "found", "found"),
        (best, "category prediction", "best accuracy", "best"),
        (cats.where("spec = 'majority'"), "category prediction", "majority", "accuracy"),
        (manifest_stats_row(s, d).where("status = 'ready'"), "prover evaluation", "fresh", "fresh"),
    ]
    return reduce(DataFrame.unionByName, [t.select(F.lit(a).alias("section"), F.lit(m).alias("metric"), col(c).cast("double").alias("value")) for t, a, m, c in rows])
