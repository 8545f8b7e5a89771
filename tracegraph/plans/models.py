"""Queries that fit and judge models: regressions by feature set, centroids, priors, sweeps, and numeric helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..operators import graphs as G
from ..operators import learning as L
from ..operators import network as N
from ..operators import spectral as S
from ..operators.traces import cut
from . import views as V
from .registry import query

_BUCKET = "((((CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT) % 10) * 6 + CAST(('0x' || substr(md5({0}), 9, 8)) AS BIGINT)) % 10 * 6 + CAST(('0x' || substr(md5({0}), 17, 8)) AS BIGINT)) % 10 * 6 + CAST(('0x' || substr(md5({0}), 25, 8)) AS BIGINT)) % 10"
#: Areas with a column of their own.
AREAS = [f"Brand#{k}" for k in (11, 12, 13, 21, 22, 23, 31, 32)]

#: Parts as theorems: how often a part is ordered is its length.
LEN = f"""{V.SUC}, ends AS (SELECT source AS name, 1 AS o, 0 AS i FROM (SELECT DISTINCT source, target FROM suc) q UNION ALL SELECT target, 0, 1 FROM (SELECT DISTINCT source, target FROM suc) q),
 deg AS (SELECT name, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM ends GROUP BY name),
 len AS (SELECT p_partkey AS name, p_brand AS area, length(p_name) AS statement_len, count(*) AS steps FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2, 3),
 thm AS (SELECT len.*, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, {_BUCKET.format("CAST(len.name AS VARCHAR)")} < 8 AS train, ln(1 + steps) AS y FROM len LEFT JOIN deg ON deg.name = len.name)"""


def theorems(s, d, arcs=None):
    """name, area, statement_len, steps, in_degree, out_degree, train, y of every part that is ordered. arcs: V.arcs, where it is written already."""
    parts = V.table(s, d, "part").select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("area"), F.length("p_name").alias("statement_len"))
    steps = V.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("name")).agg(F.count("*").alias("steps"))
    rows = parts.join(steps, "name").join(G.degrees(V.succession(s, d) if arcs is None else arcs, arcs is not None), "name", "left").fillna(0, ["in_degree", "out_degree"])
    return rows.withColumn("train", T.stable_bucket(F.col("name").cast("string")) < 8).withColumn("y", F.log1p(F.col("steps").cast("double")))


def _log(column: str):
    return F.log1p(F.col(column).cast("double"))


#: Fixed values, the names of reports. Columns of the wide feature vector: degrees, areas, statement length, 10 low and 10 high coordinates.
_DEGREE, _AREA, _TEXT, _SPECTRAL = [0, 1], list(range(2, 10)), [10], list(range(11, 31))
SETS = {
    "mean_only": [],
    "degree": _DEGREE,
    "area": _AREA,
    "statement_len": _TEXT,
    "spectral": _SPECTRAL,
    "degree+area": _DEGREE + _AREA,
    "degree+area+statement": _DEGREE + _AREA + _TEXT,
    "spectral+degree": _SPECTRAL + _DEGREE,
    "all": _DEGREE + _AREA + _TEXT + _SPECTRAL,
}


def wide_features(s, d, arcs=None):
    """name, x (the columns of SETS), y, train, has_spec; rows without coordinates have zeros there."""
    e = V.table(s, d, "embeddings").select(F.col("vec_id").alias("name"), F.col("embedding").cast("array<double>").alias("e"))
    rows = theorems(s, d, arcs).join(e, "name", "left")
    spec = F.coalesce(F.concat(F.slice("e", 1, 10), F.slice("e", -10, 10)), F.array_repeat(F.lit(0.0), 20))
    x = F.concat(F.array(_log("out_degree"), _log("in_degree")), A.one_hot(F.col("area"), AREAS), F.array(_log("statement_len")), spec)
    return rows.select("name", x.alias("x"), "y", "train", F.col("e").isNotNull().alias("has_spec"))


def _rounded(report):
    return report.select("feature_set", "side", "n_features", "n", *[F.round(c, 5).alias(c) for c in ("r2", "pearson", "rmse")])


@query()
def proof_length_regression(s, d):
    """Nine feature sets, and the coordinates alone on the rows that have them; training and test side."""
    rows = cut(s, wide_features(s, d), "features")
    alone = L.regression_sets(rows.where("has_spec"), {"spectral_only_on_spectral_subset": _SPECTRAL})
    return _rounded(L.regression_sets(rows, SETS).unionByName(alone))


_SMALL = f"""{LEN}, f AS (SELECT train, y, ln(1 + out_degree) AS a, ln(1 + in_degree) AS b, ln(1 + statement_len) AS c FROM thm),
 m AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, stddev_pop(a) AS sa, stddev_pop(b) AS sb, CASE WHEN stddev_pop(c) < 1e-8 THEN 1 ELSE stddev_pop(c) END AS sc FROM f WHERE train),
 z AS (SELECT train, y, y - my AS u, (a - ma) / sa AS a, (b - mb) / sb AS b, (c - mc) / sc AS c, my FROM f, m),
 g AS (SELECT sum(a * a) + 1 AS aa, sum(b * b) + 1 AS bb, sum(a * b) AS ab, sum(a * u) AS au, sum(b * u) AS bu, sum(c * c) + 1 AS cc, sum(c * u) AS cu FROM z WHERE train),
 p AS (SELECT 'mean_only' AS feature_set, 0 AS n_features, train, y, my AS p FROM z UNION ALL SELECT 'degree', 2, train, y, my + a * (au * bb - bu * ab) / (aa * bb - ab * ab) + b * (bu * aa - au * ab) / (aa * bb - ab * ab) FROM z, g UNION ALL SELECT 'statement_len', 1, train, y, my + c * cu / cc FROM z, g),
 s AS (SELECT feature_set, n_features, train, avg(y) AS my FROM p GROUP BY 1, 2, 3)"""


@query(f"""WITH {_SMALL} SELECT p.feature_set, CASE WHEN p.train THEN 'train' ELSE 'test' END AS side, CAST(p.n_features AS BIGINT) AS n_features, count(*) AS n, round(CASE WHEN p.n_features = 0 THEN 0 ELSE 1 - sum(pow(y - p, 2)) / sum(pow(y - s.my, 2)) END, 5) AS r2,
 round(CASE WHEN p.n_features = 0 THEN 0 ELSE coalesce(corr(y, p), 0) END, 5) + 0.0 AS pearson, round(sqrt(avg(pow(y - p, 2))), 5) AS rmse FROM p JOIN s ON s.feature_set = p.feature_set AND s.train = p.train GROUP BY p.feature_set, p.train, p.n_features""")
def proof_length_small_sets(s, d, arcs=None):
    """The sets whose closed form SQL can say."""
    rows = cut(s, wide_features(s, d, arcs), "features")
    return _rounded(L.regression_sets(rows, {k: SETS[k] for k in ("mean_only", "degree", "statement_len")})).withColumn("pearson", F.col("pearson") + 0.0)


def _families(s, d):
    """Rows that have vectors in both halves of the embeddings (inner), with the product of degrees where known (left, else 0)."""
    e = V.table(s, d, "embeddings").select(F.col("vec_id").alias("name"), F.col("embedding").cast("array<double>").alias("e"))
    product = G.degrees(V.succession(s, d)).select("name", (F.col("in_degree") * F.col("out_degree")).alias("in_out"))
    t = theorems(s, d).drop("in_degree", "out_degree")
    return t.join(e.select("name", F.slice("e", 1, 16).alias("walk")), "name").join(e.select("name", F.slice("e", 17, 20).alias("spec")), "name").join(product, "name", "left").fillna(0, ["in_out"])


@query(f"WITH {LEN} SELECT thm.name, round(CAST(embedding[1] AS DOUBLE), 5) + 0.0 AS walk_1, round(CAST(embedding[17] AS DOUBLE), 5) + 0.0 AS spec_1, thm.in_degree * thm.out_degree AS in_out, train FROM thm JOIN embeddings ON vec_id = thm.name")
def feature_star_join(s, d):
    return _families(s, d).select("name", (F.round(F.col("walk")[0], 5) + 0.0).alias("walk_1"), (F.round(F.col("spec")[0], 5) + 0.0).alias("spec_1"), "in_out", "train")


#: Of the joint model: hubs, sources of betweenness (a sampling operator), and the width of walk vectors.
HUBS, SOURCES, WALK_SIZE = 15, 200, 16


def _hubs(und):
    """The HUBS names of highest degree, ties by name."""
    return G.symmetric(und).groupBy(F.col("u").alias("hub")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "hub").limit(HUBS)


def graph_families(s, und):
    """name, walk, spec, bc, resist of every node: skip-gram vectors of walks, coordinates of both ends of the spectrum,
    betweenness from sampled sources, and log resistances to the hubs, in their order."""
    und = cut(s, und, "und")
    c, laplacian = S.coordinates(s, und)
    c = cut(s, c.select("name", F.concat("low", "high").alias("spec")), "coordinates")
    gaps = S.effective_resistance(c.withColumnRenamed("spec", "x"), _hubs(und).select("hub"), laplacian)
    resist = gaps.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("hub", "r"))), lambda h: h["r"]).alias("resist"))  # a row a hub
    nodes = c.select(F.col("name").alias("node")).orderBy(F.md5(F.col("name").cast("string").cast("binary")), "name").limit(SOURCES)
    central = G.betweenness(s, und, cut(s, nodes, "sources")).withColumnRenamed("node", "name")
    walk = S.walk_embeddings(s, und, 10, 40, size=WALK_SIZE).select(F.col("name").cast(und.schema["u"].dataType).alias("name"), F.col("x").alias("walk"))
    return walk.join(c, "name").join(resist, "name").join(central, "name", "left").fillna(0.0, ["bc"])


@query()
def joint_regression(s, d):
    """Each family with penalty 1, and all of them together with penalty 2."""
    und = G.undirected(V.succession(s, d))
    rows = graph_families(s, und).join(theorems(s, d).select("name", "y", "train"), "name")
    rows = cut(s, rows.select("y", "train", F.concat("walk", "spec", F.array(_log("bc")), "resist").alias("x")), "families")
    ends = [0]
    for size in (WALK_SIZE, 20, 1, HUBS):
        ends.append(ends[-1] + size)
    walk, spec, bc, resist = [list(range(a, b)) for a, b in zip(ends, ends[1:])]
    sets = {"node2vec": walk, "spectral": spec, "betweenness": bc, "resistance": resist, "node2vec+betweenness": walk + bc}
    return _rounded(L.regression_sets(rows, sets).unionByName(L.regression_sets(rows, {"joint": list(range(ends[-1]))}, 2.0)))


@query(f"""WITH RECURSIVE {V.SUC}, und AS (SELECT DISTINCT least(source, target) AS u, greatest(source, target) AS v FROM suc WHERE source <> target), sym AS MATERIALIZED (SELECT u AS a, v AS b FROM und UNION ALL SELECT v, u FROM und), g AS MATERIALIZED (SELECT a, count(*) AS n FROM sym GROUP BY 1),
 hub AS MATERIALIZED (SELECT a AS hub, row_number() OVER (ORDER BY n DESC, a) - 1 AS j FROM g ORDER BY n DESC, a LIMIT {HUBS}), ends AS MATERIALIZED (SELECT x.hub AS a, y.hub AS b, y.j AS j FROM hub x JOIN hub y ON x.j = 0 AND y.j > 0),
 m AS MATERIALIZED (SELECT sym.a, sym.b, 0.5 / n AS w FROM sym JOIN g USING (a) UNION ALL SELECT a, a, 0.5 FROM g), rhs AS MATERIALIZED (SELECT j, ends.a, 0.5 / n AS c FROM ends JOIN g ON g.a = ends.a UNION ALL SELECT j, ends.b, -0.5 / n FROM ends JOIN g ON g.a = ends.b),
 it AS (SELECT j, g.a AS node, CAST(0 AS DOUBLE) AS y, 0 AS t FROM ends, g UNION ALL SELECT i.j, m.a, sum(m.w * i.y) + coalesce(any_value(r.c), 0), i.t + 1 FROM it i JOIN m ON m.b = i.node LEFT JOIN rhs r ON r.j = i.j AND r.a = m.a WHERE i.t < 90 GROUP BY i.j, m.a, i.t)
 SELECT e.a, e.b, round(p.y - q.y, 6) AS r FROM ends e JOIN it p ON p.j = e.j AND p.node = e.a AND p.t = 90 JOIN it q ON q.j = e.j AND q.node = e.b AND q.t = 90""")
def hub_resistances(s, d):
    """Exact resistances between the first hub and each other one."""
    und = cut(s, G.undirected(V.succession(s, d)), "und")
    first, *others = [r.hub for r in _hubs(und).collect()]  # HUBS rows
    return S.resistances(s, und, [(first, h) for h in others]).select("a", "b", F.round("r", 6).alias("r"))


_LAB = f"lab AS (SELECT vec_id, label, embedding, {_BUCKET.format('CAST(vec_id AS VARCHAR)')} < 8 AS train, vec_id % 37 AS ns FROM embeddings), kept AS (SELECT label FROM lab WHERE train GROUP BY label HAVING count(*) >= 25), row AS (SELECT * FROM lab WHERE label IN (SELECT label FROM kept)), xl AS (SELECT vec_id, label, train, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS j FROM row)"


def _labelled(s, d):
    e = V.table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"), (T.stable_bucket(F.col("vec_id").cast("string")) < 8).alias("train"), (F.col("vec_id") % 37).alias("ns"))
    return e.join(e.where("train").groupBy("label").count().where("count >= 25").select("label"), "label", "left_semi")


@query(f"WITH {_LAB}, m AS (SELECT j, avg(CAST(v AS DOUBLE)) AS mu, CASE WHEN stddev_pop(CAST(v AS DOUBLE)) < 1e-8 THEN 1 ELSE stddev_pop(CAST(v AS DOUBLE)) END AS sd FROM xl WHERE train GROUP BY j) SELECT vec_id, CAST(xl.j AS BIGINT) AS j, round((CAST(v AS DOUBLE) - mu) / sd, 4) + 0.0 AS z FROM xl JOIN m ON m.j = xl.j WHERE NOT train")
def standardized_by_train(s, d):
    """Test rows in units of the training rows."""
    rows = _labelled(s, d)
    x = L.long_form(rows, "vec_id", "x").join(rows.select("vec_id", "train"), "vec_id")
    m = x.where("train").groupBy("j").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd")).withColumn("sd", F.when(F.col("sd") < 1e-8, 1.0).otherwise(F.col("sd")))
    return x.where("not train").join(F.broadcast(m), "j").select("vec_id", F.col("j").cast("long").alias("j"), (F.round((F.col("v") - F.col("mu")) / F.col("sd"), 4) + 0.0).alias("z"))  # a row a column


#: Fixed values, the names of reports: columns (from 1) of each set of coordinates in the category sweep.
SWEEP = {"low_5": list(range(1, 6)), "low_10": list(range(1, 11)), "high_5": list(range(33, 38)), "high_10": list(range(33, 43)), "low5_high5": [*range(1, 6), *range(33, 38)], "low10_high10": [*range(1, 11), *range(33, 43)]}
_DIMS = ", ".join(f"('{k}', {j})" for k, js in SWEEP.items() for j in js)


@query(f"""WITH {_LAB}, dims AS (SELECT * FROM (VALUES {_DIMS}) v(spec, j)), c AS (SELECT label AS cl, j, avg(CAST(v AS DOUBLE)) AS m FROM xl WHERE train GROUP BY 1, 2),
 d2 AS (SELECT spec, vec_id, label, cl, round(sum(pow(CAST(v AS DOUBLE) - m, 2)), 6) AS d2 FROM xl JOIN dims ON dims.j = xl.j JOIN c ON c.j = xl.j WHERE NOT train GROUP BY 1, 2, 3, 4),
 rk AS (SELECT *, row_number() OVER (PARTITION BY spec, vec_id ORDER BY d2, cl) AS rk FROM d2), cen AS (SELECT spec, count(DISTINCT vec_id) AS n, round(sum(CAST(cl = label AND rk = 1 AS DOUBLE)) / count(DISTINCT vec_id), 6) AS accuracy, round(sum(CAST(cl = label AND rk <= 3 AS DOUBLE)) / count(DISTINCT vec_id), 6) AS top3 FROM rk GROUP BY 1),
 tops AS (SELECT label, count(*) AS n FROM row WHERE train GROUP BY 1 ORDER BY n DESC, label LIMIT 1), pre AS (SELECT ns, arg_min(label, (-n, label)) AS own FROM (SELECT ns, label, count(*) AS n FROM row WHERE train GROUP BY 1, 2) q GROUP BY 1)
 SELECT * FROM cen UNION ALL SELECT 'majority', count(*), round(avg(CAST(row.label = tops.label AS DOUBLE)), 6), NULL FROM row, tops WHERE NOT train
 UNION ALL SELECT 'namespace_prior', count(*), round(avg(CAST(row.label = coalesce(own, tops.label) AS DOUBLE)), 6), NULL FROM row CROSS JOIN tops LEFT JOIN pre ON pre.ns = row.ns WHERE NOT train""")
def category_sweep(s, d):
    """Baselines and nearest training means on six sets of coordinates, judged on the test side."""
    rows = cut(s, _labelled(s, d), "labelled")
    test = rows.where("not train")
    out = None
    for name, columns in SWEEP.items():
        x = rows.withColumn("x", F.array(*[F.col("x")[j - 1] for j in columns]))
        near = L.nearest_centroids(x, "vec_id", "x", "label", 3, train="train").join(test.select("vec_id", "label"), "vec_id")
        hit = near.withColumn("hit", F.col("predicted") == F.col("label"))
        n = F.count_distinct("vec_id")
        part = hit.agg(F.lit(name).alias("spec"), n.alias("n"), F.round(F.count_if(F.col("hit") & (F.col("rk") == 1)) / n, 6).alias("accuracy"), F.round(F.count_if("hit") / n, 6).alias("top3"))
        out = part if out is None else out.unionByName(part)
    general = L.majority(rows.where("train"), "label").select(F.col("label").alias("guess"))
    for name, guessed in (("majority", test.join(F.broadcast(general))), ("namespace_prior", L.prefix_majority(rows, "ns", "label", "train").where("not train"))):  # one row
        part = guessed.agg(F.lit(name).alias("spec"), F.count("*").alias("n"), F.round(F.avg((F.col("guess") == F.col("label")).cast("double")), 6).alias("accuracy"), F.lit(None).cast("double").alias("top3"))
        out = out.unionByName(part)
    return out


@query(f"WITH {_LAB}, tops AS (SELECT label, count(*) AS n FROM row WHERE train GROUP BY 1 ORDER BY n DESC, label LIMIT 1), pre AS (SELECT ns, arg_min(label, (-n, label)) AS own FROM (SELECT ns, label, count(*) AS n FROM row WHERE train AND ns < 30 GROUP BY 1, 2) q GROUP BY 1) SELECT vec_id, coalesce(own, (SELECT arg_min(label, (-n, label)) FROM (SELECT label, count(*) AS n FROM row WHERE train AND ns < 30 GROUP BY 1) q)) AS guess FROM row LEFT JOIN pre ON pre.ns = row.ns WHERE NOT train")
def namespace_prior_fallback(s, d):
    """Prefixes above 30 have no training rows here and take the global majority."""
    rows = _labelled(s, d).withColumn("train", F.col("train") & (F.col("ns") < 30)).withColumn("test", T.stable_bucket(F.col("vec_id").cast("string")) >= 8)
    return L.prefix_majority(rows, "ns", "label", "train").where("test").select("vec_id", "guess")


def _head_edges(s, d):
    """Edges whose endpoints have coordinates: y (index of the head), x, train. At most 80,000, by hash."""
    e = cut(s, G.first_edges(V.tactics(s, d).select(F.col("theorem").alias("source"), F.col("premise").alias("target"), "head", "ord"), "ord"), "head-edges")
    coords = V.table(s, d, "embeddings").select(F.col("vec_id").alias("name"), F.slice(F.col("embedding").cast("array<double>"), 1, 10).alias("c"))
    degree = e.select(F.col("source").alias("name")).union(e.select("target")).groupBy("name").agg(F.count("*").alias("degree"))
    both = coords.join(degree, "name")
    key = F.concat_ws("::", F.col("source").cast("string"), F.col("target").cast("string"))
    few = e.orderBy(F.md5(key.cast("binary")), "source", "target").limit(80_000)
    rows = few.join(both.toDF("source", "cs", "ds"), "source").join(both.toDF("target", "ct", "dt"), "target")
    heads = ["click", "error", "purchase", "signup", "view"]
    return rows.select(F.array_position(F.array(*[F.lit(h) for h in heads]), F.col("head")).cast("double").alias("at"), "cs", "ct", "ds", "dt", (T.stable_bucket(key) < 8).alias("train")).withColumn("y", F.col("at") - 1)


@query()
def tactic_head_prediction(s, d):
    """Which tactic used a premise, from the ends' coordinates and degrees, from degrees alone, and by the majority."""
    rows = cut(s, _head_edges(s, d), "head-rows")
    degrees = F.array(_log("ds"), _log("dt"))
    both = L.classifier_report(rows.withColumn("x", F.concat("cs", "ct", degrees))).withColumn("model", F.lit("coordinates"))
    alone = L.classifier_report(rows.withColumn("x", degrees)).withColumn("model", F.lit("degree_only"))
    best = L.majority(rows.where("train"), "y")
    most = rows.where("not train").join(F.broadcast(best.select("label"))).agg(F.count("*").alias("n"), F.avg((F.col("y") == F.col("label")).cast("double")).alias("accuracy"), F.lit(None).cast("double").alias("top3"), F.lit(None).cast("double").alias("macro_f1"), F.lit("majority").alias("model"))  # one row
    return both.unionByName(alone).unionByName(most)


@query()
def link_prediction_degree_only(s, d):
    und = cut(s, G.undirected(V.succession(s, d)), "und")
    degree = G.symmetric(und).groupBy(F.col("u").alias("name")).agg(F.count("*").alias("degree"))
    pairs = L.sampled_links(und, 10_000).join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
    train = T.stable_bucket(F.concat_ws("::", F.col("a").cast("string"), F.col("b").cast("string"))) < 8
    return L.logistic_report(cut(s, pairs.select(F.array(_log("da"), _log("db")).alias("embedding"), F.col("label").cast("double").alias("label"), train.alias("train")), "links"))


SPECS = ["degree", "low10", "high10", "low10+high10", "low32", "high32", "low32+high32", "low10+degree", "high10+degree", "low10+high10+degree", "low32+degree", "high32+degree", "low32+high32+degree"]


@query()
def classifier_sweep(s, d):
    """The thirteen feature specs, by multinomial regression and by a network of one hidden layer."""
    degree = G.degrees(V.succession(s, d)).select(F.col("name").alias("vec_id"), (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    rows = L.kept_classes(_labelled(s, d), "label", 25).join(degree, "vec_id", "left").fillna(0, ["degree"])
    rows = cut(s, rows.select("y", "train", "degree", F.slice("x", 1, 32).alias("low"), F.slice("x", 33, 32).alias("high")), "sweep")
    out = None
    for spec in SPECS:
        x = rows.withColumn("x", L.feature_spec(spec, {"low": 32, "high": 32}))
        for model in ("logistic", "mlp"):
            part = L.classifier_report(x, model, iterations=15).select(F.lit(spec).alias("spec"), F.lit(model).alias("model"), "n", "accuracy", "top3", "macro_f1")
            out = part if out is None else out.unionByName(part)
    return out


# ---- a rectified network -----------------------------------------------------------------------

#: Of the network: columns of the vectors, hidden units.
WIDTH, HIDDEN = 64, 128


def _classes(s, d):
    """key, x, y, train of labelled rows, and the number of classes."""
    rows = L.kept_classes(_labelled(s, d), "label", 25).select(F.col("vec_id").alias("key"), "x", "y", "train")
    return rows, int(rows.agg(F.coalesce(F.max("y"), F.lit(-1.0))).first()[0]) + 1


_DRAW = "sqrt(6 / {n}) * (CAST(('0x' || substr(md5('0:{layer}:' || i || ':' || {j}), 1, 8)) AS BIGINT) / 2147483648.0 - 1)"


@query(f"""WITH {_LAB}, ys AS (SELECT label, row_number() OVER (ORDER BY label) AS y FROM kept), m AS (SELECT j, avg(CAST(v AS DOUBLE)) AS mu, CASE WHEN stddev_pop(CAST(v AS DOUBLE)) < 1e-8 THEN 1 ELSE stddev_pop(CAST(v AS DOUBLE)) END AS sd FROM xl WHERE train GROUP BY j),
 z AS (SELECT vec_id, any_value(y) AS y, list_append(list((CAST(v AS DOUBLE) - mu) / sd ORDER BY xl.j), 1.0) AS x FROM xl JOIN m ON m.j = xl.j JOIN ys ON ys.label = xl.label WHERE train GROUP BY vec_id),
 w1 AS (SELECT k, list_append(list({_DRAW.format(n=f"{WIDTH}.0", layer=1, j="k")} ORDER BY i), 0.0) AS w FROM range(1, {WIDTH + 1}) a(i), range(1, {HIDDEN + 1}) b(k) GROUP BY k),
 w2 AS (SELECT c, list_append(list({_DRAW.format(n=f"{HIDDEN}.0", layer=2, j="c")} ORDER BY i), 0.0) AS w FROM range(1, {HIDDEN + 1}) a(i), (SELECT y AS c FROM ys) b GROUP BY c),
 h AS MATERIALIZED (SELECT vec_id, y, any_value(x) AS x, list_append(list(greatest(list_dot_product(x, w), 0) ORDER BY k), 1.0) AS h FROM z, w1 GROUP BY vec_id, y), o AS (SELECT vec_id, y, c, list_dot_product(h, w) AS o FROM h, w2),
 p AS (SELECT vec_id, y, c, exp(o - max(o) OVER (PARTITION BY vec_id)) AS p FROM o), e AS MATERIALIZED (SELECT vec_id, c, p / sum(p) OVER (PARTITION BY vec_id) - CAST(c = y AS INT) AS e FROM p), n AS (SELECT count(*) AS n FROM z),
 hl AS (SELECT vec_id, unnest(h) AS v, generate_subscripts(h, 1) AS i FROM h), below AS (SELECT hl.vec_id, i AS k, sum(e * w[i]) AS b FROM hl JOIN e ON e.vec_id = hl.vec_id JOIN w2 ON w2.c = e.c WHERE v > 0 AND i <= {HIDDEN} GROUP BY 1, 2), zl AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM z),
 g AS (SELECT 1 AS layer, i, k AS j, sum(v * b) AS g FROM zl JOIN below ON below.vec_id = zl.vec_id GROUP BY 2, 3 UNION ALL SELECT 2, i, c, sum(v * e) FROM hl JOIN e ON e.vec_id = hl.vec_id GROUP BY 2, 3)
 SELECT layer, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(g / n, 6) + 0.0 AS g FROM g, n""")
def network_gradient(s, d):
    """Every cell of the gradient at the first weights, over all training rows."""
    rows, classes = _classes(s, d)
    cells = N.gradient_cells(s, N.prepared(rows, WIDTH).where("train"), N.start(WIDTH, HIDDEN, classes))
    return cells.withColumn("g", F.round("g", 6) + 0.0)


@query()
def network_metrics(s, d):
    """The trained network, judged on the test side."""
    rows, classes = _classes(s, d)
    return N.network_report(s, rows, WIDTH, classes, HIDDEN, epochs=30)


# ---- numeric helpers ---------------------------------------------------------------------------


@query("SELECT vec_id, round(1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))), 6) AS sigmoid, round(exp(CAST(embedding[1] AS DOUBLE)) / list_sum(list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE)))), 6) AS first_share FROM embeddings")
def softmax_sigmoid(s, d):
    x = F.col("embedding").cast("array<double>")
    return V.table(s, d, "embeddings").select("vec_id", F.round(A.sigmoid(x[0]), 6).alias("sigmoid"), F.round(A.softmax(x)[0], 6).alias("first_share"))


@query(f"SELECT p_partkey, {', '.join(f'CAST(p_brand = {chr(39)}{b}{chr(39)} AS DOUBLE) AS is_{k}' for k, b in enumerate(AREAS))} FROM part")
def area_one_hot(s, d):
    x = A.one_hot(F.col("p_brand"), AREAS)
    return V.table(s, d, "part").select("p_partkey", *[x[k].alias(f"is_{k}") for k in range(len(AREAS))])


@query("SELECT c_custkey, coalesce(min(o_orderkey) FILTER (o_orderstatus = 'P'), -1) AS least, coalesce(max(o_orderkey) FILTER (o_orderstatus = 'P'), -1) AS most FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def index_range(s, d):
    """Least and largest index of a customer's open orders, -1 where there is none."""
    o = V.table(s, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list("o_orderkey").alias("keys"))
    r = A.index_range(F.col("keys"))
    return V.table(s, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", r["least"].alias("least"), r["most"].alias("most"))


@query("SELECT p_name AS name, row_number() OVER (ORDER BY p_name) - 1 AS id FROM (SELECT DISTINCT p_name FROM part) q")
def dense_ids(s, d):
    return L.dense_ids(V.table(s, d, "part").select(F.col("p_name").alias("name")), "name")


@query(f"WITH {LEN} SELECT round(corr(ln(1 + statement_len), y), 6) AS pearson, count(*) AS n FROM thm WHERE in_degree + out_degree > 0")
def pearson_length(s, d, arcs=None):
    """Only rows with a degree count."""
    return theorems(s, d, arcs).where("in_degree + out_degree > 0").agg(F.round(F.corr(_log("statement_len"), "y"), 6).alias("pearson"), F.count("*").alias("n"))
