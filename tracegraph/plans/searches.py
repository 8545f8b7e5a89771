"""Queries on state hypergraphs and shortest paths: reachability, discharge, sweeps and example paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators import searches as H
from ..plans.iterate import cut
from . import views as V
from .registry import query

MAX_DEPTH, DISCHARGE_DEPTH, SWEEP_DEPTH, PATH_EDGES = 10, 8, 6, 7
#: Sampling operators: names that take part in a sweep, and how often each meets another.
SAMPLED, ROUNDS = 200, 4

_HE = f"""{V.HYP}, he0 AS (SELECT input, tactic, list_sort(outputs) AS key, theorem, min(ord) AS seen, arg_min(outputs, ord) AS outputs, count(*) AS n FROM hyp GROUP BY 1, 2, 3, 4),
 he AS MATERIALIZED (SELECT input, tactic, arg_min(outputs, seen) AS outputs, string_agg(CAST(theorem AS VARCHAR), ',' ORDER BY seen) AS theorems, CAST(sum(n) AS BIGINT) AS occurrences FROM he0 GROUP BY input, tactic, key),
 arc AS MATERIALIZED (SELECT DISTINCT input AS source, unnest(outputs) AS target FROM he), init AS MATERIALIZED (SELECT theorem AS name, input AS state FROM hyp WHERE idx = 0)"""
_DIST = f"walk AS (SELECT source AS start, source AS node, 0 AS depth FROM arc UNION SELECT walk.start, arc.target, walk.depth + 1 FROM walk JOIN arc ON walk.node = arc.source WHERE walk.depth < {MAX_DEPTH}), dist AS MATERIALIZED (SELECT start, node, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY 1, 2)"


def _pairs_sql(names: str, most: int = SAMPLED, rounds: int = ROUNDS) -> str:
    rank = "row_number() OVER (PARTITION BY round ORDER BY md5(name || ':{0}:' || round), name) AS r{0}"
    return f"""few AS (SELECT name FROM (SELECT DISTINCT name FROM {names}) q ORDER BY md5(CAST(name AS VARCHAR)), name LIMIT {most}),
 rk AS (SELECT name, round, {rank.format("a")}, {rank.format("b")} FROM few, (SELECT unnest(range({rounds})) AS round) q), pair AS MATERIALIZED (SELECT x.round, x.name AS a, y.name AS b FROM rk x JOIN rk y ON x.round = y.round AND x.ra = y.rb WHERE x.name <> y.name)"""


_STATE_PAIRS = f"{_pairs_sql('init')}, ends AS MATERIALIZED (SELECT y.state AS start, x.state AS target FROM pair JOIN init x ON x.name = a JOIN init y ON y.name = b)"


def _edges(s, d):
    return cut(s, H.hyperedges(V.hyper(s, d)), "hyperedges")


def _steps(s, d):
    """input, outputs: all that OR paths need of the hyperedges, without a row for each theorem."""
    return cut(s, V.hyper(s, d).select("input", "outputs").distinct(), "steps")


def _initial(s, d):
    return V.hyper(s, d).where("idx = 0").select(F.col("theorem").alias("name"), F.col("input").alias("state"))


def _ends(s, d):
    """start, target: the initial states of sampled pairs of theorems, with repeats."""
    init = cut(s, _initial(s, d), "initial")
    pairs = H.paired(init, ROUNDS, SAMPLED)
    return cut(s, pairs.join(init.toDF("a", "target"), "a").join(init.toDF("b", "start"), "b").select("start", "target"), "ends")


@query(f"WITH {_HE} SELECT input, tactic, array_to_string(outputs, '|') AS outputs, theorems, occurrences FROM he")
def hyperedge_table(s, d):
    e = H.hyperedges(V.hyper(s, d))
    return e.select("input", "tactic", F.concat_ws("|", "outputs").alias("outputs"), F.concat_ws(",", F.transform("theorems", lambda t: t.cast("string"))).alias("theorems"), "occurrences")


_GOAL = "node AS (SELECT DISTINCT state, CASE WHEN CAST(substr(state, 2) AS BIGINT) % 3 = 0 THEN NULL ELSE substr(sha256(state), 1, 8) END AS goal FROM (SELECT input AS state FROM he UNION SELECT unnest(outputs) FROM he) q WHERE state <> 'no goals')"


@query(f"WITH {_HE}, {_GOAL}, o AS (SELECT input, tactic, outputs, occurrences, unnest(outputs) AS state, generate_subscripts(outputs, 1) AS pos FROM he) SELECT coalesce(i.goal, o.input) AS input_key, tactic, string_agg(coalesce(g.goal, o.state), '|' ORDER BY pos) AS output_keys, occurrences FROM o LEFT JOIN node i ON i.state = o.input LEFT JOIN node g ON g.state = o.state GROUP BY i.goal, o.input, tactic, outputs, occurrences")
def hyperedge_goal_keys(s, d):
    """Hyperedges keyed by goal, by the state itself where it has none; outputs keep their order."""
    e = _edges(s, d)
    nodes = e.select(F.col("input").alias("state")).union(e.select(F.explode("outputs"))).distinct().where(F.col("state") != H.DONE)
    nodes = nodes.select("state", F.when(F.substring("state", 2, 9).cast("long") % 3 != 0, F.substring(F.sha2("state", 256), 1, 8)).alias("goal"))
    o = e.select("input", "tactic", F.concat_ws("|", "outputs").alias("key"), "occurrences", F.posexplode("outputs").alias("pos", "state")).join(nodes, "state", "left")
    o = o.groupBy("input", "tactic", "key", "occurrences").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("goal", "state").alias("k")))), lambda x: x["k"]).alias("keys"))
    return o.join(nodes.toDF("input", "g"), "input", "left").select(F.coalesce("g", "input").alias("input_key"), "tactic", F.concat_ws("|", "keys").alias("output_keys"), "occurrences")


@query(f"WITH {_HE}, k AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN printf('S%02d', c_custkey % 120) ELSE CAST(c_custkey AS VARCHAR) END AS key FROM customer), st AS (SELECT DISTINCT input AS state FROM he) SELECT c_custkey, key, coalesce(st.state, init.state) AS state FROM k LEFT JOIN st ON st.state = key LEFT JOIN init ON CAST(init.name AS VARCHAR) = key")
def resolve_state(s, d):
    """A start given as a state's id or as a theorem's name."""
    number = F.col("c_custkey")
    k = V.table(s, d, "customer").select("c_custkey", F.when(number % 2 == 0, F.format_string("S%02d", number % 120)).otherwise(number.cast("string")).alias("key"))
    states = V.hyper(s, d).select(F.col("input").alias("by_id")).distinct()
    init = _initial(s, d).select(F.col("name").cast("string").alias("key"), F.col("state").alias("by_name"))
    return k.join(states, F.col("key") == F.col("by_id"), "left").join(init, "key", "left").select("c_custkey", "key", F.coalesce("by_id", "by_name").alias("state"))


@query(f"""WITH RECURSIVE {_HE}, {_DIST}, {_STATE_PAIRS}, p AS (SELECT DISTINCT e.start, e.target, coalesce(depth, -1) AS depth FROM ends e LEFT JOIN dist d ON d.start = e.start AND d.node = e.target)
 SELECT p.start, p.target, p.depth >= 0 AS found, p.depth, (SELECT min(x.node) FROM dist x JOIN dist y ON y.start = x.node WHERE x.start = p.start AND y.node = p.target AND x.depth = ceil(p.depth / 2.0) AND y.depth = p.depth - x.depth) AS meet FROM p""".replace("JOIN dist y ON y.start = x.node", "JOIN (SELECT start, node, depth FROM dist UNION SELECT target, target, 0 FROM arc) y ON y.start = x.node"))
def or_paths(s, d):
    return H.or_paths(s, _steps(s, d), _ends(s, d), MAX_DEPTH)


_PARENT = "par AS MATERIALIZED (SELECT d.start, d.node, d.depth, min(arc.source) AS parent FROM dist d JOIN arc ON arc.target = d.node JOIN dist b ON b.start = d.start AND b.node = arc.source AND b.depth = d.depth - 1 GROUP BY 1, 2, 3)"


@query(f"""WITH RECURSIVE {_HE}, {_DIST}, {_STATE_PAIRS}, {_PARENT}, back AS (SELECT e.start, e.target, p.depth AS step, p.parent AS input, p.node AS output FROM (SELECT DISTINCT * FROM ends) e JOIN par p ON p.start = e.start AND p.node = e.target
 UNION ALL SELECT k.start, k.target, p.depth, p.parent, p.node FROM back k JOIN par p ON p.start = k.start AND p.node = k.input),
 best AS (SELECT input, output, arg_min(tactic, (size, minus, tactic, key)) AS tactic FROM (SELECT input, unnest(outputs) AS output, tactic, len(outputs) AS size, -occurrences AS minus, array_to_string(outputs, '|') AS key FROM he) q GROUP BY 1, 2)
 SELECT start, target, step, input, tactic, output FROM back JOIN best USING (input, output) WHERE start <> target""")
def or_path_steps(s, d):
    return H.path_steps(s, _edges(s, d), _ends(s, d), MAX_DEPTH).where("start <> target")


@query(f"""WITH RECURSIVE {_HE}, {_DIST}, {_STATE_PAIRS}, p AS (SELECT e.*, d.depth FROM ends e LEFT JOIN dist d ON d.start = e.start AND d.node = e.target)
 SELECT count(*) AS pairs, count(depth) AS found, round(count(depth) / count(*), 6) AS found_fraction, round(avg(depth), 6) AS mean_depth, max(depth) AS most FROM p""")
def state_sweep(s, d):
    ends = _ends(s, d)
    p = ends.join(H.or_paths(s, _steps(s, d), ends, MAX_DEPTH), ["start", "target"]).select(F.when(F.col("found"), F.col("depth")).alias("depth"))
    return p.agg(F.count("*").alias("pairs"), F.count("depth").alias("found"), F.round(F.count("depth") / F.count("*"), 6).alias("found_fraction"), F.round(F.avg("depth"), 6).alias("mean_depth"), F.max("depth").alias("most"))


@query(f"WITH RECURSIVE {_HE}, {_DIST}, {_STATE_PAIRS} SELECT depth, count(*) AS n FROM ends e JOIN dist d ON d.start = e.start AND d.node = e.target GROUP BY 1")
def state_sweep_histogram(s, d):
    ends = _ends(s, d)
    return ends.join(H.or_paths(s, _steps(s, d), ends, MAX_DEPTH), ["start", "target"]).where("found").groupBy("depth").agg(F.count("*").alias("n"))


def _discharge_sql(oracles: str, rounds: int) -> str:
    """The fixpoint unrolled: oracles is a table of (oracle)."""
    out = f"""mem AS MATERIALIZED (SELECT DISTINCT input, tactic, array_to_string(outputs, '|') AS key, unnest(outputs) AS output FROM he), need AS MATERIALIZED (SELECT input, tactic, key, count(*) AS needed FROM mem GROUP BY 1, 2, 3),
 d0 AS MATERIALIZED (SELECT oracle, 'no goals' AS node, 0 AS depth FROM {oracles} UNION SELECT oracle, oracle, 0 FROM {oracles} WHERE oracle IS NOT NULL)"""
    for k in range(1, rounds + 1):
        out += f""", d{k} AS MATERIALIZED (SELECT * FROM d{k - 1} UNION ALL SELECT DISTINCT h.oracle, h.input, {k} FROM (SELECT oracle, input, tactic, key, count(*) AS have FROM mem JOIN d{k - 1} ON output = node GROUP BY 1, 2, 3, 4) h JOIN need USING (input, tactic, key)
 WHERE have = needed AND NOT EXISTS (SELECT 1 FROM d{k - 1} p WHERE p.oracle IS NOT DISTINCT FROM h.oracle AND p.node = h.input))"""
    return out


_ALONE = f"{_HE}, {_discharge_sql('(SELECT CAST(NULL AS VARCHAR) AS oracle)', DISCHARGE_DEPTH)}"


@query(f"WITH {_ALONE} SELECT node, CAST(depth AS BIGINT) AS depth FROM d{DISCHARGE_DEPTH}")
def discharge_levels(s, d):
    none = s.createDataFrame([(None,)], "oracle string")
    return H.discharge(s, _edges(s, d), none, DISCHARGE_DEPTH).select("node", "depth")


@query(f"""WITH {_ALONE}, lev AS (SELECT node, depth FROM d{DISCHARGE_DEPTH}), o AS (SELECT input, tactic, outputs, occurrences, unnest(outputs) AS node FROM he),
 last AS (SELECT input, tactic, outputs, occurrences, max(depth) AS latest, count_if(depth IS NULL) AS open FROM o LEFT JOIN lev USING (node) GROUP BY 1, 2, 3, 4)
 SELECT input AS node, CAST(depth AS BIGINT) AS depth, arg_min(tactic, (len(outputs), -occurrences, tactic, array_to_string(outputs, '|'))) AS tactic, array_to_string(arg_min(outputs, (len(outputs), -occurrences, tactic, array_to_string(outputs, '|'))), '|') AS outputs
 FROM last JOIN lev ON node = input WHERE open = 0 AND depth > 0 AND latest < depth GROUP BY 1, 2""")
def discharge_proofs(s, d):
    e = _edges(s, d)
    solved = H.discharge(s, e, s.createDataFrame([(None,)], "oracle string"), DISCHARGE_DEPTH)
    return H.proofs(e, solved).select("node", "depth", "tactic", F.concat_ws("|", "outputs").alias("outputs"))


_PER_ORACLE = f"{_HE}, {_STATE_PAIRS}, {_discharge_sql('(SELECT DISTINCT target AS oracle FROM ends)', SWEEP_DEPTH)}"


@query(f"WITH {_PER_ORACLE} SELECT DISTINCT e.start, e.target, d.depth IS NOT NULL AS solved, CAST(coalesce(d.depth, -1) AS BIGINT) AS depth FROM ends e LEFT JOIN d{SWEEP_DEPTH} d ON d.oracle = e.target AND d.node = e.start")
def discharge_pairs(s, d):
    """Whether a start can be discharged where the target's state is given, for each sampled pair."""
    ends = _ends(s, d)
    solved = H.discharge(s, _edges(s, d), ends.select(F.col("target").alias("oracle")).distinct(), SWEEP_DEPTH)
    got = ends.distinct().join(solved.toDF("target", "start", "depth"), ["start", "target"], "left")
    return got.select("start", "target", F.col("depth").isNotNull().alias("solved"), F.coalesce("depth", F.lit(-1).cast("long")).alias("depth"))


@query(f"WITH {_PER_ORACLE} SELECT count(*) AS pairs, count(d.depth) AS solved, round(count(d.depth) / count(*), 6) AS solved_fraction FROM ends e LEFT JOIN d{SWEEP_DEPTH} d ON d.oracle = e.target AND d.node = e.start")
def discharge_sweep(s, d):
    ends = _ends(s, d)
    solved = H.discharge(s, _edges(s, d), ends.select(F.col("target").alias("oracle")).distinct(), SWEEP_DEPTH)
    got = ends.join(solved.toDF("target", "start", "depth"), ["start", "target"], "left")
    return got.agg(F.count("*").alias("pairs"), F.count("depth").alias("solved"), F.round(F.count("depth") / F.count("*"), 6).alias("solved_fraction"))


#: States that a search may open: few, so that some pairs run out of it. The reference's default is 50,000.
BUDGET = 40
_OPENED = f"""opn AS (SELECT DISTINCT start, target, start AS node, 0 AS depth FROM ends UNION SELECT o.start, o.target, arc.target, o.depth + 1 FROM opn o JOIN arc ON arc.source = o.node WHERE o.node <> o.target AND o.node <> 'no goals' AND o.depth < {SWEEP_DEPTH - 1}),
 first AS (SELECT start, target, node, min(depth) AS depth FROM opn WHERE node <> target AND node <> 'no goals' GROUP BY 1, 2, 3)"""


@query(f"""WITH RECURSIVE {_PER_ORACLE}, {_OPENED}, p AS (SELECT DISTINCT e.start, e.target, d.depth FROM ends e LEFT JOIN d{SWEEP_DEPTH} d ON d.oracle = e.target AND d.node = e.start),
 n AS (SELECT p.start, p.target, p.depth, count(f.node) AS expansions FROM p LEFT JOIN first f ON f.start = p.start AND f.target = p.target AND f.depth < coalesce(p.depth, {SWEEP_DEPTH}) GROUP BY 1, 2, 3)
 SELECT start, target, depth IS NOT NULL AND expansions <= {BUDGET} AS solved, CAST(CASE WHEN expansions <= {BUDGET} THEN coalesce(depth, -1) ELSE -1 END AS BIGINT) AS depth, expansions, expansions > {BUDGET} AS exhausted FROM n""")
def discharge_budget(s, d):
    """Searches of sampled pairs with a budget of opened states: solved, not solved, or out of budget."""
    ends, e = _ends(s, d), _edges(s, d)
    solved = H.discharge(s, e, ends.select(F.col("target").alias("oracle")).distinct(), SWEEP_DEPTH)
    return H.discharge_search(s, e, ends, solved, SWEEP_DEPTH, BUDGET)


_LEAST_STEP = "(len(outputs), -occurrences, tactic, array_to_string(outputs, '|'))"


@query(f"""WITH RECURSIVE {_PER_ORACLE}, lev AS MATERIALIZED (SELECT oracle, node, depth FROM d{SWEEP_DEPTH}), need2 AS (SELECT input, tactic, array_to_string(outputs, '|') AS key, outputs, occurrences, len(list_distinct(outputs)) AS needed, unnest(list_distinct(outputs)) AS node FROM he),
 rdy AS (SELECT l.oracle, n.input, n.tactic, n.outputs, n.occurrences, max(l.depth) AS latest FROM need2 n JOIN lev l USING (node) GROUP BY l.oracle, n.input, n.tactic, n.outputs, n.occurrences, n.needed HAVING count(*) = n.needed),
 best AS MATERIALIZED (SELECT r.oracle, r.input AS node, l.depth, arg_min(tactic, {_LEAST_STEP}) AS tactic, arg_min(outputs, {_LEAST_STEP}) AS outputs FROM rdy r JOIN lev l ON l.oracle = r.oracle AND l.node = r.input WHERE l.depth > 0 AND latest < l.depth GROUP BY 1, 2, 3),
 prf AS (SELECT DISTINCT e.start, e.target, b.node, b.depth, b.tactic, b.outputs FROM ends e JOIN best b ON b.oracle = e.target AND b.node = e.start
 UNION SELECT p.start, p.target, b.node, b.depth, b.tactic, b.outputs FROM (SELECT start, target, unnest(outputs) AS next FROM prf) p JOIN best b ON b.oracle = p.target AND b.node = p.next)
 SELECT start, target, node, CAST(depth AS BIGINT) AS depth, tactic, array_to_string(outputs, '|') AS outputs FROM prf""")
def discharge_pair_proofs(s, d):
    """The steps of a proof of each sampled pair that can be discharged with the target's state given."""
    ends, e = _ends(s, d), _edges(s, d)
    solved = cut(s, H.discharge(s, e, ends.select(F.col("target").alias("oracle")).distinct(), SWEEP_DEPTH), "solved")
    return H.proof_steps(s, H.oracle_proofs(e, solved), ends, SWEEP_DEPTH).select("start", "target", "node", "depth", "tactic", F.concat_ws("|", "outputs").alias("outputs"))


#: Dependency edges that are looked up in the state graph, at most: a sampling operator.
DEP_PAIRS = 1000
_CROSS = f"""{_HE}, {_DIST}, cand AS (SELECT theorem, premise, arg_min(head, ord) AS tactic_head FROM tac WHERE premise IN (SELECT name FROM init) GROUP BY 1, 2),
 few AS (SELECT * FROM cand ORDER BY md5(theorem || ':' || premise), theorem, premise LIMIT {DEP_PAIRS}),
 seen AS (SELECT tactic_head, d.depth FROM few JOIN init x ON x.name = theorem JOIN init y ON y.name = premise LEFT JOIN dist d ON d.start = x.state AND d.node = y.state)"""


def _crossed(s, d):
    """tactic_head, depth (null: not reached) of sampled dependency edges, looked up between the ends' initial states."""
    init = cut(s, _initial(s, d), "initial")
    t = V.tactics(s, d).join(init.select(F.col("name").alias("premise")), "premise", "left_semi")
    order = F.md5(F.concat_ws(":", F.col("theorem").cast("string"), F.col("premise").cast("string")).cast("binary"))
    some = t.groupBy("theorem", "premise").agg(F.min_by("head", "ord").alias("tactic_head")).orderBy(order, "theorem", "premise").limit(DEP_PAIRS)
    pairs = cut(s, some.join(init.toDF("theorem", "start"), "theorem").join(init.toDF("premise", "target"), "premise"), "crossed")
    found = H.or_paths(s, _steps(s, d), pairs, MAX_DEPTH).where("found").select("start", "target", "depth")
    return pairs.join(found, ["start", "target"], "left").select("tactic_head", "depth")


@query(f"WITH RECURSIVE {_CROSS} SELECT tactic_head, count(*) AS n, count(depth) AS found, round(count(depth) / count(*), 6) AS rate FROM seen GROUP BY 1 HAVING count(*) >= 5 ORDER BY rate DESC, tactic_head")
def dep_reach_by_head(s, d):
    """Dependency edges against state reachability, by the tactic that used the premise; best rate first."""
    by = _crossed(s, d).groupBy("tactic_head").agg(F.count("*").alias("n"), F.count("depth").alias("found")).where("n >= 5")
    return by.withColumn("rate", F.round(F.col("found") / F.col("n"), 6)).orderBy(F.desc("rate"), "tactic_head")


@query(f"WITH RECURSIVE {_CROSS} SELECT count(*) AS pairs, count(depth) AS found, round(count(depth) / count(*), 6) AS found_fraction, round(avg(depth), 6) AS mean_depth FROM seen")
def dep_reach_overall(s, d):
    c = _crossed(s, d)
    return c.agg(F.count("*").alias("pairs"), F.count("depth").alias("found"), F.round(F.count("depth") / F.count("*"), 6).alias("found_fraction"), F.round(F.avg("depth"), 6).alias("mean_depth"))


# ---- shortest paths on the succession graph ---------------------------------------------------

_STARTS, _PATH_ROUNDS = 40, 2
_SUCC = f"{V.SUC}, e AS MATERIALIZED (SELECT source, target, count(*) AS uses FROM suc GROUP BY 1, 2), names AS (SELECT DISTINCT source AS name FROM e), {_pairs_sql('names', _STARTS, _PATH_ROUNDS)}"


def _bfs_sql(starts: str, most: int) -> str:
    return f"r AS (SELECT start, start AS node, 0 AS depth FROM {starts} UNION SELECT r.start, e.target, r.depth + 1 FROM r JOIN e ON r.node = e.source WHERE r.depth < {most}), b AS MATERIALIZED (SELECT start, node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY 1, 2)"


def _path_pairs(s, edges):
    names = edges.select(F.col("source").alias("name"))
    return cut(s, H.paired(names, _PATH_ROUNDS, _STARTS).select(F.col("a").alias("start"), F.col("b").alias("goal")).distinct(), "path-pairs")


@query(f"""WITH RECURSIVE {_SUCC}, {_bfs_sql("(SELECT DISTINCT a AS start FROM pair) q", PATH_EDGES)}, par AS MATERIALIZED (SELECT x.start, x.node, x.depth, min(e.source) AS parent FROM b x JOIN e ON e.target = x.node JOIN b y ON y.start = x.start AND y.node = e.source AND y.depth = x.depth - 1 GROUP BY 1, 2, 3),
 back AS (SELECT q.start, q.goal, p.depth AS step, p.parent AS source, p.node AS target FROM (SELECT DISTINCT a AS start, b AS goal FROM pair) q JOIN par p ON p.start = q.start AND p.node = q.goal
 UNION ALL SELECT k.start, k.goal, p.depth, p.parent, p.node FROM back k JOIN par p ON p.start = k.start AND p.node = k.source)
 SELECT start, goal, step, source, target, uses FROM back JOIN e USING (source, target)""")
def dependency_paths(s, d):
    """A shortest path of at most seven edges for each pair, with the record of every edge on it."""
    e = cut(s, V.succession(s, d).groupBy("source", "target").agg(F.count("*").alias("uses")), "uses")
    pairs = _path_pairs(s, e)
    starts, fronts = G.fronts(s, e, pairs.select("start"), PATH_EDGES)
    return G.paths_back(s, e, fronts, pairs.join(starts, "start"), PATH_EDGES).select("start", "goal", "step", "source", "target", "uses")


_EXAMPLES = [(0, 7), (1, 1), (3, -5)]


@query(f"""WITH RECURSIVE {V.SUC}, e AS MATERIALIZED (SELECT DISTINCT source, target FROM suc), q AS (SELECT * FROM (VALUES {", ".join(map(str, _EXAMPLES))}) v(start, goal)), n AS (SELECT source AS node FROM e UNION SELECT target FROM e), {_bfs_sql("q", PATH_EDGES)}
 SELECT CAST(q.start AS BIGINT) AS start, CAST(q.goal AS BIGINT) AS goal, CASE WHEN q.start NOT IN (SELECT node FROM n) OR q.goal NOT IN (SELECT node FROM n) THEN 'unknown node' WHEN depth IS NULL THEN 'no path' ELSE 'found' END AS status, coalesce(depth, -1) AS edges FROM q LEFT JOIN b ON b.start = q.start AND b.node = q.goal""")
def example_paths(s, d):
    """Three fixed questions; one that names an unknown node is answered, not raised."""
    q = s.createDataFrame(_EXAMPLES, "start long, goal long")
    e = V.succession(s, d)
    nodes = e.select(F.col("source").alias("node")).union(e.select("target")).distinct()
    b = G.bfs(s, e, q.select("start", F.col("start").alias("node")), PATH_EDGES).select("start", F.col("node").alias("goal"), F.col("depth").alias("edges"))
    known = q.join(nodes.toDF("start"), "start", "left_semi").join(nodes.toDF("goal"), "goal", "left_semi").withColumn("known", F.lit(True))
    got = q.join(b, ["start", "goal"], "left").join(known, ["start", "goal"], "left")
    status = F.when(F.col("known").isNull(), "unknown node").when(F.col("edges").isNull(), "no path").otherwise("found")
    return got.select("start", "goal", status.alias("status"), F.coalesce("edges", F.lit(-1).cast("long")).alias("edges"))


def _levels_sql(names: str) -> str:
    return f"{_bfs_sql(f'(SELECT name AS start FROM {names}) q', 8)}, lev AS (SELECT start, depth, count(*) AS n FROM b WHERE depth > 0 GROUP BY 1, 2), sizes AS (SELECT start, depth, n FROM lev UNION ALL SELECT start, max(depth) + 1, 0 FROM b GROUP BY start HAVING max(depth) < 8)"


def _levels(s, d, most=None):
    """start, depth, n: nodes first met at each depth, and a closing 0 for the level that dies; of all starts, or of the first ``most`` by md5."""
    e = V.arcs(s, d)
    starts = e.select(F.col("source").alias("start")).distinct()
    if most is not None:
        starts = starts.orderBy(F.md5(F.col("start").cast("string").cast("binary")), "start").limit(most)
    starts, fronts = G.fronts(s, e, starts, 8)
    bits = F.array(*[F.sum(F.expr(f"getbit(mask, {k})")) for k in range(64)])  # a row a word and depth leaves a task, not one a start and node
    met = fronts.groupBy("word", "depth").agg(bits.alias("bits")).select("word", "depth", F.posexplode("bits").alias("bit", "n"))
    n = cut(s, met.where("n > 0").join(starts, ["word", "bit"]).select("start", "depth", "n"), "levels")
    last = n.groupBy("start").agg((F.max("depth") + 1).alias("depth")).where("depth <= 8").withColumn("n", F.lit(0).cast("long"))
    return n.where("depth > 0").unionByName(last)


@query(f"WITH RECURSIVE {_SUCC}, {_levels_sql('few')} SELECT start, CAST(depth AS BIGINT) AS depth, CAST(n AS BIGINT) AS n FROM sizes")
def frontier_sizes_full(s, d):
    return _levels(s, d, _STARTS)


@query(f"WITH RECURSIVE {_SUCC}, {_levels_sql('names')} SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n_sources, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.99), 6) AS p99, CAST(max(n) AS BIGINT) AS most FROM sizes GROUP BY 1")
def path_sweep_frontier(s, d):
    """Of every node that leads anywhere: pairs of nodes, so quadratic in their number; 64 starts share a row."""
    p = lambda q: F.round(F.percentile("n", q), 6)
    return _levels(s, d).groupBy("depth").agg(F.count("*").alias("n_sources"), F.round(F.avg("n"), 6).alias("mean"), p(0.5).alias("median"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max("n").alias("most"))


@query(f"""WITH RECURSIVE {_SUCC}, {_bfs_sql("(SELECT DISTINCT a AS start FROM pair) q", 8)}, p AS (SELECT q.start, q.goal, depth FROM (SELECT DISTINCT a AS start, b AS goal FROM pair) q LEFT JOIN b ON b.start = q.start AND b.node = q.goal)
 SELECT count(*) AS pairs, count(depth) AS found, round(count(depth) / count(*), 6) AS found_fraction, round(avg(depth), 6) AS mean_length, round(quantile_cont(depth, 0.5), 6) AS median_length FROM p""")
def path_sweep_pairs(s, d, arcs=None):
    """Pairs are searched from both ends, so levels meet long before they hold the whole graph. arcs: V.arcs, where it is written already."""
    arcs = V.arcs(s, d) if arcs is None else arcs
    found = H.arc_paths(s, arcs, _path_pairs(s, arcs).withColumnRenamed("goal", "target"), 8)
    p = found.select(F.when(F.col("found"), F.col("depth")).alias("depth"))
    return p.agg(F.count("*").alias("pairs"), F.count("depth").alias("found"), F.round(F.count("depth") / F.count("*"), 6).alias("found_fraction"), F.round(F.avg("depth"), 6).alias("mean_length"), F.round(F.percentile("depth", 0.5), 6).alias("median_length"))
