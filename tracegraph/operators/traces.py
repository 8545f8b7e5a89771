"""Traced theorems to dependency tables, state graphs, labelled DAGs and their frequent parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.iterate import cut, forget


def tactics(traces: DataFrame) -> DataFrame:
    """One row per tactic of each named theorem, with its index and position in the input (ordinal, idx)."""
    named = traces.where("coalesce(full_name, '') <> ''")
    t = named.select(F.col("full_name").alias("theorem"), "file_path", "split", "ordinal", F.posexplode("traced_tactics").alias("idx", "t"))
    return t.select("theorem", "file_path", "split", "ordinal", "idx", F.col("t.tactic").alias("tactic"), T.tactic_head(F.coalesce("t.tactic", F.lit(""))).alias("head"), F.col("t.state_before").alias("before"), F.col("t.state_after").alias("after"), F.col("t.annotated_tactic.text").alias("annotated"), F.col("t.annotated_tactic.premises").alias("premises"))


def _uses(traces: DataFrame) -> DataFrame:
    p = tactics(traces).select("*", F.posexplode("premises").alias("pos", "p")).where("coalesce(p.full_name, '') <> ''")
    return p.select(F.col("theorem").alias("source"), F.col("p.full_name").alias("target"), F.col("file_path").alias("source_file"), F.coalesce("p.def_path", F.lit("")).alias("target_file"), "split", F.col("idx").alias("tactic_index"), "tactic", F.col("head").alias("tactic_head"), F.struct("ordinal", "idx", "pos").alias("seen"))


def dependency_edges(traces: DataFrame) -> DataFrame:
    """Unique (source, target) with the attributes of the first use and the number of uses."""
    kept = ["source_file", "target_file", "split", "tactic_index", "tactic", "tactic_head"]
    e = _uses(traces).groupBy("source", "target").agg(F.min_by(F.struct(*kept), "seen").alias("first"), F.count("*").alias("occurrences"))
    return e.select("source", "target", "first.*", "occurrences").withColumn("source_category", T.category(F.col("source_file"))).withColumn("target_category", T.category(F.col("target_file")))


def dependency_nodes(traces: DataFrame) -> DataFrame:
    """name, file_path, category, kind by first sighting; a theorem is sighted before its premises."""
    none = F.lit(-1)
    own = traces.where("coalesce(full_name, '') <> ''").select(F.col("full_name").alias("name"), "file_path", F.lit("theorem").alias("kind"), F.struct(F.col("ordinal"), none.alias("idx"), none.alias("pos")).alias("seen"))
    used = _uses(traces).select(F.col("target").alias("name"), F.col("target_file").alias("file_path"), F.lit("premise").alias("kind"), "seen")
    n = own.unionByName(used).groupBy("name").agg(F.min_by(F.struct("file_path", "kind"), "seen").alias("first"))
    return n.select("name", "first.*").withColumn("category", T.category(F.col("file_path")))


def dependency_stats(traces: DataFrame) -> DataFrame:
    """theorems (named or not), traced, tactics, premise occurrences: one pass without a shuffle of rows."""
    steps = F.coalesce(F.size("traced_tactics"), F.lit(0))
    named = F.coalesce("full_name", F.lit("")) != ""
    uses = F.aggregate(F.coalesce("traced_tactics", F.array()), F.lit(0), lambda acc, t: acc + F.size(F.filter(F.coalesce(t["annotated_tactic"]["premises"], F.array()), lambda p: F.coalesce(p["full_name"], F.lit("")) != "")))
    return traces.agg(F.count("*").alias("theorems"), F.count_if(named & (steps > 0)).alias("traced"), F.sum(F.when(named, F.greatest(steps, F.lit(0))).otherwise(0)).alias("tactics"), F.sum(F.when(named, uses).otherwise(0)).alias("occurrences"))


def _sides(traces: DataFrame) -> DataFrame:
    return tactics(traces).withColumn("ins", T.split_state(F.coalesce("before", F.lit("")))).withColumn("outs", T.split_state(F.coalesce("after", F.lit(""))))


def state_nodes(traces: DataFrame) -> DataFrame:
    """id, state, goal_hash, occurrences of single-goal states on either side of a tactic, and the solved state with 0."""
    s = _sides(traces)
    seen = s.select("ordinal", "idx", F.explode(F.concat("ins", "outs")).alias("state")).where("state <> 'no goals'")
    n = seen.groupBy(T.state_id(F.col("state")).alias("id")).agg(F.min_by("state", F.struct("ordinal", "idx")).alias("state"), F.count("*").alias("occurrences"))
    solved = traces.sparkSession.createDataFrame([(T.NO_GOALS, "no goals", None, 0)], "id string, state string, goal_hash string, occurrences long")
    return n.select("id", "state", T.goal_id(F.col("state")).alias("goal_hash"), "occurrences").unionByName(solved)


def state_hyperedges(traces: DataFrame) -> DataFrame:
    """input, outputs, tactic, tactic_head, theorems, occurrences: unique by (input, tactic, sorted outputs).

    Each input goal of a step leads to all of its output goals, untouched siblings among them.
    """
    ids = F.transform("outs", T.state_id)
    rows = _sides(traces).select("theorem", "ordinal", "idx", T.py_strip(F.coalesce("tactic", F.lit(""))).alias("tactic"), F.col("head").alias("tactic_head"), ids.alias("outputs"), F.explode("ins").alias("state")).where("state <> 'no goals'")
    seen = F.struct("ordinal", "idx")
    per = rows.groupBy(T.state_id(F.col("state")).alias("input"), "tactic", F.array_sort("outputs").alias("key"), "theorem").agg(F.min(seen).alias("seen"), F.min_by("outputs", seen).alias("outputs"), F.first("tactic_head").alias("tactic_head"), F.count("*").alias("n"))
    e = per.groupBy("input", "tactic", "key").agg(F.min_by("outputs", "seen").alias("outputs"), F.first("tactic_head").alias("tactic_head"), F.transform(F.array_sort(F.collect_list(F.struct("seen", "theorem"))), lambda x: x["theorem"]).alias("theorems"), F.sum("n").alias("occurrences"))
    return e.drop("key").withColumn("id", F.substring(F.sha2(F.to_json(F.struct("input", "tactic", "outputs")), 256), 1, 20))


def initial_states(traces: DataFrame) -> DataFrame:
    """name, file_path, initial_state_id, initial_goal_hash of the first goal before the first tactic; later rows win."""
    rows = _sides(traces).where("idx = 0").select(F.col("theorem").alias("name"), "ordinal", F.struct("file_path", F.col("ins")[0].alias("state")).alias("r"))
    last = rows.groupBy("name").agg(F.max_by("r", "ordinal").alias("r"))
    return last.select("name", "r.file_path", T.state_id(F.col("r.state")).alias("initial_state_id"), T.goal_id(F.col("r.state")).alias("initial_goal_hash"))


def ordered_premises(annotated: Column, premises: Column) -> Column:
    """array of (name, literal, direction, path): first of each name; the i-th tag gives literal and direction, else '?'."""
    literal = F.regexp_extract_all(F.coalesce(annotated, F.lit("")), F.lit(r"(?s)<a>(.*?)</a>"), F.lit(1))
    direction = T.premise_directions(F.coalesce(annotated, F.lit("")))
    listed = F.transform(F.coalesce(premises, F.array()), lambda p, i: F.struct(p["full_name"].alias("name"), F.coalesce(F.nullif(F.get(literal, i), F.lit("")), p["full_name"]).alias("literal"), F.coalesce(F.get(direction, i), F.lit("?")).alias("direction"), F.coalesce(p["def_path"], F.lit("")).alias("path")))
    named = F.filter(listed, lambda p: F.coalesce(p["name"], F.lit("")) != "")
    names = F.transform(named, lambda p: p["name"])
    return F.filter(named, lambda p, i: F.array_position(names, p["name"]) == i + 1)


def trace_edges(traces: DataFrame) -> DataFrame:
    """One typed edge per tactic and input goal, from the trace alone: what needs a running prover is left out.

    Columns: theorem, file_path, edge, kind, head, premises, lemmas, directions, tactic_text, in_state,
    out_states, source_tactic_index, is_fallback, is_branching. Both sides are split into goals, so that
    the edges after a branching step meet its branches.
    """
    s = _sides(traces).withColumn("p", ordered_premises(F.col("annotated"), F.col("premises")))
    rows = s.select("theorem", "file_path", F.col("idx").alias("source_tactic_index"), "head", "p", "tactic", "outs", F.posexplode("ins").alias("sub", "in_state")).where("in_state <> 'no goals'")
    kind = T.tactic_kind(F.col("head"), F.size("p") > 0)
    steps = kind.isin("rewrite_step", "simp_bundle")
    names, ways = F.transform("p", lambda p: p["name"]), F.transform("p", lambda p: p["direction"])
    empty = F.array().cast("array<string>")
    return rows.select("theorem", "file_path", F.format_string("%06d.%03d", "source_tactic_index", "sub").alias("edge"), kind.alias("kind"), "head", F.col("p").alias("premises"), F.when(steps, names).otherwise(empty).alias("lemmas"), F.when(steps, ways).otherwise(empty).alias("directions"), F.col("tactic").alias("tactic_text"), "in_state", F.col("outs").alias("out_states"), "source_tactic_index", (kind == "simp_bundle").alias("is_fallback"), (F.size("outs") > 1).alias("is_branching"))


def edge_label() -> Column:
    """kind, head, lemma_tuple, direction_tuple of a typed edge; steps keep the order of lemmas, the rest is sorted."""
    names, ways = F.transform("premises", lambda p: p["name"]), F.transform("premises", lambda p: p["direction"])
    step = F.col("kind").isin("simp_step", "rewrite_step")
    empty = F.array().cast("array<string>")
    lemmas = F.when(step, F.col("lemmas")).when(F.col("kind") == "simp_bundle", F.array_sort("lemmas")).when(F.col("kind") == "decision_opaque", empty).otherwise(F.array_sort(names))
    return F.struct("kind", "head", lemmas.alias("lemma_tuple"), F.when(step, F.col("directions")).when(F.col("kind") == "term", ways).otherwise(empty).alias("direction_tuple"))


def dag_edges(edges: DataFrame, match: str = "state") -> DataFrame:
    """theorem, file_path, edge, in_node, out_nodes, label. match 'goal' keys nodes by goal, where there is one."""
    if match not in ("state", "goal"):
        raise ValueError(f"match is state or goal, not {match}")
    key = (lambda c: T.state_id(c)) if match == "state" else (lambda c: F.when(T.py_strip(c) == "no goals", T.NO_GOALS).otherwise(T.goal_id(c, "state")))
    return edges.select("theorem", "file_path", "edge", key(F.col("in_state")).alias("in_node"), F.transform("out_states", key).alias("out_nodes"), edge_label().alias("label"))


def sorted_side(table: DataFrame) -> DataFrame:
    """A table whose join sorts both sides: written DAGs are tiny as files and large as rows, so Spark would broadcast them by their files' size."""
    return table.hint("merge")


def dag_paths(spark: SparkSession, dag: DataFrame, low: int, high: int) -> DataFrame:
    """theorem, edges, nodes, labels of every forward path of low to high edges that uses no edge twice.

    Grown edge by edge by a join on (theorem, node); each length is a written table.
    """
    hops = cut(spark, dag.select("theorem", "edge", "in_node", "label", F.explode("out_nodes").alias("out_node")), "hops")
    at = hops.select("theorem", F.array("edge").alias("edges"), F.array("in_node", "out_node").alias("nodes"), F.array("label").alias("labels"), F.col("out_node").alias("end"))
    found = []
    for length in range(1, high + 1):
        if length > 1:
            grown = at.join(sorted_side(hops), (at.theorem == hops.theorem) & (at.end == hops.in_node)).where(~F.array_contains("edges", F.col("edge")))
            at = cut(spark, grown.select(at.theorem, F.array_append("edges", F.col("edge")).alias("edges"), F.array_append("nodes", F.col("out_node")).alias("nodes"), F.array_append("labels", F.col("label")).alias("labels"), F.col("out_node").alias("end")), "paths")
        if length >= low:
            found.append(at.drop("end"))
    return reduce(DataFrame.unionByName, found)


def branch_sets(spark: SparkSession, dag: DataFrame, high: int) -> DataFrame:
    """theorem, root, start, edges (sorted), parts of connected edge sets of 2 to high edges grown from a branching edge.

    parts are the (in_node, label, out_nodes) of the set's edges, the start's first. A set carries its open
    edges in order and all edges ever seen from it: taking one leaves those before it out for good, and
    only edges not yet seen are opened. So each set is made in one way only and nothing is deduplicated;
    a size is one join by (theorem, edge). An edge that follows itself is not opened.
    """
    tuple_of = F.struct("in_node", "label", "out_nodes")
    own = cut(spark, dag.select("theorem", "edge", "in_node", tuple_of.alias("part")), "edges")
    follow = own.select("theorem", F.col("edge").alias("from"), F.explode(F.array_distinct("part.out_nodes")).alias("in_node")).join(sorted_side(own.select("theorem", "in_node", "edge")), ["theorem", "in_node"]).where(F.col("from") != F.col("edge"))
    after = follow.groupBy("theorem", F.col("from").alias("edge")).agg(F.array_sort(F.collect_set("edge")).alias("after"))
    none = F.array().cast(after.schema["after"].dataType)
    table = cut(spark, own.join(sorted_side(after), ["theorem", "edge"], "left").select("theorem", "edge", "part", F.coalesce("after", none).alias("after")), "dag")
    at = table.where(F.size("part.out_nodes") > 1).select("theorem", F.col("part.in_node").alias("root"), F.col("edge").alias("start"), F.array("edge").alias("edges"), F.array("part").alias("parts"), F.col("after").alias("open"), F.array_append("after", F.col("edge")).alias("seen"))
    forget(spark, own)
    step = table.withColumnRenamed("edge", "next")
    found = []
    for size in range(2, high + 1):
        taken = at.select("*", F.posexplode("open").alias("at", "next")).withColumn("open", F.slice("open", F.col("at") + 2, F.size("open")))
        grown = taken.join(sorted_side(step), ["theorem", "next"]).withColumn("fresh", F.array_except("after", "seen"))
        kept = [F.array_append("edges", F.col("next")).alias("edges"), F.array_append("parts", F.col("part")).alias("parts")]
        wider = [F.concat("open", "fresh").alias("open"), F.concat("seen", "fresh").alias("seen")] if size < high else []
        at = cut(spark, grown.select("theorem", "root", "start", *kept, *wider), "sets")
        found.append(at.select("theorem", "root", "start", F.array_sort("edges").alias("edges"), "parts"))
    return reduce(DataFrame.unionByName, found)


def path_signature() -> Column:
    """24 hex digits of nodes and labels in order."""
    return F.substring(F.sha2(F.to_json(F.struct("nodes", "labels")), 256), 1, 24)


def set_signature() -> Column:
    """24 hex digits of the root and the multiset of (in_node, label, out_nodes).

    A recursive canonical hash that names nodes separates exactly these multisets, so none is computed.
    """
    return F.substring(F.sha2(F.to_json(F.struct(F.col("root"), F.array_sort(F.transform("parts", lambda p: F.to_json(p))).alias("parts"))), 256), 1, 24)


_DIGEST = ["d0", "d1", "d2", "d3"]


def alike(spark: SparkSession, dag: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The DAGs of one theorem of each class; (theorem, digest, theorems, places) of these; (theorem, file_path, head, digest) of all.

    Theorems are of one class if their DAGs have the same (in_node, label, out_nodes), each as often. Edges' names
    are left out, so paths and edge sets have the same signatures, as often, in all of a class: they are enumerated
    in its least theorem and counted for all. The digest is the sums of two 64-bit hashes' halves (``_DIGEST``), so no list is made of a
    theorem's edges. places is the number of (theorem, file_path); head is 1 in one row of each theorem.
    """
    named = dag.where("theorem is not null")
    part = F.to_json(F.struct("in_node", "label", "out_nodes"))
    hashed = named.select("theorem", "file_path", part.alias("part")).select("theorem", "file_path", F.xxhash64("part").alias("a"), F.xxhash64(F.lit(1), "part").alias("b"))
    halves = [half(F.col(c)) for c in ("a", "b") for half in (lambda h: F.shiftright(h, 32), lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    files = hashed.repartition("theorem").groupBy("theorem", "file_path").agg(*[F.sum(h).alias(d) for d, h in zip(_DIGEST, halves)])
    w = Window.partitionBy("theorem")
    members = cut(spark, files.select("theorem", "file_path", (F.row_number().over(w.orderBy("file_path")) == 1).cast("int").alias("head"), *[F.sum(d).over(w).alias(d) for d in _DIGEST]), "members")
    classes = cut(spark, members.groupBy(*_DIGEST).agg(F.min("theorem").alias("theorem"), F.sum("head").alias("theorems"), F.count("*").alias("places")), "classes")
    return named.join(sorted_side(classes.select("theorem")), "theorem", "left_semi"), classes, members


def _motif_rows(spark: SparkSession, dag: DataFrame, min_edges: int, max_edges: int, max_tree_edges: int) -> DataFrame:
    """theorem, edges, motif_kind, root, nodes, parts, labels of every path and edge set.

    A path has nodes and labels; a set has its root, its parts in the order of their values, and labels in the order it grew.
    """
    p = dag_paths(spark, dag, min_edges, max_edges)
    t = branch_sets(spark, dag, max_tree_edges).where(F.size("edges") >= min_edges).withColumn("labels", F.transform("parts", lambda x: x["label"]))
    no = lambda like, c: F.lit(None).cast(like.schema[c].dataType).alias(c)
    p = p.select("theorem", "edges", F.lit("path").alias("motif_kind"), no(t, "root"), "nodes", no(t, "parts"), "labels")
    return p.unionByName(t.select("theorem", "edges", F.lit("subtree").alias("motif_kind"), "root", no(p, "nodes"), F.array_sort("parts").alias("parts"), "labels"))


def _signed(rows: DataFrame) -> DataFrame:
    """Rows of ``_motif_rows`` with their signature and node_count."""
    held = F.flatten(F.transform("parts", lambda x: F.array_append(x["out_nodes"], x["in_node"])))
    path = F.col("motif_kind") == "path"
    return rows.withColumn("signature", F.when(path, path_signature()).otherwise(set_signature())).withColumn("node_count", F.size(F.array_distinct(F.when(path, F.col("nodes")).otherwise(held))))


def _distinct_files(best: DataFrame, holders: DataFrame, members: DataFrame) -> DataFrame:
    """place, distinct_files of the best motifs: a file has a bit a motif, so it is one row however many motifs it holds."""
    words = range(-(-max(1, best.count()) // 63))  # at most ``top`` motifs
    bits = lambda k: F.bit_or(F.when(F.floor(F.col("place") / 63) == k, F.expr("shiftleft(1L, cast(place % 63 as int))")).otherwise(F.lit(0).cast("long"))).alias(f"w{k}")
    masks = holders.groupBy(*_DIGEST).agg(*[bits(k) for k in words])
    files = members.where("file_path is not null").join(masks, _DIGEST).groupBy("file_path").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in words])
    seen = F.flatten(F.array(*[F.expr(f"transform(filter(sequence(0, 62), b -> getbit(w{k}, b) = 1), b -> b + {63 * k})") for k in words]))
    return files.groupBy(*[f"w{k}" for k in words]).agg(F.count("*").alias("n")).select(F.explode(seen).alias("place"), "n").groupBy("place").agg(F.sum("n").alias("distinct_files"))


def mine(spark: SparkSession, dag: DataFrame, min_edges: int = 2, max_edges: int = 6, max_tree_edges: int = 5, min_support: int = 3, min_theorems: int = 2, min_gain: int = 6, max_examples: int = 5, top: int = 100) -> DataFrame:
    """The top motifs by gain, support, distinct theorems and signature: paths and branching edge sets.

    Motifs of opaque decisions alone are left out. Paths and sets are enumerated in one theorem of each class
    (``alike``) with numbers for labels, and counted for all; only motifs, not their occurrences, are signed. Examples are the
    first of each motif by (theorem, edges); they are enumerated in the first theorems of the motifs that are
    returned only, and labels are those of the first example.
    """
    first, classes, members = alike(spark, dag)
    labels = cut(spark, first.select("label").distinct().withColumn("code", F.monotonically_increasing_id()), "labels")
    coded = cut(spark, first.join(labels, "label").withColumn("label", F.col("code")).drop("code"), "coded")
    shape = ["motif_kind", "root", "nodes", "parts", "codes"]
    rows = _motif_rows(spark, coded, min_edges, max_edges, max_tree_edges)
    rows = rows.withColumn("codes", F.when(F.col("motif_kind") == "path", F.col("labels")).otherwise(F.transform("parts", lambda x: x["label"])))
    per = cut(spark, rows.groupBy(*shape, "theorem").agg(F.count("*").alias("n")), "motif-counts")
    m = per.join(sorted_side(classes), "theorem").groupBy(*shape).agg(F.sum(F.col("n") * F.col("places")).alias("support"), F.sum("theorems").alias("distinct_theorems"))
    m = m.withColumn("edge_count", F.size("codes")).withColumn("complexity_gain", T.motif_gain(F.col("edge_count"), F.col("support")))
    m = cut(spark, m.where((F.col("support") >= min_support) & (F.col("distinct_theorems") >= min_theorems) & (F.col("complexity_gain") >= min_gain)).withColumn("id", F.monotonically_increasing_id()), "frequent")
    meant = m.select("id", F.posexplode("codes").alias("at", "code")).join(labels, "code").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("labels"))
    whole = F.zip_with("parts", "labels", lambda p, l: F.struct(p["in_node"].alias("in_node"), l.alias("label"), p["out_nodes"].alias("out_nodes")))
    signed = _signed(m.join(meant, "id").where(~F.forall("labels", lambda x: x["kind"] == "decision_opaque")).withColumn("parts", whole))
    best = signed.orderBy(F.desc("complexity_gain"), F.desc("support"), F.desc("distinct_theorems"), "signature").limit(top)
    keys = ["motif_kind", "signature"]
    best = cut(spark, best.select("id", *keys, "edge_count", "node_count", "support", "distinct_theorems", "complexity_gain").withColumn("place", F.row_number().over(Window.orderBy(*keys)) - 1), "motifs")  # at most ``top`` rows
    chosen = m.join(F.broadcast(best.select("id", "place")), "id").select("place", *shape)
    same = reduce(lambda a, b: a & b, [per[c].eqNullSafe(chosen[c]) for c in shape])
    holders = cut(spark, per.join(F.broadcast(chosen), same).select("place", "theorem", "n").join(sorted_side(classes.select("theorem", *_DIGEST)), "theorem").drop("theorem"), "holders")

    least = members.where("head = 1").select(*_DIGEST, "theorem", F.row_number().over(Window.partitionBy(*_DIGEST).orderBy("theorem")).alias("rn")).where(F.col("rn") <= max_examples).drop("rn")
    some = holders.join(least, _DIGEST).withColumn("rn", F.row_number().over(Window.partitionBy("place").orderBy("theorem"))).where(F.col("rn") <= max_examples)
    some = cut(spark, some.join(F.broadcast(best.select(*keys, "place")), "place").select("place", *keys, "theorem"), "shown")  # at most ``top`` times ``max_examples`` rows
    shown = cut(spark, dag.join(F.broadcast(some.select("theorem").distinct()), "theorem", "left_semi"), "shown-dags")
    found = _signed(_motif_rows(spark, shown, min_edges, max_edges, max_tree_edges)).join(F.broadcast(some), [*keys, "theorem"])
    found = found.withColumn("rn", F.row_number().over(Window.partitionBy("place").orderBy("theorem", "edges"))).where(F.col("rn") <= max_examples)
    shown = found.groupBy("place").agg(F.min_by("labels", "rn").alias("edge_labels"), F.array_sort(F.collect_list(F.struct("theorem", "edges"))).alias("examples"))

    areas = members.groupBy(*_DIGEST, T.category(F.col("file_path"), min_parts=3).alias("category")).agg(F.count("*").alias("places"))
    areas = holders.join(areas, _DIGEST).groupBy("place", "category").agg(F.sum(F.col("n") * F.col("places")).alias("n"))
    areas = areas.groupBy("place").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories"))
    out = best.join(shown, "place", "left").join(areas, "place", "left").join(_distinct_files(best, holders, members), "place", "left")
    return out.select(*keys, "edge_count", "node_count", "support", "distinct_theorems", F.coalesce("distinct_files", F.lit(0).cast("long")).alias("distinct_files"), "complexity_gain", "edge_labels", "examples", "categories")


def tree_metrics(traces: DataFrame) -> DataFrame:
    """theorem, depth, width, n_tactic_steps, n_leaves, max_branching: the goals of a proof replayed as a stack.

    The fold keeps the depths still open, the count per depth and the leaves; it stops taking steps when
    nothing is open. One array fold per theorem, no shuffle.
    """
    goals = lambda t: T.split_printed_goals(t["state_after"])
    out = lambda t: F.when(F.coalesce(t["state_after"], F.lit("")).isin("", "no goals"), 0).otherwise(F.size(goals(t)))
    start = F.struct(F.array(F.lit(0)).alias("open"), F.array(F.lit(0)).alias("layers"), F.lit(0).alias("leaves"), F.lit(0).alias("steps"), F.lit(0).alias("widest"))

    def step(acc: Column, k: Column) -> Column:
        child = F.get(acc["open"], F.lit(0)) + 1
        children = F.array_repeat(child, F.greatest(k, F.lit(1)))
        rest = F.slice(acc["open"], 2, F.greatest(F.size(acc["open"]), F.lit(1)))
        taken = F.struct(
            F.when(k == 0, rest).otherwise(F.concat(children, rest)).alias("open"),
            F.concat(acc["layers"], children).alias("layers"),
            (acc["leaves"] + F.when(k == 0, 1).otherwise(0)).alias("leaves"),
            (acc["steps"] + F.greatest(k, F.lit(1))).alias("steps"),
            F.greatest(acc["widest"], k, F.lit(1)).alias("widest"),
        )
        return F.when(F.size(acc["open"]) > 0, taken).otherwise(acc)

    rows = traces.where("size(traced_tactics) > 0").select(F.col("full_name").alias("theorem"), F.aggregate(F.transform("traced_tactics", out), start, step).alias("r"))
    depths = F.sequence(F.lit(0), F.array_max("r.layers"))
    width = F.array_max(F.transform(depths, lambda d: F.size(F.filter("r.layers", lambda x: x == d))))
    return rows.select("theorem", F.array_max("r.layers").alias("depth"), width.alias("width"), F.col("r.steps").alias("n_tactic_steps"), F.greatest("r.leaves", F.lit(1)).alias("n_leaves"), F.col("r.widest").alias("max_branching"))
