"""Queries of the text functions on names, printed states, tactics and generated code made from the tables' rows.

Spark takes the printed texts apart; the twins know the parts from which they were put together.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from . import views as V
from .registry import query

_CASES = """cases AS (SELECT l_orderkey AS name, list('case L' || l_linenumber || chr(10) || 'h : ℕ' || chr(10) || '⊢ ' || l_partkey || ' =  ' || l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS states,
 list(l_partkey || ' =  ' || l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS goals FROM lineitem GROUP BY 1)"""


@query(f"""WITH {_CASES} SELECT name, CAST(len(states) AS BIGINT) AS n, array_to_string(states, '#') AS states, array_to_string(goals, '#') AS goals, substr(sha256(states[1]), 1, 16) AS first_id, substr(sha256(array_to_string(goals, chr(10) || '||' || chr(10))), 1, 16) AS goal_id,
 left('case L' || regexp_extract(states[1], 'case L([0-9]+)', 1) || ' h : ℕ ⊢ ' || replace(goals[1], '  ', ' '), 24) AS excerpt, len(states) > 1 AS differs FROM cases""")
def state_texts(s, d):
    """Orders as printed states of a goal a line: split into states and goals, with their ids and an excerpt."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    one = lambda x: F.concat(F.lit("case L"), x["l_linenumber"].cast("string"), F.lit("\nh : ℕ\n⊢ "), x["l_partkey"].cast("string"), F.lit(" =  "), x["l_suppkey"].cast("string"))
    t = V.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(F.transform(F.array_sort(F.collect_list(line)), one).alias("cases"))
    text = F.concat(F.when(F.size("cases") > 1, F.concat(F.size("cases").cast("string"), F.lit(" goals\n"))).otherwise("\n "), F.array_join("cases", "\n\n"), F.lit(" \n"))
    t = t.select("name", text.alias("text"), F.element_at("cases", 1).alias("first"))
    states = T.split_state(F.col("text"))
    return t.select("name", F.size(states).cast("long").alias("n"), F.array_join(states, "#").alias("states"), F.array_join(T.extract_goals(F.col("text")), "#").alias("goals"), T.state_id(states[0]).alias("first_id"), T.goal_id(F.col("text")).alias("goal_id"), T.excerpt(states[0], 24).alias("excerpt"), (~T.states_match(F.col("text"), F.col("first"))).alias("differs"))


@query("""SELECT p_partkey AS name, CASE p_partkey % 4 WHEN 0 THEN replace(p_brand, '#', '') WHEN 1 THEN 'F.lean' ELSE 'UNKNOWN' END AS area, CASE WHEN p_partkey % 4 = 0 THEN replace(p_brand, '#', '') ELSE 'UNKNOWN' END AS area_of_three,
 left('P_' || p_partkey || '_' || replace(p_brand, '#', '_') || '_x', 140) AS safe, 'n' || p_partkey AS last, 'a.b' || p_partkey || '|x' || '''' || '|h_1' AS names FROM part""")
def name_texts(s, d):
    """Areas of paths, names fit for files, last segments and identifiers of parts."""
    key, brand = F.col("p_partkey").cast("string"), F.regexp_replace("p_brand", "#", "")
    four = F.col("p_partkey") % 4
    path = F.when(four == 0, F.concat(F.lit("Mathlib/"), brand, F.lit("/F.lean"))).when(four == 1, F.lit("Mathlib/F.lean")).when(four == 2, F.concat(F.lit("Init/"), brand, F.lit("/F.lean"))).otherwise("Mathlib")
    safe = T.safe_name(F.concat(F.lit("P  "), key, F.lit("/("), F.col("p_brand"), F.lit("#  x")))
    names = T.identifiers(F.concat(F.lit("(a.b"), key, F.lit(" + x') = 7 * h_1")))
    return V.table(s, d, "part").select(F.col("p_partkey").alias("name"), T.category(path).alias("area"), T.category(path, min_parts=3).alias("area_of_three"), safe.alias("safe"), T.last_segment(F.concat(F.lit("A.b.n"), key)).alias("last"), F.array_join(names, "|").alias("names"))


@query("""SELECT o_orderkey AS name, 'L' || o_custkey || '|f (b, ' || o_orderkey || ')|[c, {d, e}]' AS pieces, CASE WHEN o_orderkey % 2 = 0 THEN 'fwd|rev|fwd' ELSE 'rev|fwd|rev' END AS ways,
 CASE WHEN o_orderkey % 2 = 0 THEN 'simp only [L' || o_custkey || ']' ELSE 'simp only [← L' || o_custkey || '] at h' || o_orderkey || ' ⊢' END AS replayed FROM orders""")
def tactic_texts(s, d):
    """Orders as tactics: lemmas between top commas, directions of tagged premises, a single lemma replayed."""
    key, lemma, even = F.col("o_orderkey").cast("string"), F.concat(F.lit("L"), F.col("o_custkey").cast("string")), F.col("o_orderkey") % 2 == 0
    listed = F.concat(lemma, F.lit(",  f (b, "), key, F.lit("), , [c, {d, e}]"))
    tag = lambda rev, name: F.concat(F.when(rev, "← ").otherwise(""), F.lit("<a>"), F.lit(name), F.lit("</a>"))
    annotated = F.concat(F.lit("rw ["), tag(~even, "some.long.name"), F.lit(", "), tag(even, "other.long.name"), F.lit(", "), tag(~even, "x"), F.lit("]"))
    tactic = F.concat(F.lit("simp ["), listed, F.when(even, "]").otherwise(F.concat(F.lit("] at h"), key, F.lit(" ⊢"))))
    replayed = T.replay_tactic(tactic, F.lit("simp only"), lemma, F.when(even, "fwd").otherwise("rev"))
    return V.table(s, d, "orders").select(F.col("o_orderkey").alias("name"), F.array_join(T.split_top_commas(listed), "|").alias("pieces"), F.array_join(T.premise_directions(annotated), "|").alias("ways"), replayed.alias("replayed"))


@query("""SELECT c_custkey AS name, CASE c_custkey % 3 WHEN 0 THEN 'theorem t' || c_custkey || ' : P := by' || chr(10) || '  simp' || chr(10) WHEN 1 THEN 'theorem t' || c_custkey || ' : Q := by omega' || chr(10) ELSE 'theorem t' || c_custkey || ' : Q := by' || chr(10) || 'rfl' || chr(10) END AS block FROM customer""")
def generated_blocks(s, d):
    """Replies with code in fences, as declarations: their own one, or put under the given header."""
    key, kind = F.col("c_custkey").cast("string"), F.col("c_custkey") % 3
    own = F.concat(F.lit("import M\n\ntheorem t"), key, F.lit(" : P := by\n  simp\n"))
    code = F.when(kind == 0, own).when(kind == 1, F.lit("by omega")).otherwise("  rfl")
    reply = F.concat(F.lit("first ```lean\nold\n``` then\n```lean4\n"), code, F.lit("\n```\nas asked"))
    header = F.concat(F.lit("theorem t"), key, F.lit(" : Q := by"))
    return V.table(s, d, "customer").select(F.col("c_custkey").alias("name"), T.candidate_block(T.last_code_block(reply), header).alias("block"))
