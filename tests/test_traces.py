"""Trace operators against the hand-made trace, brute force on small DAGs, and declaration sources."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracegraph.functions import text as T
from tracegraph.operators import declarations as D
from tracegraph.operators import traces as R
from tracegraph.sources import artifacts


def _premise(name, path):
    return {"full_name": name, "def_path": path, "def_pos": [1, 1], "def_end_pos": [1, 2]}


def _step(tactic, before, after, annotated=None, premises=()):
    return {"tactic": tactic, "state_before": before, "state_after": after, "annotated_tactic": {"text": annotated or tactic, "premises": list(premises)}}


UC, PX, PY = _premise("U.c", "Mathlib/Beta/Y.lean"), _premise("P.x", "Init/Z.lean"), _premise("P.y", "Mathlib/Alpha/X.lean")
A, B, C = "x : N\n⊢ A", "x : N\n⊢ B", "⊢ P ∧ Q"
LEFT, RIGHT = "case left\n⊢ P", "case right\n⊢ Q"
TRAIN = [
    {"full_name": "T.a", "file_path": "Mathlib/Alpha/X.lean", "traced_tactics": [_step("rw [U.c, ← P.x]", A, B, "rw [<a>U.c</a>, ← <a>P.x</a>]", [UC, PX]), _step("exact U.c", B, "no goals", None, [UC])]},
    {"full_name": "U.c", "file_path": "Mathlib/Beta/Y.lean", "traced_tactics": [_step("constructor", C, f"{LEFT}\n\n{RIGHT}"), _step("simp", f"{LEFT}\n\n{RIGHT}", RIGHT, None, [PY]), _step("omega", RIGHT, "no goals")]},
]
VAL = [{"full_name": "P.x", "file_path": "Init/Z.lean", "traced_tactics": []}, {"full_name": None, "file_path": "Mathlib/Q.lean", "traced_tactics": None}]


@pytest.fixture(scope="module")
def traces(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("traces")
    (folder / "train.json").write_text(json.dumps(TRAIN))
    (folder / "val.json").write_text(json.dumps(VAL))
    return artifacts.read_traces(spark, str(folder))


def test_dependencies(traces):
    e = {(r.source, r.target): r for r in R.dependency_edges(traces).collect()}
    assert {k: (r.occurrences, r.tactic_index, r.tactic_head) for k, r in e.items()} == {("T.a", "U.c"): (2, 0, "rw"), ("T.a", "P.x"): (1, 0, "rw"), ("U.c", "P.y"): (1, 1, "simp")}
    assert e["T.a", "P.x"].target_category == "UNKNOWN"
    n = {r.name: (r.kind, r.category) for r in R.dependency_nodes(traces).collect()}
    assert n == {"T.a": ("theorem", "Alpha"), "U.c": ("premise", "Beta"), "P.x": ("premise", "UNKNOWN"), "P.y": ("premise", "Alpha")}
    assert tuple(R.dependency_stats(traces).first()) == (4, 2, 5, 4)


def test_states(traces):
    n = {r.state: r.occurrences for r in R.state_nodes(traces).collect()}
    assert n == {A: 1, B: 2, C: 1, LEFT: 2, RIGHT: 4, "no goals": 0}
    ids = {r.id: r.state for r in R.state_nodes(traces).collect()}
    h = sorted((ids[r.input], r.tactic_head, [ids[o] for o in r.outputs]) for r in R.state_hyperedges(traces).collect())
    assert h == sorted([(A, "rw", [B]), (B, "exact", ["no goals"]), (C, "constructor", [LEFT, RIGHT]), (LEFT, "simp", [RIGHT]), (RIGHT, "simp", [RIGHT]), (RIGHT, "omega", ["no goals"])])
    assert {r.name: ids[r.initial_state_id] for r in R.initial_states(traces).collect()} == {"T.a": A, "U.c": C}


def test_edges_labels_and_tree_metrics(traces):
    e = R.trace_edges(traces)
    got = sorted((r.theorem, r.source_tactic_index, r.kind, r.is_branching) for r in e.collect())
    assert got == [("T.a", 0, "rewrite_step", False), ("T.a", 1, "term", False), ("U.c", 0, "structural", True), ("U.c", 1, "simp_bundle", False), ("U.c", 1, "simp_bundle", False), ("U.c", 2, "decision_opaque", False)]
    labels = {(r.theorem, r.edge): r.label for r in R.dag_edges(e).collect()}
    rewrite = labels["T.a", "000000.000"]
    assert (rewrite.lemma_tuple, rewrite.direction_tuple) == (["U.c", "P.x"], ["fwd", "rev"])
    term = labels["T.a", "000001.000"]
    assert (term.lemma_tuple, term.direction_tuple) == (["U.c"], ["?"])
    m = {r.theorem: tuple(r)[1:] for r in R.tree_metrics(traces).collect()}
    assert m == {"T.a": (2, 1, 2, 1, 1), "U.c": (3, 2, 4, 1, 2)}


def _brute_paths(edges, low, high):
    out = []

    def walk(nodes, used):
        if low <= len(used) <= high:
            out.append((tuple(used), tuple(nodes)))
        if len(used) < high:
            for i, (a, _, outs) in edges.items():
                if a == nodes[-1] and i not in used:
                    for o in outs:
                        walk(nodes + [o], used + [i])

    for i, (a, _, outs) in edges.items():
        for o in outs:
            walk([a, o], [i])
    return Counter(out)


def _brute_sets(edges, high):
    found = {}
    for start, (root, _, outs) in edges.items():
        if len(outs) < 2:
            continue
        level = {frozenset([start])}
        for _ in range(2, high + 1):
            level = {s | {i} for s in level for i, e in edges.items() if i not in s and any(e[0] in edges[j][2] for j in s)}
            found |= {(start, s): root for s in level}
    return found


def _canonical(node, held, edges, seen=frozenset()):
    below = [(edges[i][1], [_canonical(o, held, edges, seen | {i}) for o in edges[i][2]]) for i in held if edges[i][0] == node and i not in seen]
    return repr((node, sorted(map(repr, below))))


def test_paths_and_sets_against_brute_force(spark):
    rng = random.Random(4)
    rows, dags = [], {}
    for t in range(6):
        edges = {}
        for i in range(7):
            a = rng.randrange(5)
            outs = sorted(rng.sample(range(a + 1, 8), rng.choice([1, 1, 2])))
            edges[f"e{i}"] = (f"n{a}", rng.choice("ab"), [f"n{o}" for o in outs])
        dags[f"t{t}"] = edges
        rows += [(f"t{t}", f"f{t % 2}", i, a, outs, ("structural", lab, [], [])) for i, (a, lab, outs) in edges.items()]
    dag = spark.createDataFrame(rows, "theorem string, file_path string, edge string, in_node string, out_nodes array<string>, label struct<kind:string,head:string,lemma_tuple:array<string>,direction_tuple:array<string>>")
    got, want = defaultdict(Counter), {t: _brute_paths(e, 2, 4) for t, e in dags.items()}
    for r in R.dag_paths(spark, dag, 2, 4).collect():
        got[r.theorem][tuple(r.edges), tuple(r.nodes)] += 1
    assert all(got[t] == want[t] for t in dags)
    sets = R.branch_sets(spark, dag, 4).withColumn("signature", R.set_signature()).collect()
    assert {(r.theorem, r.start, frozenset(r.edges)): r.root for r in sets} == {(t, *k): root for t, e in dags.items() for k, root in _brute_sets(e, 4).items()}
    assert len(sets) == len({(r.theorem, r.start, frozenset(r.edges)) for r in sets})
    pairs = {(r.signature, _canonical(r.root, set(r.edges), dags[r.theorem])) for r in sets}
    assert len(pairs) == len({s for s, _ in pairs}) == len({c for _, c in pairs})
    mined = R.mine(spark, dag, 2, 3, 3, min_support=1, min_theorems=1, min_gain=-9, top=1000).collect()
    paths = Counter()
    for t, e in dags.items():
        for (used, nodes), n in _brute_paths(e, 2, 3).items():
            paths[nodes, tuple(e[i][1] for i in used)] += n
    assert sorted(r.support for r in mined if r.motif_kind == "path") == sorted(paths.values())
    assert all(sum(r.categories.values()) == r.support and len(r.examples) <= 5 for r in mined)


SOURCE = """import X
namespace A.B
theorem one (x : N) :
    x = x := by
  simp
section
private lemma two.b : True := trivial
end
lemma three (h : P)
    : Q by
  omega
namespace C
theorem _root_.four :
  let y := 1
  y = 1 := rfl
end C
theorem five : R := by rfl
"""


def test_declarations(spark):
    src = spark.createDataFrame([("Mathlib/M/F.lean", SOURCE), ("Mathlib/E.lean", None), ("Init/E.lean", "")], "path string, content string")
    got = [(r.kind, r.full_name, r.line, r.declaration_header) for r in D.declarations(src).orderBy("line").collect()]
    assert got == [
        ("theorem", "A.B.one", 3, "theorem one (x : N) :\n    x = x := by"),
        ("lemma", "two.b", 7, "private lemma two.b : True := by"),
        ("lemma", "three", 9, "lemma three (h : P)\n    : Q := by"),
        ("theorem", "four", 13, "theorem _root_.four :\n  let y := 1\n  y = 1 := by"),
        ("theorem", "five", 17, "theorem five : R := by"),
    ]
    base = spark.createDataFrame([("Mathlib/M/F.lean", "namespace A.B\ntheorem one : T := x\n")], "path string, content string")
    new = D.manifest(src, base, 10)
    assert sorted(r.full_name for r in new.collect()) == ["five", "four", "three", "two.b"]
    code = {r.full_name: r.code for r in D.spliced(new, src).collect()}
    assert code["five"] == "".join(x + "\n" for x in SOURCE.splitlines()[:16]) + "theorem five : R := by\n  sorry\n\n"
    assert "lemma three (h : P)\n    : Q := by\n  sorry\n\ntheorem _root_.four" in code["three"]
    known = spark.createDataFrame([("A.x", [1.0, 2.0]), ("Z.P", [3.0, 6.0]), ("N", [5.0, 4.0]), ("W.N", [0.0, 0.0])], "name string, low array<double>")
    a = {r.full_name: (r.anchor_count, r.anchors, r.low) for r in D.anchors(D.declarations(src), known).collect()}
    assert a["three"] == (1, "Z.P", [3.0, 6.0]) and a["five"] == (0, "", None)
    assert a["A.B.one"] == (2, "A.x;N", [3.0, 3.0])
    assert D.prompts(new).where(F.col("prompt").contains("```lean4\nimport Mathlib")).count() == 4


def test_text_functions(spark):
    def one(value, f):
        return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()[0]

    assert one("a, f (b, c), ← d", T.split_top_commas) == ["a", "f (b, c)", "← d"]
    assert one("Try this: simp only [a, foo [b, c], ← d] at h", T.suggested_lemmas) == ["a", "foo [b, c]", "← d"]
    assert one("Try this: rfl", T.suggested_lemmas) is None and one("Try this: simp [a", T.suggested_lemmas) is None
    replay = lambda c: T.replay_tactic(c, F.lit("simp only"), F.lit("b"), F.lit("rev"))
    assert one("simp [a, b] at h ⊢", replay) == "simp only [← b] at h ⊢" and one("simp [a, b]", replay) == "simp only [← b]"
    assert one("⊢ A\n\nx\n⊢ B", T.split_printed_goals) == ["⊢ A", "x\n⊢ B"] and one("", T.split_printed_goals) == ["no goals"]
    assert one("x  =\n y ", lambda c: T.states_match(c, F.lit("x = y"))) is True
    block = lambda c: T.candidate_block(c, F.lit("theorem t : P := by"))
    assert one("import M\n\ntheorem t : P := by\n  simp\n", block) == "theorem t : P := by\n  simp\n"
    assert one("by simp", block) == "theorem t : P := by simp\n" and one("  simp", block) == "theorem t : P := by\nsimp\n"
    kinds = spark.createDataFrame([("omega", True), ("simp", True), ("rw", True), ("rw", False), ("exact", True), ("intro", False)], "h string, p boolean")
    assert [r[0] for r in kinds.select(T.tactic_kind(F.col("h"), F.col("p"))).collect()] == ["decision_opaque", "simp_bundle", "rewrite_step", "structural", "term", "structural"]
