"""Searches on random state hypergraphs against plain-Python versions."""

import random

import pytest

from tracegraph.operators import searches as H


@pytest.fixture(scope="module", params=[1, 2])
def graph(spark, request):
    rng = random.Random(request.param)
    rows = []
    for k in range(70):
        m = rng.choice([0, 1, 1, 2])
        outputs = [H.DONE] if not m else [f"s{rng.randrange(24):02d}" for _ in range(m)]
        rows.append((k % 9, k, rng.choice(["rw", "simp", "cases"]), f"s{rng.randrange(24):02d}", outputs))
    rows += rows[:20]
    edges = H.hyperedges(spark.createDataFrame(rows, "theorem long, ord long, tactic string, input string, outputs array<string>"))
    return rows, spark.createDataFrame(edges.collect(), edges.schema)


def distances(rows, start):
    level, seen, depth = {start}, {start: 0}, 0
    while level:
        depth += 1
        level = {o for _, _, _, i, outs in rows if i in level for o in outs} - set(seen)
        seen |= dict.fromkeys(level, depth)
    return seen


def test_hyperedges(graph):
    rows, edges = graph
    want = {}
    for theorem, ord_, tactic, state, outputs in rows:
        held = want.setdefault((state, tactic, tuple(sorted(outputs))), [outputs, [], 0])
        held[2] += 1
        if theorem not in held[1]:
            held[1].append(theorem)
    got = {(r.input, r.tactic, tuple(sorted(r.outputs))): [r.outputs, r.theorems, r.occurrences] for r in edges.collect()}
    assert got.keys() == want.keys() and all(got[k][1:] == v[1:] for k, v in want.items())


def test_or_paths_and_steps(spark, graph):
    rows, edges = graph
    names = [f"s{k:02d}" for k in range(0, 24, 2)]
    pairs = spark.createDataFrame([(a, b) for a in names for b in [*names[:4], H.DONE, "nowhere"]], "start string, target string")
    dist = {a: distances(rows, a) for a in {*(f"s{k:02d}" for k in range(24)), H.DONE}}
    for most in (3, 10):
        for r in H.or_paths(spark, edges, pairs, most).collect():
            d = dist[r.start].get(r.target, 99)
            assert (r.found, r.depth) == ((True, d) if d <= most else (False, -1))
            if r.found:
                middle = [m for m, k in dist[r.start].items() if k == -(-d // 2) and dist[m].get(r.target) == d - k]
                assert r.meet == min(middle)
    steps = {}
    for r in H.path_steps(spark, edges, pairs, 10).collect():
        steps.setdefault((r.start, r.target), []).append((r.step, r.input, r.tactic, r.output))
    known = {(i, t, o) for _, _, t, i, outs in rows for o in outs}
    for a, b in [(r.start, r.target) for r in pairs.collect()]:
        d = dist[a].get(b, 0)
        path = sorted(steps.get((a, b), []))
        assert len(path) == d
        if d:
            assert path[0][1] == a and path[-1][3] == b and all(x[3] == y[1] for x, y in zip(path, path[1:])) and all(p[1:] in known for p in path)


def test_discharge_and_proofs(spark, graph):
    rows, edges = graph
    oracles = [None, "s03", "s11"]
    want = {}
    for oracle in oracles:
        level = {H.DONE: 0} | ({oracle: 0} if oracle else {})
        for depth in range(1, 30):
            level |= dict.fromkeys({i for _, _, _, i, outs in rows if i not in level and all(level.get(o, 99) < depth for o in outs)}, depth)
        want |= {(oracle, n): d for n, d in level.items()}
    for most in (2, 30):
        got = H.discharge(spark, edges, spark.createDataFrame([(o,) for o in oracles], "oracle string"), most)
        assert {(r.oracle, r.node): r.depth for r in got.collect()} == {k: d for k, d in want.items() if d <= most}
    levels = {n: d for (o, n), d in want.items() if o is None}
    held = {(r.input, r.tactic, tuple(r.outputs)): r.occurrences for r in edges.collect()}
    proofs = H.proofs(edges, got.where("oracle is null")).collect()
    assert {r.node for r in proofs} == {n for n, d in levels.items() if d}
    for r in proofs:
        fit = [(len(o), -c, t, "|".join(o)) for (i, t, o), c in held.items() if i == r.node and all(levels.get(x, 99) < levels[i] for x in o)]
        assert (r.tactic, "|".join(r.outputs)) == min(fit)[2:]


def test_pairs(spark):
    names = spark.createDataFrame([(k,) for k in range(50)], "name long")
    rows = H.paired(names, 3, 20).collect()
    assert 40 <= len(rows) <= 60 and all(r.a != r.b for r in rows) and len({r.a for r in rows}) <= 20
    assert sorted(map(tuple, rows)) == sorted(map(tuple, H.paired(names.repartition(7), 3, 20).collect()))


def test_pairs_retire_early(spark, graph):
    """Fewer rows of new levels than two searches to half the depth from all starts and targets."""
    rows, edges = graph
    names = [f"s{k:02d}" for k in range(24)]
    pairs = [(a, b) for a in names for b in (names[3], names[7], H.DONE)]
    grown = []
    got = H.or_paths(spark, edges, spark.createDataFrame(pairs, "start string, target string"), 10, rows=grown).collect()
    dist = {a: distances(rows, a) for a in {*names, H.DONE}}
    assert {(r.start, r.target): r.depth for r in got} == {(a, b): dist[a].get(b, -1) for a, b in pairs}
    back = {b: {a for a in names if 0 < dist[a].get(b, 99) <= 5} for b in {b for _, b in pairs}}
    whole = sum(len([1 for d in dist[a].values() if 0 < d <= 5]) for a in {a for a, _ in pairs}) + sum(map(len, back.values()))
    assert 0 < sum(grown) < whole


def test_far_pair_is_found_from_both_ends(spark):
    """A long chain next to a bush: the smaller side grows, and the middle state is that of the plain search."""
    rows = [(0, k, "rw", f"c{k:02d}", [f"c{k + 1:02d}"]) for k in range(9)] + [(0, 50 + k, "simp", "c00", [f"x{k:02d}"]) for k in range(30)] + [(0, 90 + k, "simp", f"x{k:02d}", [f"y{k:02d}"]) for k in range(30)]
    edges = H.hyperedges(spark.createDataFrame(rows, "theorem long, ord long, tactic string, input string, outputs array<string>"))
    pairs = spark.createDataFrame([("c00", "c09"), ("c00", "y07"), ("c09", "c00"), ("c04", "c04")], "start string, target string")
    got = {(r.start, r.target): (r.depth, r.meet) for r in H.or_paths(spark, edges, pairs, 9).collect()}
    assert got == {("c00", "c09"): (9, "c05"), ("c00", "y07"): (2, "x07"), ("c09", "c00"): (-1, None), ("c04", "c04"): (0, "c04")}
    assert all(not r.found for r in H.or_paths(spark, edges, pairs.where("target = 'c09'"), 8).collect())


def test_proofs_per_oracle_and_budget(spark, graph):
    rows, edges = graph
    names = [f"s{k:02d}" for k in range(24)]
    pairs = spark.createDataFrame([(a, b) for a in names for b in ("s03", "s11")], "start string, target string")
    known = H.discharge(spark, edges, pairs.select("target").distinct().toDF("oracle"), 12)
    known = spark.createDataFrame(known.collect(), known.schema)
    level = {(r.oracle, r.node): r.depth for r in known.collect()}
    steps = H.proof_steps(spark, H.oracle_proofs(edges, known), pairs, 12).collect()
    proof = {}
    for r in steps:
        proof.setdefault((r.start, r.target), {})[r.node] = r
    for a, b in [(r.start, r.target) for r in pairs.collect()]:
        if not level.get((b, a)):
            assert (a, b) not in proof
            continue
        held, seen, at = proof[a, b], set(), [a]
        while at:
            n = at.pop()
            if n in (b, H.DONE) or n in seen:
                continue
            seen.add(n)
            assert all(level[b, o] < level[b, n] for o in held[n].outputs) and held[n].depth == level[b, n]
            at += held[n].outputs
        assert seen == set(held)

    def opened(a, b, depth):
        got, at = set(), {a}
        for _ in range(depth):
            at = {x for x in at if x not in (b, H.DONE)} - got
            got |= at
            at = {o for _, _, _, i, outs in rows if i in at for o in outs}
        return len(got)

    for most in (5, 1000):
        for r in H.discharge_search(spark, edges, pairs, known, 12, most).collect():
            depth = level.get((r.target, r.start))
            n = opened(r.start, r.target, 12 if depth is None else depth)
            assert (r.expansions, r.exhausted) == (n, n > most)
            assert (r.solved, r.depth) == ((True, depth) if depth is not None and n <= most else (False, -1))
