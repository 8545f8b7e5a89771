"""Figure data: pairs are searched from both ends, and the succession graph is written once."""

from collections import defaultdict, deque

from tracegraph.operators import graphs as G
from tracegraph.plans import catalogue, searches  # isort: skip
from tracegraph.plans import audit  # isort: skip (needs the catalogue)
from tracegraph.plans import views as V

SF = "/root/testdata/sf0.001"


def test_pairs_without_whole_fronts(spark, monkeypatch):
    monkeypatch.setattr(G, "fronts", None)  # a search from the starts alone visits the whole graph
    arcs, after = V.arcs(spark, SF), defaultdict(set)
    for r in arcs.collect():
        after[r.source].add(r.target)

    def depth(start, goal):
        seen, queue = {start: 0}, deque([start])
        while queue:
            node = queue.popleft()
            for to in after[node] - seen.keys():
                seen[to] = seen[node] + 1
                queue.append(to)
        return seen.get(goal, 9)

    want = [depth(r.start, r.goal) for r in searches._path_pairs(spark, arcs).collect()]
    found = [k for k in want if k <= 8]
    got = catalogue.QUERIES["path_sweep_pairs"](spark, SF).first()
    assert (got.pairs, got.found) == (len(want), len(found)) and abs(got.mean_length - sum(found) / len(found)) < 1e-6


def test_succession_is_derived_once(spark, monkeypatch):
    made, succession = [], V.succession
    monkeypatch.setattr(V, "succession", lambda *a: made.append(a) or succession(*a))
    assert catalogue.QUERIES["figure_points"](spark, SF).count() > 0
    assert len(made) == 1


def test_reports_share_the_succession_graph(spark, monkeypatch):
    hubs = {(f"name={r.name}", float(r.degree)) for r in catalogue.QUERIES["top_hubs"](spark, SF).collect()}
    made, succession = [], V.succession
    monkeypatch.setattr(V, "succession", lambda *a: made.append(a) or succession(*a))
    monkeypatch.setattr(audit, "REPORTS", {k: audit.REPORTS[k] for k in ("hubs", "degree tail")})
    rows = audit._numbers(spark, SF).collect()
    assert len(made) == 1
    assert {(r.case, r.value) for r in rows if r.artifact == "hubs"} == hubs
