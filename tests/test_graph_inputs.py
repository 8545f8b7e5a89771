"""Graph queries without a DuckDB twin: the whole succession graph and the reference's default parameters."""

import inspect

import pytest

from tracegraph.operators import graphs as G
from tracegraph.operators import spectral as S
from tracegraph.operators import traces as R
from tracegraph.plans import catalogue
from tracegraph.plans import views as V

SF = "/root/testdata/sf0.001"
WANT = {
    "spectral_coords": (S, "coordinates", {"k": 10, "rounds": 30}),
    "effective_resistance": (S, "coordinates", {"k": 10, "rounds": 30}),
    "link_prediction": (S, "coordinates", {"k": 10, "rounds": 30}),
    "walk_embeddings": (S, "walk_embeddings", {"walks": 10, "length": 40, "size": 64, "window": 5}),
    "random_walks": (G, "random_walks", {"walks": 10, "length": 40}),
    "betweenness_sampled": (G, "betweenness", {}),
    "mined_motifs": (R, "mine", {"max_edges": 6, "max_tree_edges": 5}),
}


class Called(Exception):
    pass


@pytest.mark.parametrize("name", sorted(WANT))
def test_input(spark, monkeypatch, name):
    module, function, parameters = WANT[name]
    signature = inspect.signature(getattr(module, function))

    def record(*args, **named):
        bound = signature.bind(*args, **named)
        bound.apply_defaults()
        raise Called(bound.arguments)

    monkeypatch.setattr(module, function, record)
    with pytest.raises(Called) as caught:
        catalogue.QUERIES[name](spark, SF)
    held = caught.value.args[0]
    assert {k: held[k] for k in parameters} == parameters
    if "und" in held:
        whole = G.undirected(V.succession(spark, SF))
        assert held["und"].count() == whole.count() > 0 and held["und"].exceptAll(whole).isEmpty()
