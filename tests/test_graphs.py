import itertools
import random

import pytest

from causelake.errors import GraphError, NotIdentified, ReviewRequired, Unsupported
from causelake.graphs.dag import Admg, Dag, Mixed, unfold
from causelake.operators.ci import oracle_test
from causelake.operators.discovery import fci, pc
from causelake.plans import identify as idf
from causelake.plans.expr import P, text
from causelake.sources import graphs as io


def random_dag(rng, n, p):
    names = [f"v{i}" for i in range(n)]
    return Dag(names, [(a, b) for a, b in itertools.combinations(names, 2) if rng.random() < p])


def path_separated(g, x, y, z):
    """d-separation by listing all paths."""
    stack = [[x]]
    while stack:
        p = stack.pop()
        if p[-1] == y:
            ok = True
            for a, b, c in zip(p, p[1:], p[2:]):
                collider = b in g.children[a] and b in g.children[c]
                if collider and not g.descendants([b]) & set(z) or not collider and b in z:
                    ok = False
            if ok:
                return False
            continue
        stack += [[*p, n] for n in g.parents[p[-1]] | g.children[p[-1]] if n not in p]
    return True


def test_separation_agrees_with_paths():
    rng = random.Random(1)
    for _ in range(60):
        g = random_dag(rng, 5, 0.5)
        x, y, *rest = rng.sample(g.nodes, 5)
        z = rng.sample(rest, rng.randint(0, 3))
        assert g.separated([x], [y], z) == path_separated(g, x, y, z)


def test_cycles_are_refused():
    with pytest.raises(GraphError):
        Dag("abc", [("a", "b"), ("b", "c"), ("c", "a")])


def test_identification():
    confounded = Dag("ztmy", [("z", "t"), ("z", "y"), ("t", "m"), ("m", "y")])
    assert idf.backdoor(confounded, "t", "y").adjustment == ("z",)
    front = Admg("tmy", [("t", "m"), ("m", "y")], [("t", "y")])
    assert idf.frontdoor(front, "t", "y").mediators == ("m",)
    assert text(idf.identify_do(front, ["y"], ["t"])) == "sum_{m}[P(m|t) sum_{t}[P(t) P(y|m,t)]]"
    with pytest.raises(NotIdentified):
        idf.backdoor(front, "t", "y")
    bow = Admg("ty", [("t", "y")], [("t", "y")])
    with pytest.raises(NotIdentified):
        idf.identify_do(bow, ["y"], ["t"])
    assert idf.instrument(Admg("zty", [("z", "t"), ("t", "y")], [("t", "y")]), "t", "y").instruments == ("z",)
    assert idf.identify_do(Dag("ty", [("t", "y")]), ["y"], ["t"]) == P(("y",), ("t",))


def test_recanting_witness_and_shift_are_refused():
    g = Dag("twamy", [("t", "w"), ("w", "a"), ("a", "y"), ("t", "m"), ("w", "m"), ("m", "y"), ("w", "y")])
    with pytest.raises(NotIdentified):
        idf.path_specific(g, "t", "y", [("t", "w", "a", "y")])
    assert idf.path_specific(g, "t", "y", [("t", "w")]).mediators == ("w",)
    ok = Dag("tmy", [("t", "m"), ("m", "y"), ("t", "y")])
    assert idf.path_specific(ok, "t", "y", [("t", "m")]).mediators == ("m",)
    with pytest.raises(Unsupported):
        idf.normalise_intervention("shift", 1.0)


def test_transport_and_bounds():
    g = Dag("zty", [("z", "t"), ("z", "y"), ("t", "y")])
    assert idf.transport_certificate(g, "t", "y", ["z"]).adjustment == ("z",)
    assert idf.transport_certificate(g, "t", "y", []).strategy == "transport.direct"
    low, high = idf.binary_iv_bounds({(z, d, y): 0.25 for z in (0, 1) for d in (0, 1) for y in (0, 1)})
    assert low == pytest.approx(-0.5) and high == pytest.approx(0.5)


def test_pc_and_fci_recover_known_graphs():
    g = Dag("abcd", [("a", "c"), ("b", "c"), ("c", "d")])
    found = pc(g.nodes, oracle_test(g))
    assert found.directed("a", "c") and found.directed("b", "c") and found.directed("c", "d")
    latent = Dag("habxy", [("a", "x"), ("h", "x"), ("h", "y"), ("b", "y")]).latent_projection("abxy")
    pag = fci(["a", "b", "x", "y"], oracle_test(latent))
    assert pag.mark["x", "y"] == ">" and pag.mark["y", "x"] == ">"


def test_class_members_and_review():
    chain = Mixed.from_dag(Dag("abc", [("a", "b"), ("b", "c")]))
    assert len(list(chain.dags())) == 3
    with pytest.raises(ReviewRequired) as e:
        idf.require_reviewed(chain)
    assert len(e.value.pending) == 2
    review = idf.Review(chain.copy())
    review.orient("a", "b")
    review.orient("b", "c")
    assert review.accept().edges == [("a", "b"), ("b", "c")]
    shares = idf.generalised_adjustment(chain, "a", "c")
    assert sum(s for s, _ in shares) == pytest.approx(1)


def test_temporal():
    g = unfold([("x", 1, "x"), ("x", 1, "y")], 3)
    assert ("x@0", "y@1") in g.edges
    assert idf.temporal_backdoor([("x", 1, "x"), ("x", 1, "y")], "x", "y", 1).adjustment == ("x__lag2",)
    assert len(idf.temporal_mediation([("t", 1, "m"), ("m", 1, "y"), ("t", 2, "y")], "t", "y", 2)) == 2


@pytest.mark.parametrize("forms", [(io.to_dot, io.from_dot), (io.to_json, io.from_json), (io.to_gml, io.from_gml), (io.to_node_link, io.from_node_link)])
def test_interchange_round_trips(forms):
    write, read = forms
    g = Admg(["a", "b", "c"], [("a", "b"), ("b", "c")], [("a", "c")])
    back = read(write(g))
    assert (back.nodes, back.edges, back.bidirected) == (g.nodes, g.edges, g.bidirected)
