"""Communities, routes and bridges against plain Python on random nets."""

import random
from collections import Counter

import pytest

from factweave.operators import graph as G, mine as M
from factweave.plans import registry
from factweave.sources.views import Views

DATA = "/root/testdata/sf0.001"


def net(rng, nodes, links):
    out = set()
    while len(out) < links:
        a, b = rng.sample(range(nodes), 2)
        out.add((f"n{min(a, b):02}", f"n{max(a, b):02}"))
    return sorted(out)


def in_turn(links, rounds=8):
    """One node after the other by id; of the neighbours' labels the most common, then the least."""
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    label = {n: n for n in near}
    for _ in range(rounds):
        old = dict(label)
        for n in sorted(near):
            votes = Counter(label[m] for m in near[n])
            label[n] = sorted(votes, key=lambda x: (-votes[x], x))[0]
        if old == label:
            break
    return label


@pytest.mark.parametrize("small", [0, 20, 500_000])
def test_communities_in_the_order_of_ids(spark, small):
    """In tasks, level by level, and some of either; two components, a node with a link to itself only, links given twice."""
    rng = random.Random(2)
    links = net(rng, 9, 14) + [(f"x{a[1:]}", f"x{b[1:]}") for a, b in net(rng, 5, 6)]
    given = links + [(b, a) for a, b in links[:5]] + [("n01", "n01"), ("zz", "zz")]
    df = spark.createDataFrame(given, "a string, b string")
    got = {r.node: r.label for r in G.communities(df, small=small).collect()}
    assert got == in_turn(given) | {"zz": "zz"}


def test_communities_of_the_tables(spark):
    edges = Views(spark, DATA).edges.where("edge_type = 'BECAUSE'").collect()
    got = {r.node: r.label for r in registry.queries()["e16_communities"](spark, DATA).collect()}
    assert got == in_turn([(r.src, r.dst) for r in edges]) and len(got) > 50


def routes(weight, label, max_hops):
    """All simple paths, one step after the other in the order of ids; cut at the first bridge."""
    near = {}
    for a, b in sorted(weight):
        near.setdefault(a, []).append(b)

    def walk(path):
        yield path
        for n in near[path[-1]]:
            if n not in path:
                yield from walk([*path, n])

    for seed in near:
        weakest = lambda p: min((weight[x] for x in zip(p, p[1:])), default=float("inf"))
        best = [seed]
        for p in walk([seed]):
            if (len(p), weakest(p)) > (len(best), weakest(best)):
                best = p
        best = best[: max_hops + 1]
        for k in range(1, len(best) - 1):
            if label[best[k - 1]] != label[best[k + 1]] and (best[k - 1], best[k + 1]) not in weight:
                best = best[: k + 1]
                break
        yield seed, tuple(best), weakest(best) if len(best) > 1 else 0.0


@pytest.mark.parametrize("chunk", [2, 256])
def test_routes_and_bridges(spark, chunk, monkeypatch):
    rng = random.Random(chunk)
    links = net(rng, 8, 11) + [("y1", "y2"), ("y2", "y3")]
    weight = {}
    for a, b in links:
        weight[a, b] = weight[b, a] = rng.randrange(1, 9) / 4
    graph = spark.createDataFrame([(a, b, w) for (a, b), w in weight.items()], "a string, b string, pmi double")
    label = {n: f"c{rng.randrange(3)}" for n in {a for a, _ in weight}}
    labels = spark.createDataFrame(list(label.items()), "node string, label string")
    kept = M.longest_routes
    monkeypatch.setattr(M, "longest_routes", lambda graph, budget: kept(graph, budget, chunk))
    got = {(r.seed, tuple(r.path), r.min_pmi) for r in M.route_subsets(graph, labels, 5).collect()}
    assert got == set(routes(weight, label, 5))
    assert any(len(p) < 6 for _, p, _ in got)


def test_bridges_alone(spark):
    """Equal rows each keep their own; a node without a community is no bridge's end; short paths stay."""
    paths = [["a", "b", "c", "d"], ["a", "b", "c", "d"], ["a", "x", "c"], ["a"], ["a", "b"], ["c", "b", "a"]]
    df = spark.createDataFrame([(p, [1.0] * (len(p) - 1)) for p in paths], "path array<string>, pmis array<double>")
    label = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "2")], "node string, label string")
    graph = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("c", "a")], "a string, b string")
    got = Counter((tuple(r.path), tuple(r.pmis), r.bridge) for r in M.polysemy_cut(df, graph, label).collect())
    assert got == Counter({(("a", "b"), (1.0,), 1): 2, (("a", "x"), (1.0,), 1): 1, (("a",), (), None): 1, (("a", "b"), (1.0,), None): 1, (("c", "b", "a"), (1.0, 1.0), None): 1})
