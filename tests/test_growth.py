"""Cases in which a step once grew faster than its input."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from factweave.operators import graph as G, mine as M, rank as R, write as W
from factweave.operators.paths import longest_in_net, longest_path, longest_route
from factweave.plans import registry


def _above_pairs(df):
    """What stands above the step that makes pairs in the plan."""
    return df._jdf.queryExecution().analyzed().toString().split("MapInArrow")[0]


def _facts(rng, several=False):
    base = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(12)]
    facts = [(f"m{k:02}", base[k % 12] if k % 4 else base[0]) for k in range(60)] + [("zero", [0.0] * 4), ("none", None)]
    return facts + ([("m03", base[5]), ("m07", base[1])] if several else [])


def _cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(np.dot(a, b) / n), 9) if n else 0.0


def _all_pairs(facts):
    best = {}
    some = [(m, v) for m, v in facts if v]
    for m, a in some:
        for x, b in some:
            if m < x:
                best[m, x] = max(_cosine(a, b), best.get((m, x), -2.0))
    return best


def test_closest_pairs_keep_their_best_in_the_task(spark):
    """Many equal cosines, names barred from the larger side, an id with two vectors; only the best leave a task."""
    for several in (False, True):
        facts = _facts(random.Random(3), several)
        df = spark.createDataFrame(facts, "memory_id string, embedding array<double>").repartition(3)
        barred = spark.createDataFrame([("m08",), ("m59",)], "memory_id string")
        want = sorted((-c, b, a) for (a, b), c in _all_pairs(facts).items() if c >= 0.2 and b not in ("m08", "m59"))
        for most in (1, 40, 10_000):
            got = [(-round(r.cosine, 9), r.b, r.a) for r in R.closest_pairs(df, barred, 0.2, most, n_pivots=5, block=7).collect()]
            assert sorted(got) == want[:most]


def test_pairs_of_facts_are_not_shuffled(spark):
    rng = random.Random(5)
    for several in (False, True):
        facts = _facts(rng, several)
        names = sorted({m for m, _ in facts})
        rows = [(m, f"k{i % 7}" if i % 11 else "", i % 2) for i, m in enumerate(names)]
        keyed = {m: (k, d) for m, k, d in rows}
        df = spark.createDataFrame(facts, "memory_id string, embedding array<double>").repartition(3)
        out = W.paraphrases(df, spark.createDataFrame(rows, "memory_id string, content_key string, domain long"), 0.3)
        want = {(a, b): c for (a, b), c in _all_pairs(facts).items() if c >= 0.3 and keyed[a][0] and keyed[b][0] and keyed[a][0] != keyed[b][0] and keyed[a][1] == keyed[b][1]}
        assert {(r.a, r.b): round(r.cosine, 9) for r in out.collect()} == want
        assert several or not any(step in _above_pairs(out) for step in ("Join", "Aggregate"))


def _hub(spark):
    """A hub of alike edges, some of its leaves joined, both ways."""
    rng = random.Random(6)
    one = [("hub", f"n{k:02}", "X", 0.5 if k % 9 else 0.9) for k in range(60)] + [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}", "Y", rng.choice((0.2, 0.5, 0.5))) for _ in range(25)]
    rows = sorted({r for a, b, t, w in one for r in ((a, b, t, w), (b, a, f"{t}_IN", w / 2))})
    return rows, spark.createDataFrame(rows, "src string, dst string, edge_type string, weight double")


def test_a_hub_meets_its_queries_in_cells(spark):
    rows, walk = _hub(spark)
    at = [(q, n) for q in range(20) for n in ("hub", f"n{q:02}")]
    met = G.neighbours(spark.createDataFrame(at, "query_id long, node string"), walk, hot=7)
    assert sorted(map(tuple, met.select("query_id", "node", "dst", "edge_type", "weight").collect())) == sorted((q, a, b, t, w) for q, n in at for a, b, t, w in rows if a == n)
    assert met.rdd.glom().map(len).reduce(max) < 600


def test_a_beam_takes_few_of_many_alike_edges(spark):
    """Level by level by hand; chains and ranks over blocks are those over each query's own edges."""
    rows, walk = _hub(spark)
    seeds = [(q, n, 1.0) for q in range(12) for n in {"hub" if q % 3 else "n00", f"n{q:02}"}]
    df = spark.createDataFrame(seeds, "query_id long, node string, score double")
    want, edges = set(), set()
    for q in range(12):
        front = {n: s for i, n, s in seeds if i == q}
        seen = set(front)
        for level in (1, 2, 3):
            edges |= {(q, a, b, t) for a, b, t, _ in rows if a in front}
            fresh = [(round(front[a] * w, 12), b, a, t) for a, b, t, w in rows if a in front and b not in seen]
            want |= {(q, b, a, t, s, level) for s, b, a, t in fresh}
            new = {}
            for a in front:
                for s, b, _, _ in sorted((x for x in fresh if x[2] == a), key=lambda x: (-x[0], x[1], x[3]))[:3]:
                    new[b] = max(s, new.get(b, 0.0))
            front, seen = new, seen | set(new)
    found, ego = G.expand_beam(df, walk, 3)
    assert sorted(map(tuple, found.select("query_id", "memory_id", "parent", "edge", "graph_score", "depth").collect())) == sorted(want)
    assert sorted(map(tuple, ego.drop("weight").collect())) == sorted(edges)
    blocks = G.nets(df, walk, 3, 5)
    assert blocks.where("child is not null").count() < len(edges)
    ranks = lambda x: {(r.query_id, r.memory_id): round(r.ppr, 9) for r in x.collect()}
    assert ranks(G.net_pagerank(blocks)) == ranks(G.personalized_pagerank(ego, df))
    chains = lambda x: {r.query_id: (r.path, r.hops, r.confidence) for r in x.collect()}
    assert len(chains(G.longest_chain(blocks))) == 12 and chains(G.longest_chain(blocks, 3000)) == chains(G.longest_chain(ego, 3000))


def test_runs_of_leaves_are_steps_of_the_same_walk():
    for t in range(200):
        r = random.Random(t)
        n = r.randint(2, 7)
        links = sorted((a, b, r.choice([0.0, 0.25, 0.5, 0.9, 1.0])) for a in r.sample(range(n + 8), n) for b in (r.randrange(n + 8) for _ in range(r.randint(1, 6))) if a != b)
        adj = {}
        for a, b, w in links:
            adj.setdefault(a, []).append((b, w))
        first = np.searchsorted([x[0] for x in links], np.arange(n + 9))
        for budget in (1, 3, 17, 60, 10**5):
            want = longest_path(adj, sorted({x for e in links for x in e[:2]}), budget, lambda c, w: c * w, 1.0)
            assert longest_in_net(np.array(sorted(adj)), first, np.array([x[1] for x in links]), np.array([x[2] for x in links]), budget) == want


def test_keyword_search_ranks_in_the_task(spark):
    """Words of all texts and rare ones, empty texts and queries; no pair of query and text is joined or summed as a row."""
    rng = random.Random(8)
    words = [f"word{k}" for k in range(40)]
    text = lambda n: " ".join(["common", *rng.choices(words, weights=range(1, 41), k=n)])
    facts = [(f"m{k:03}", text(rng.randint(1, 30)) if k % 13 else "") for k in range(90)] + [("m900", text(5))]
    asked = [(k, text(6) + " common unknownword") for k in range(12)] + [(90, ""), (91, "unknownword")]
    q, m = spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(facts, "memory_id string, content string").repartition(3)
    mean, n = sum(len(t.split()) for _, t in facts) / len(facts), len(facts)
    df = {w: sum(w in t.split() for _, t in facts) for w in [*words, "common"]}
    for idf, k1, k in ((False, 1.5, 5), (True, 1.2, 500)):
        want = {}
        for i, t in asked:
            tokens, found = t.split(), []
            for x, c in facts:
                own = c.split()
                tf = {w: own.count(w) for w in own}
                s = sum((np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) if idf else 1.0) * tf[w] * (k1 + 1) / (tf[w] + k1 * (0.25 + 0.75 * len(own) / mean)) for w in tokens if w in tf)
                if s:
                    found.append((-round(s if idf else min(s / len(tokens), 1.0), 6), x))
            want |= {(i, x): -s for s, x in sorted(found)[:k]} if k > 100 else {(i, r): -s for r, (s, _) in enumerate(sorted(found)[:k], 1)}
        out = (R.bm25_idf_topk if idf else R.bm25_topk)(q, m, k)
        assert {(r.query_id, r.memory_id if k > 100 else r["rank"]): round(r.score, 6) for r in out.collect()} == want
        assert not any(step in _above_pairs(out) for step in ("Join", "Aggregate"))


def test_large_components_go_by_runs_of_nodes_with_the_same_labels(spark):
    rng = random.Random(3)
    links = [(f"n{g * 8 + rng.randrange(8)}", f"n{g * 8 + rng.randrange(8)}") for g in range(6) for _ in range(30)]
    df = spark.createDataFrame(links + [(f"n{g * 8}", f"n{g * 8 + 9}") for g in range(5)], "a string, b string")
    want = {r.node: r.label for r in G.communities(df).collect()}
    assert len(set(want.values())) > 1
    # one link a block: more runs than levels, so by levels
    for block in (1, 40, 10_000):
        assert {r.node: r.label for r in G.communities(df, small=0, block=block).collect()} == want


def test_a_dense_component_is_no_job_for_each_level(spark, monkeypatch):
    calls, kept = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: calls.append(1) or kept(df))
    df = spark.createDataFrame([(f"{a:02d}", f"{b:02d}") for a in range(24) for b in range(a)], "a string, b string")
    assert G.communities(df, small=0).select("label").distinct().count() == 1
    assert len(calls) < 24


def test_tags_meet_in_their_facts_with_repetitions_and_gaps(spark):
    tags = [("m1", "x"), ("m1", "y"), ("m1", "x"), ("m2", "y"), ("m2", "z"), ("m2", "x"), ("m3", "x"), (None, "x"), (None, "x"), ("m4", None)]
    df = spark.createDataFrame(tags, "memory_id string, category_id string")
    got = {(r.a, r.b): (r.n_ab, r.pmi) for r in M.category_pmi(df).collect()}
    assert got == {("x", "y"): (2, round(math.log(2 * 4 / (4 * 2)), 9)), ("x", "z"): (1, round(math.log(1 * 4 / (4 * 1)), 9)), ("y", "z"): (1, round(math.log(1 * 4 / (2 * 1)), 9))}


def test_routes_read_the_tags_once(spark, monkeypatch):
    reads, kept = [], M._by_fact
    monkeypatch.setattr(M, "_by_fact", lambda tags: reads.append(1) or kept(tags))
    registry.queries()["i3_route_subsets"](spark, "/root/testdata/sf0.001")
    assert len(reads) == 1


def test_connect_looks_up_a_hub_and_does_not_unfold_it(spark, monkeypatch):
    links = [("hub", f"n{k:03}", 0.5 + k % 3 / 10) for k in range(60)] + [("a0", "a1", 0.9), ("a1", "hub", 0.7), ("b0", "b1", 0.9), ("b1", "n007", 0.9), ("b1", "n008", 0.9)]
    walk = spark.createDataFrame([r for a, b, w in links for r in ((a, b, w), (b, a, w))], "src string, dst string, weight double").withColumn("edge_type", F.lit("t"))
    pairs = spark.createDataFrame([(1, "a", "a0"), (1, "b", "b0"), (2, "a", "a0"), (2, "b", "n003")], "pair_id long, side string, node string")
    most, kept = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: (lambda out: most.append(out.count()) or out)(kept(df)))
    got = {r.pair_id: r.path for r in G.connect(pairs, walk, 5, hot=20).collect()}
    assert got == {1: ["a0", "a1", "hub", "n008", "b1", "b0"], 2: ["a0", "a1", "hub", "n003"]}
    assert max(most) < 60


def test_vectors_and_hits_are_not_broadcast(spark):
    found = registry.queries()["d21_retrieve"](spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_routes_of_a_dense_graph_are_walked_over_a_window_of_it(spark):
    """The walk is that over the whole graph; what its few steps cannot reach is not packed, and a walk that reaches further gets more."""
    rng = random.Random(4)
    names = [f"n{k:03}" for k in range(90)]
    weight = {(a, b): rng.randrange(1, 6) / 4 for a in names for b in names if a < b and rng.random() < 0.8}
    weight |= {("z1", "z2"): 1.0, ("z2", "z3"): 0.5}
    weight |= {(b, a): w for (a, b), w in weight.items()}
    adj = {}
    for a, b in sorted(weight):
        adj.setdefault(a, []).append((b, weight[a, b]))
    graph = spark.createDataFrame([(a, b, w) for (a, b), w in weight.items()], "a string, b string, pmi double").repartition(3)
    ids = {n: k for k, n in enumerate(sorted(adj))}
    ends = {ids[a]: ([ids[b] for b, _ in e], [w for _, w in e]) for a, e in adj.items()}
    for budget, window in ((100, 32), (1500, 16), (1500, 90)):
        want = {a: longest_path(adj, [a], budget, min, math.inf)[0] for a in adj}
        got = {r.seed: (r.path, r.pmis) for r in M.longest_routes(graph, budget, 40, window).collect()}
        assert got == {a: (p, [weight[x] for x in zip(p, p[1:])]) for a, p in want.items()}
        short = 0
        for a in names:
            near = lambda x: (ends[x][0][:window], ends[x][1][:window], len(ends[x][0]) <= window) if x < window or x == ids[a] else None  # noqa: B023, E731
            walk = longest_route(ids[a], near, budget)
            short += walk is None
            assert walk is None or [ids[x] for x in want[a]] == walk[0]
        assert (short > 0) == (window == 16)
