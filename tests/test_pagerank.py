"""Page rank of the whole graph against the form for one query, and spreading against all walks."""

import random

from pyspark.sql import functions as F

from factweave.operators import graph as G
from factweave.plans import registry


def test_whole_graph_as_one_query(spark):
    """A hub in parts, a node without a way on, one that nothing leads to, edges of no weight, repeated homes."""
    rng = random.Random(6)
    rows = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.randrange(5) / 4) for _ in range(40)] + [("n0", f"m{k}", 1.0) for k in range(9)] + [("lone", "n1", 0.5)]
    walk = spark.createDataFrame(sorted(set(rows)), "src string, dst string, weight double")
    homes = spark.createDataFrame([("n1", 1.0), ("n2", 0.5), ("n2", 0.25), ("n3", -1.0)], "node string, score double")
    ego = walk.select(F.lit(1).cast("long").alias("query_id"), F.col("src").alias("parent"), F.col("dst").alias("child"), "weight")
    want = {r.memory_id: r.ppr for r in G.personalized_pagerank(ego, homes.withColumn("query_id", F.lit(1).cast("long"))).collect()}
    got = {r.memory_id: r.ppr for r in G.pagerank(walk, homes, hot=3).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert G.pagerank(walk, homes.limit(0)).count() == 0


def walks(seeds, edges, levels):
    best = {}

    def go(q, node, value, left):
        for (a, b, kind) in edges:
            if kind == "CONTRADICTS":
                continue
            for x, y, k in ((a, b, 0), (b, a, 1)):
                if x == node:
                    v = value * {"IMPLIES": (0.9, 0.8), "BECAUSE": (0.95, 0.85)}.get(kind, (0.7, 0.6))[k]
                    if (q, y) not in seeds:
                        best[q, y] = max(best.get((q, y), 0), v)
                        if left > 1:
                            go(q, y, v, left - 1)

    for q, s in seeds:
        go(q, s, 1.0, levels)
    return {k: round(v, 9) for k, v in best.items()}


def test_spread_is_the_best_walk(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", rng.choice(["IMPLIES", "BECAUSE", "CONTRADICTS", "SUPPORTS"])) for _ in range(16)]
    seeds = {(1, "n0"), (1, "n1"), (2, "n5")}
    e, s = spark.createDataFrame(edges, "src string, dst string, edge_type string"), spark.createDataFrame(sorted(seeds), "query_id long, memory_id string")
    for levels in (1, 2, 3):
        got = {(r.query_id, r.memory_id): round(r.graph_part, 9) for r in G.spread(s, e, levels).collect()}
        assert got == walks(seeds, edges, levels)


def test_concept_search_has_what_edges_lead_to(spark):
    rows = registry.queries()["d17_onto_search"](spark, "/root/testdata/sf0.001").collect()
    assert rows and len({(r.query_id, r.memory_id) for r in rows}) == len(rows) and all(r.score >= 0.2 for r in rows)
