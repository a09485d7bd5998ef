"""Registered queries: graph operators. Searches start from the facts whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import graph as G
from factweave.plans.registry import query

_W = "CASE edge_type WHEN 'BECAUSE' THEN 1.0 WHEN 'IMPLIES' THEN 0.9 WHEN 'CONTRADICTS' THEN 0.4 ELSE 0.7 END"
_D = "CASE edge_type WHEN 'IMPLIES' THEN 0.9 WHEN 'BECAUSE' THEN 0.85 WHEN 'CONTRADICTS' THEN 0.8 ELSE 0.6 END"
_S = "least(greatest(coalesce(strength / 100.0, 1.0), 0), 1)"
_WALK = {
    "walk": f"SELECT src, dst, edge_type, {_W} * {_S} AS weight FROM edges UNION ALL SELECT dst, src, edge_type || '_IN', {_W} * {_D} * {_S} FROM edges",
    "seeds0": "SELECT doc_id AS query_id, memory_id AS node, 1.0::DOUBLE AS score FROM memories WHERE doc_id % 20 = 0",
}


def _starts(v):
    return v.memories.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("memory_id").alias("node"), F.lit(1.0).alias("score"))


def _ego(v, seeds):
    return G.expand_beam(seeds, G.walk_edges(v.edges), 2)[1]


@query("e1_walk_edges", "SELECT src, dst, edge_type, round(weight, 6) AS weight FROM walk", _WALK)
def e1(v):
    return G.walk_edges(v.edges).withColumn("weight", F.round("weight", 6))


@query("e2_neighbours", "SELECT query_id, node, dst, edge_type FROM seeds0 JOIN walk ON src = node", _WALK)
def e2(v):
    return G.neighbours(_starts(v).drop("score"), G.walk_edges(v.edges)).select("query_id", "node", "dst", "edge_type")


_BEAM = dict(_WALK)
for _k in (1, 2):
    _front, _seen = f"front{_k - 1}" if _k > 1 else "seeds0", f"seen{_k - 1}"
    if _k == 1:
        _BEAM["seen0"] = "SELECT query_id, node FROM seeds0"
    _BEAM[f"met{_k}"] = f"SELECT f.query_id, f.node, f.score, w.dst, w.edge_type, w.weight FROM {_front} f JOIN walk w ON w.src = f.node"
    _BEAM[f"rows{_k}"] = f"SELECT m.query_id, m.dst AS memory_id, m.node AS parent, m.edge_type AS edge, round(m.score * m.weight, 12) AS graph_score, {_k} AS depth FROM met{_k} m WHERE NOT EXISTS (SELECT 1 FROM {_seen} s WHERE s.query_id = m.query_id AND s.node = m.dst)"
    _BEAM[f"front{_k}"] = f"SELECT query_id, memory_id AS node, max(graph_score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, parent ORDER BY graph_score DESC, memory_id, edge) AS n FROM rows{_k}) WHERE n <= 3 GROUP BY ALL"
    _BEAM[f"seen{_k}"] = f"SELECT query_id, node FROM {_seen} UNION ALL SELECT query_id, node FROM front{_k}"


@query("e3_expand_beam", "SELECT query_id, memory_id, parent, edge, round(graph_score, 6) AS graph_score, depth FROM rows1 UNION ALL SELECT query_id, memory_id, parent, edge, round(graph_score, 6), depth FROM rows2", _BEAM)
def e3(v):
    return G.expand_beam(_starts(v), G.walk_edges(v.edges), 2)[0].withColumn("graph_score", F.round("graph_score", 6))


@query("e4_ego_edges", "SELECT DISTINCT query_id, node AS parent, dst AS child, edge_type FROM (SELECT query_id, node, dst, edge_type FROM met1 UNION ALL SELECT query_id, node, dst, edge_type FROM met2)", _BEAM)
def e4(v):
    return _ego(v, _starts(v)).drop("weight")


@query("e5_personalized_pagerank")
def e5(v):
    return G.net_pagerank(G.nets(_starts(v), G.walk_edges(v.edges), 2, 32)).withColumn("ppr", F.round("ppr", 6))


def _rounds(n: int, alpha: float = 0.6) -> dict[str, str]:
    """The walk of all edges and ``n`` rounds over it; every twentieth fact is a home."""
    out = _WALK | {
        "home": "SELECT memory_id AS a, 1.0 / count(*) OVER () AS r FROM memories WHERE doc_id % 20 = 0",
        "ways": "SELECT src AS a, dst AS b, weight / sum(weight) OVER (PARTITION BY src) AS w FROM walk WHERE weight > 0",
        "points": "SELECT a, coalesce(max(r), 0) AS r, a NOT IN (SELECT a FROM ways) AS ends FROM (SELECT a, r FROM home UNION ALL SELECT src, NULL FROM walk UNION ALL SELECT dst, NULL FROM walk) GROUP BY a",
        "p0": "SELECT a, r, ends, r AS p FROM points",
    }
    for k in range(n):
        out[f"p{k + 1}"] = f"SELECT x.a, x.r, x.ends, {1 - alpha} * x.r + {alpha} * (coalesce(c.c, 0) + (SELECT coalesce(sum(p), 0) FROM p{k} WHERE ends) * x.r) AS p FROM p{k} x LEFT JOIN (SELECT b AS a, sum(y.p * w) AS c FROM p{k} y JOIN ways USING (a) GROUP BY b) c ON c.a = x.a"
    return out


@query("e5_pagerank_of_all", "SELECT a AS memory_id, round(p / (SELECT max(p) FROM p4), 6) AS ppr FROM p4", _rounds(4))
def e5_all(v):
    """The whole graph, four rounds; the homes are every twentieth fact."""
    home = v.memories.where("doc_id % 20 = 0").select(F.col("memory_id").alias("node"), F.lit(1.0).alias("score"))
    return G.pagerank(G.walk_edges(v.edges), home, iterations=4, eps=0.0).withColumn("ppr", F.round("ppr", 6))


@query("e6_connect")
def e6(v):
    """Each start with the fact seven further."""
    seeds = v.memories.where("doc_id % 20 = 0").select(F.col("doc_id").alias("pair_id"), F.lit("a").alias("side"), F.col("memory_id").alias("node"))
    ends = v.memories.where("doc_id % 20 = 7").select((F.col("doc_id") - 7).alias("pair_id"), F.lit("b").alias("side"), F.col("memory_id").alias("node"))
    out = G.connect(seeds.unionByName(ends), G.walk_edges(v.edges), 7)
    return out.select("pair_id", F.array_join("path", ">").alias("path"), "hops", F.round("confidence", 6).alias("confidence"), "shared_seed")


@query("e7_category_bridge", "SELECT DISTINCT s.query_id, s.node, f.memory_id AS child FROM seeds0 s JOIN tags t ON t.memory_id = s.node JOIN (SELECT memory_id, category_id, row_number() OVER (PARTITION BY category_id ORDER BY memory_id) AS n FROM tags) f ON f.category_id = t.category_id AND f.n <= 25 WHERE f.memory_id <> s.node", _WALK)
def e7(v):
    return G.category_bridge(_starts(v), v.tags).select("query_id", "node", "child")


@query("e8_longest_chain")
def e8(v):
    out = G.longest_chain(G.nets(_starts(v), G.walk_edges(v.edges), 4, 256))
    return out.select("query_id", F.array_join("path", ">").alias("path"), "hops", F.round("confidence", 9).alias("confidence"))


@query("e9_reasoning_chain")
def e9(v):
    """Closeness is by vectors where a fact has one."""
    from factweave.functions.text import cosine

    q = v.vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).join(_starts(v).select("query_id"), "query_id", "left_semi")
    walk = G.walk_edges(v.edges)
    first, second = G.fronts(_starts(v), walk, 2)
    fronts = first.unionByName(second).select("query_id", "node")

    def near(pairs):
        """Of what a search has met in two levels."""
        met = pairs.join(fronts, "query_id").join(walk.select(F.col("src").alias("node"), F.col("dst").alias("memory_id")), ["node", "memory_id"], "left_semi").select("query_id", "memory_id").distinct()
        return met.join(q, "query_id").join(v.vectors.select("memory_id", "embedding"), "memory_id").select("query_id", "memory_id", F.round(cosine("q", "embedding"), 9).alias("cosine"))

    return G.reasoning_chain(_starts(v), walk, near, "causal", 3)


_RANKS = {"start": "SELECT q.doc_id AS query_id, m.memory_id, row_number() OVER (PARTITION BY q.doc_id ORDER BY m.doc_id) AS rank FROM memories q JOIN memories m ON m.doc_id >= q.doc_id AND m.doc_id < q.doc_id + 20 WHERE q.doc_id % 20 = 0"}


@query("e10_prefer_causal_seeds", "SELECT * FROM (SELECT query_id, memory_id, causal, row_number() OVER (PARTITION BY query_id ORDER BY causal DESC, rank) AS nth FROM (SELECT query_id, memory_id, rank, EXISTS (SELECT 1 FROM edges WHERE edge_type IN ('BECAUSE', 'IMPLIES') AND (src = memory_id OR dst = memory_id)) AS causal FROM start WHERE rank <= 12)) WHERE nth <= 4", _RANKS)
def e10(v):
    steps = v.memories.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    rows = steps.where(F.col("query_id") + F.col("k") < v.n).select("query_id", F.concat(F.lit("mem_"), F.col("query_id") + F.col("k")).alias("memory_id"), (F.col("k") + 1).alias("rank"))
    return G.prefer_causal_seeds(rows, v.edges, 4)


@query("e11_memory_chains")
def e11(v):
    return G.memory_chains(_starts(v).select("node"), v.edges, ("BECAUSE", "IMPLIES"), 3)


@query("e12_memory_graph")
def e12(v):
    return G.memory_graph(_starts(v).select("node"), v.edges, 2)[1]


@query("e13_graph_stats", """SELECT memory_id, (SELECT count(*) FROM entities e WHERE e.memory_id = m.memory_id) AS entities, (SELECT count(*) FROM tags e WHERE e.memory_id = m.memory_id) AS categories, (SELECT count(*) FROM edges e WHERE e.src = m.memory_id) AS out, (SELECT count(*) FROM edges e WHERE e.dst = m.memory_id) AS incoming FROM memories m""")
def e13(v):
    return G.graph_stats(v.memories, v.entities, v.tags, v.edges)


@query("e14_ancestors", """SELECT node, ancestor, min(distance) AS distance FROM (WITH RECURSIVE up AS (SELECT memory_id AS node, 'mem_' || (doc_id // 3) AS parent FROM memories WHERE doc_id > 0), r AS (SELECT node, parent AS ancestor, 1 AS distance FROM up UNION SELECT r.node, up.parent, r.distance + 1 FROM r JOIN up ON up.node = r.ancestor) SELECT * FROM r) GROUP BY node, ancestor""")
def e14(v):
    tree = v.memories.where("doc_id > 0").select(F.col("memory_id").alias("node"), F.concat(F.lit("mem_"), F.expr("doc_id div 3")).alias("parent_id"))
    return G.ancestors(tree)


@query("e15_resolve_aliases", """SELECT memory_id AS node, 'mem_' || (CASE WHEN doc_id % 10 IN (8, 9) THEN doc_id - doc_id % 10 + 8 ELSE doc_id - doc_id % 10 END) AS canonical FROM memories WHERE doc_id % 10 <> 0 AND doc_id - doc_id % 10 + 9 < (SELECT count(*) FROM documents)""")
def e15(v):
    """Chains of seven aliases, and a cycle of two in every ten."""
    d = F.col("doc_id")
    target = F.when(d % 10 == 9, d - 1).when(d % 10 == 8, d + 1).otherwise(d - 1)
    rows = v.memories.where((d % 10 != 0) & (d - d % 10 + 9 < v.n)).select(F.col("memory_id").alias("node"), F.concat(F.lit("mem_"), target).alias("target"))
    return G.resolve_aliases(rows)


@query("e16_communities")
def e16(v):
    return G.communities(v.edges.where("edge_type = 'BECAUSE'").select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query("e17_neighbour_sets", "SELECT src, dst FROM edges UNION SELECT dst, src FROM edges")
def e17(v):
    return G.neighbour_sets(v.edges)
