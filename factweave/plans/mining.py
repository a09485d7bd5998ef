"""Registered queries: tags and mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions.storage import stored
from factweave.operators import graph as G, mine as M, rank as R
from factweave.plans.registry import query

_CATS = {
    "cat_vectors": "SELECT 'mem_' || vec_id AS memory_id, embedding FROM embeddings WHERE vec_id % 25 = 3",
    "near": "SELECT v.vec_id AS query_id, c.memory_id, round(list_cosine_similarity(v.embedding::DOUBLE[], c.embedding::DOUBLE[]), 12) AS cosine FROM vectors v CROSS JOIN cat_vectors c",
}


def _near(v, threshold, margin=2.0):
    """Every fact with a vector against one vector in twenty-five as the categories: all from the threshold on."""
    facts = v.vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    cats = v.vectors.where("vec_id % 25 = 3").select("memory_id", "embedding")
    return R.vector_within(facts, cats, threshold, margin)


@query("h1_auto_tag", """SELECT query_id, category_id, max(confidence) AS confidence FROM (SELECT query_id, memory_id AS category_id, CAST(round(100 * cosine) AS INTEGER) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, memory_id) AS n FROM near WHERE cosine >= 0.3) WHERE n <= 5
    UNION ALL SELECT query_id, 'root', 100 FROM near WHERE cosine >= 0.3) GROUP BY ALL""", _CATS)
def h1(v):
    tree = v.vectors.where("vec_id % 25 = 3").select(F.col("memory_id").alias("node"), F.lit("root").alias("parent_id"))
    return M.auto_tag(_near(v, 0.3), tree, threshold=0.3)


@query("h2_untagged", "SELECT memory_id FROM memories WHERE memory_id NOT IN (SELECT memory_id FROM tags WHERE category_id < 'Brand#4')")
def h2(v):
    return M.untagged(v.memories, v.tags.where("category_id < 'Brand#4'"))


@query("h3_grow_tags", "SELECT query_id, memory_id AS category_id, CAST(round(100 * cosine) AS INTEGER) AS confidence FROM (SELECT *, max(cosine) OVER (PARTITION BY query_id) AS best FROM near) WHERE cosine >= 0.25 AND cosine >= best - 0.07", _CATS)
def h3(v):
    return M.grow_tags(_near(v, 0.25, 0.07), 0.25)


@query("h4_mint_merge", "SELECT query_id, arg_max(memory_id, (cosine, memory_id)) AS category_id FROM near WHERE cosine >= 0.3 GROUP BY query_id", _CATS)
def h4(v):
    return M.mint_merge(_near(v, 0.3, 0.0), 0.3)


@query("h7_tag_stats", "SELECT count(*) AS scanned, count(n) AS matched, CAST(coalesce(sum(n), 0) AS BIGINT) AS given FROM memories LEFT JOIN (SELECT memory_id, count(*) AS n FROM tags GROUP BY memory_id) USING (memory_id)")
def h7(v):
    return M.tag_stats(v.memories, v.tags)


_PMI = {
    "sizes": "SELECT category_id, count(*) AS n FROM tags GROUP BY category_id",
    "pmi": "SELECT a.category_id AS a, b.category_id AS b, count(*) AS n_ab, round(ln(count(*) * CAST((SELECT count(DISTINCT memory_id) FROM tags) AS DOUBLE) / (any_value(x.n) * any_value(y.n))), 9) AS pmi FROM tags a JOIN tags b ON a.memory_id = b.memory_id AND a.category_id < b.category_id JOIN sizes x ON x.category_id = a.category_id JOIN sizes y ON y.category_id = b.category_id GROUP BY ALL",
}


def _pmi(v):
    return M.category_pmi(v.tagged)


def _bar(pmi):
    """The bar that the upper tenth of pairs passes; the tables' categories meet by chance only."""
    return pmi.agg(F.percentile("pmi", 0.9)).first()[0]


@query("i1_category_pmi", "SELECT a, b, n_ab, round(pmi, 6) AS pmi FROM pmi", _PMI)
def i1(v):
    return _pmi(v).withColumn("pmi", F.round("pmi", 6))


@query("i2_pmi_graph", "SELECT a, b, round(pmi, 6) AS pmi FROM pmi WHERE pmi >= -0.01 UNION ALL SELECT b, a, round(pmi, 6) FROM pmi WHERE pmi >= -0.01", _PMI)
def i2(v):
    return M.pmi_graph(_pmi(v), -0.01).withColumn("pmi", F.round("pmi", 6))


def _routes(v):
    pmi = _pmi(v)
    graph = stored(M.pmi_graph(pmi, _bar(pmi)))
    return M.route_subsets(graph, G.communities(graph), 5)


@query("i3_route_subsets")
def i3(v):
    return _routes(v).select("seed", F.array_join("path", " -> ").alias("path"), "hops", F.round("min_pmi", 6).alias("min_pmi"))


_CUT = _PMI | {
    "chains": "SELECT memory_id, list(category_id ORDER BY category_id)[:6] AS path FROM (SELECT DISTINCT memory_id, category_id FROM tags) GROUP BY memory_id",
    "places": "SELECT memory_id, path, i FROM (SELECT memory_id, path, unnest(range(2, len(path))) AS i FROM chains)",
    "bridges": "SELECT memory_id, min(i) AS i FROM places WHERE path[i - 1][7] <> path[i + 1][7] AND NOT EXISTS (SELECT 1 FROM pmi WHERE pmi >= 0.02 AND ((a = path[i - 1] AND b = path[i + 1]) OR (b = path[i - 1] AND a = path[i + 1]))) GROUP BY memory_id",
}


@query("i4_polysemy_cut", "SELECT c.memory_id, array_to_string(CASE WHEN b.i IS NULL THEN c.path ELSE c.path[1:b.i] END, ' -> ') AS path, CAST(b.i - 1 AS INTEGER) AS bridge FROM chains c LEFT JOIN bridges b USING (memory_id)", _CUT)
def i4(v):
    """The categories of each fact as a chain, over the net of those that meet more often than by chance; a maker's brands are a community."""
    graph = M.pmi_graph(_pmi(v), 0.02)
    chains = v.tags.select("memory_id", "category_id").distinct().groupBy("memory_id").agg(F.slice(F.sort_array(F.collect_list("category_id")), 1, 6).alias("path"))
    makers = v.tags.select(F.col("category_id").alias("node"), F.substring("category_id", 7, 1).alias("label")).distinct()
    done = M.polysemy_cut(chains.withColumn("pmis", F.array_repeat(F.lit(1.0), F.size("path") - 1)), graph, makers)
    return done.select("memory_id", F.array_join("path", " -> ").alias("path"), "bridge")


@query("i5_witnesses")
def i5(v):
    return M.witnesses(_routes(v), v.tagged, v.memories)


@query("i6_coherence_gate", """SELECT chain_id, round(exp(avg(ln(least(greatest(weight, 1e-9), 1.0)))), 6) AS strength, round(avg(CASE WHEN edge_type IN ('IMPLIES', 'BECAUSE', 'CONTRADICTS', 'SUPPORTS') THEN 1.0 ELSE 0 END), 6) AS share,
    CASE WHEN exp(avg(ln(least(greatest(weight, 1e-9), 1.0)))) >= 0.5 AND avg(CASE WHEN edge_type IN ('IMPLIES', 'BECAUSE', 'CONTRADICTS', 'SUPPORTS') THEN 1.0 ELSE 0 END) >= 0.5 THEN 'hypothesis' ELSE 'apophenia' END AS verdict FROM (SELECT src AS chain_id, edge_type, strength / 100.0 AS weight FROM edges) GROUP BY chain_id""")
def i6(v):
    out = M.coherence_gate(v.edges.select(F.col("src").alias("chain_id"), "edge_type", (F.col("strength") / 100.0).alias("weight")))
    return out.select("chain_id", F.round("strength", 6).alias("strength"), F.round("share", 6).alias("share"), "verdict")


_PATHS = {"paths": "SELECT DISTINCT ['c' || (doc_id % 7), 'c' || (doc_id % 7 + 1), 'c' || (doc_id % 7 + 1 + doc_id % 3)] AS path, 2 AS hops, 1.0 + (doc_id % 5) / 10.0 AS min_pmi FROM memories WHERE doc_id % 3 > 0 UNION ALL SELECT DISTINCT ['c' || (doc_id % 7), 'c' || (doc_id % 7 + 1)], 2, 1.05 FROM memories"}


def _paths(v):
    d = F.col("doc_id")
    c = lambda k: F.concat(F.lit("c"), k.cast("string"))
    three = v.memories.where(d % 3 > 0).select(F.array(c(d % 7), c(d % 7 + 1), c(d % 7 + 1 + d % 3)).alias("path"), F.lit(2).alias("hops"), (1.0 + (d % 5) / 10.0).alias("min_pmi")).distinct()
    two = v.memories.select(F.array(c(d % 7), c(d % 7 + 1)).alias("path"), F.lit(2).alias("hops"), F.lit(1.05).alias("min_pmi")).distinct()
    return three.unionByName(two)


@query("i7_curate", """SELECT text, round(value, 6) AS value FROM (SELECT DISTINCT ON (text) text, path, value FROM (SELECT array_to_string(path, ' -> ') AS text, path, hops * min_pmi AS value FROM paths) ORDER BY text, value DESC) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT ON (text) text, path, value FROM (SELECT array_to_string(path, ' -> ') AS text, path, hops * min_pmi AS value FROM paths) ORDER BY text, value DESC) b
    WHERE list_has_all(b.path, a.path) AND (round(b.value, 9) > round(a.value, 9) OR (round(b.value, 9) = round(a.value, 9) AND b.text < a.text)))""", _PATHS)
def i7(v):
    best = _paths(v).groupBy("path", "hops").agg(F.max("min_pmi").alias("min_pmi"))
    return M.curate(best).select("text", F.round("value", 6).alias("value"))


@query("i8_new_insights")
def i8(v):
    curated = M.curate(_routes(v), min_hops=1, min_pmi=-10.0)
    known = v.memories.where("doc_id % 20 = 0").select("content_key", F.lit("it may hold via the chain x -> y. Found by chance").alias("text"))
    return M.new_insights(curated, known)


_STITCH = {
    "recent": "SELECT user_id, memory_id FROM (SELECT user_id, memory_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, memory_id) AS n FROM memories) WHERE n <= 40",
    "meet": "SELECT x.user_id, x.memory_id AS a, y.memory_id AS b, count(*) AS shared FROM recent x JOIN entities e ON e.memory_id = x.memory_id JOIN entities f ON f.entity_id = e.entity_id JOIN recent y ON y.memory_id = f.memory_id AND y.user_id = x.user_id WHERE x.memory_id < y.memory_id GROUP BY ALL",
}


@query("i9_shared_entity_pairs", "SELECT user_id, a, b, shared, nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY shared DESC, a, b) AS nth FROM meet m WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE (e.src = m.a AND e.dst = m.b) OR (e.src = m.b AND e.dst = m.a))) WHERE nth <= 12", _STITCH)
def i9(v):
    return M.shared_entity_pairs(v.memories, v.entities, G.neighbour_sets(v.edges))


@query("i11_consolidate_candidates", "SELECT memory_id, other, shared, nth FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY shared DESC, other) AS nth FROM (SELECT e.memory_id, f.memory_id AS other, count(*) AS shared FROM entities e JOIN entities f ON f.entity_id = e.entity_id AND f.memory_id <> e.memory_id WHERE e.memory_id IN (SELECT memory_id FROM memories) AND f.memory_id IN (SELECT memory_id FROM memories) GROUP BY ALL)) WHERE nth <= 3")
def i11(v):
    return M.consolidate_candidates(v.memories, v.entities, 3)
