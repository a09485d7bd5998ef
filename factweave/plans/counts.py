"""Registered queries: aggregations, counts and table loading."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions.text import precedent_shape
from factweave.operators import counts as O
from factweave.operators.access import active_bindings
from factweave.plans.registry import query
from factweave.sources import tables as S


@query("a2_load_edges", """SELECT src, dst, edge_type, max(strength) AS strength FROM (SELECT src, dst, edge_type, strength FROM edges UNION ALL SELECT src, dst, 'SUPERSEDES', NULL FROM supersedes UNION ALL SELECT src, dst, 'CONTRADICTS', NULL FROM contradicts)
    WHERE src IN (SELECT memory_id FROM memories) AND dst IN (SELECT memory_id FROM memories) GROUP BY ALL""")
def a2(v):
    said = v.edges.withColumn("relation_type", F.lower(F.replace("edge_type", F.lit("_"), F.lit(" "))))
    return S.one_edge_table({"MEMORY_RELATION": said, "SUPERSEDES": v.supersedes, "CONTRADICTS": v.contradicts.select("src", "dst")}, v.memories)


@query("a8_census", "SELECT 'node' AS kind, 'Memory' AS name, (SELECT count(*) FROM memories) AS n, 'active' AS lifecycle UNION ALL SELECT 'vector', 'MemoryEmbedding', (SELECT count(*) FROM vectors), 'active' UNION ALL SELECT 'edge', 'RELATION', (SELECT count(*) FROM edges), 'active' UNION ALL SELECT 'edge', 'SUPERSEDES', (SELECT count(*) FROM supersedes), 'active'")
def a8(v):
    return S.census([("node", "Memory", v.memories, "active"), ("vector", "MemoryEmbedding", v.vectors, "active"), ("edge", "RELATION", v.edges, "active"), ("edge", "SUPERSEDES", v.supersedes, "active")])


@query("f1_user_count", "SELECT memory_id, greatest(coalesce(n, 0), 1) AS user_count FROM memories LEFT JOIN (SELECT content_key, count(DISTINCT h.user_id) AS n FROM holders h JOIN memories m ON m.memory_id = h.memory_id GROUP BY content_key) USING (content_key)")
def f1(v):
    return O.user_count(v.holders, v.memories)


@query("f2_stances", "SELECT memory_id, CASE WHEN stance = '' THEN 'knows' ELSE stance END AS stance, count(*) AS n FROM holders GROUP BY ALL")
def f2(v):
    return O.stances(v.holders)


@query("f3_controversy", """SELECT memory_id, against, against_user FROM (SELECT m.memory_id, against, o.user_id AS against_user, row_number() OVER (PARTITION BY m.memory_id ORDER BY way, against) AS n FROM memories m JOIN
    (SELECT src AS memory_id, dst AS against, 0 AS way FROM contradicts UNION ALL SELECT dst, src, 1 FROM contradicts) c ON c.memory_id = m.memory_id JOIN memories o ON o.memory_id = c.against WHERE o.user_id <> m.user_id) WHERE n = 1""")
def f3(v):
    return O.controversy(v.memories, v.contradicts, v.memories)


@query("f4_overview", "SELECT (SELECT count(*) FROM memories) AS memories, (SELECT count(DISTINCT user_id) FROM memories) AS users, (SELECT count(DISTINCT content_key) FROM memories) AS families, (SELECT count(*) FROM memories WHERE certainty >= 50) AS firm, (SELECT count(DISTINCT entity_id) FROM entities) AS entities, (SELECT count(*) FROM categories) AS categories, (SELECT count(*) FROM groups) AS groups")
def f4(v):
    return O.overview(v.memories, v.entities, v.categories, v.groups)


@query("f5_top_contributors", "SELECT user_id, count(*) AS n FROM memories GROUP BY user_id ORDER BY n DESC, user_id LIMIT 8")
def f5(v):
    return O.top_contributors(v.memories)


@query("f6_access_projection", "SELECT g.group_id, g.dedup_group_id, count(DISTINCT subject) AS members, count(DISTINCT subject) FILTER (role IN ('groupadmin', 'moderator')) AS leaders, coalesce(string_agg(DISTINCT role, ',' ORDER BY role), '') AS roles FROM groups g LEFT JOIN bindings b ON b.group_id = g.group_id GROUP BY ALL")
def f6(v):
    return O.access_projection(active_bindings(v.assignments), v.groups)


_ALLOWED = {"allowed": "SELECT memory_id FROM memories WHERE certainty >= 20"}


@query("f7_relation_totals", "SELECT edge_type, count(*) AS n FROM edges WHERE src IN (SELECT memory_id FROM allowed) AND dst IN (SELECT memory_id FROM allowed) GROUP BY edge_type", _ALLOWED)
def f7(v):
    return O.relation_totals(v.edges, v.memories.where("certainty >= 20"))


_INSIDE = {"inside": "SELECT t.* FROM tags t JOIN memories m USING (memory_id)"}


@query("f8_category_counts", """SELECT category_id, sum(members) AS members, sum(children) AS children FROM (SELECT category_id, count(*) AS members, 0 AS children FROM inside GROUP BY category_id
    UNION ALL SELECT parent_id, 0, count(DISTINCT category_id) FROM categories WHERE category_id IN (SELECT category_id FROM inside) GROUP BY parent_id) GROUP BY category_id
    UNION ALL SELECT 'uncategorized', count(*), 0 FROM memories WHERE memory_id NOT IN (SELECT memory_id FROM tags) HAVING count(*) > 0""", _INSIDE)
def f8(v):
    return O.category_counts(v.memories, v.tags, v.categories)


@query("f9_category_edges", "SELECT a.category_id AS src_category, b.category_id AS dst_category, edge_type, count(*) AS n FROM edges JOIN tags a ON a.memory_id = src JOIN tags b ON b.memory_id = dst GROUP BY ALL")
def f9(v):
    return O.category_edges(v.edges, v.tags, v.categories)


@query("f10_category_page", "SELECT category_id, n, nth FROM (SELECT category_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, category_id) AS nth FROM tags GROUP BY category_id) WHERE nth BETWEEN 13 AND 24")
def f10(v):
    return O.page(v.tags.groupBy("category_id").agg(F.count("*").alias("n")), [F.desc("n"), F.asc("category_id")], 2, 12)


@query("f10_memory_page_edges", "SELECT src, dst, edge_type FROM edges WHERE src IN (SELECT memory_id FROM p) AND dst IN (SELECT memory_id FROM p)", {"p": "SELECT memory_id FROM memories ORDER BY created_at DESC, memory_id LIMIT 240"})
def f10_edges(v):
    return O.memory_page(v.memories, v.edges, 1, 240)[1].select("src", "dst", "edge_type")


_SHAPES = {"shapes": "SELECT coalesce(nullif(a.memory_type, ''), 'unknown') || '-' || b.memory_type || '-' || strategy AS shape FROM contradicts JOIN memories a ON a.memory_id = src JOIN memories b ON b.memory_id = dst WHERE resolved = 1"}


def _shapes(v):
    a = v.memories.select(F.col("memory_id").alias("src"), F.col("memory_type").alias("ta"))
    b = v.memories.select(F.col("memory_id").alias("dst"), F.col("memory_type").alias("tb"))
    return v.contradicts.where("resolved = 1").join(a, "src").join(b, "dst").select(precedent_shape("ta", "tb", "strategy").alias("shape"))


@query("f11_precedent_counts", "SELECT shape, count(*) AS n FROM shapes GROUP BY shape", _SHAPES)
def f11(v):
    return O.precedent_counts(_shapes(v))


@query("f12_rule_proposals", "SELECT shape, count(*) AS n FROM shapes WHERE shape NOT LIKE 'goal-%' GROUP BY shape HAVING count(*) >= 3", _SHAPES)
def f12(v):
    counts = O.precedent_counts(_shapes(v))
    return O.rule_proposals(counts, counts.where(F.col("shape").startswith("goal-")).select("shape"))


_INSIGHTS = {"insight": "SELECT 'ins_' || doc_id AS insight_id, doc_id FROM memories WHERE doc_id % 3 = 0", "provenance": "SELECT 'ins_' || doc_id AS insight_id, 'mem_' || (doc_id * 3 + k) AS memory_id FROM memories, (SELECT unnest([0, 1, 2]) AS k) WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0"}


@query("f13_insight_health", """SELECT i.insight_id, count(DISTINCT p.memory_id) AS witnesses, count(p.memory_id) = 0 AS orphan, coalesce(string_agg(DISTINCT g.group_id, ',' ORDER BY g.group_id) FILTER (g.group_id <> 'g3'), '') AS groups
    FROM insight i LEFT JOIN provenance p USING (insight_id) LEFT JOIN memory_groups g ON g.memory_id = p.memory_id GROUP BY i.insight_id""", _INSIGHTS)
def f13(v):
    d = F.col("doc_id")
    ins = v.memories.where(d % 3 == 0).select(F.concat(F.lit("ins_"), d).alias("insight_id"), "doc_id")
    seen = ins.where(d % 5 != 0).select("insight_id", F.explode(F.array(*(F.concat(F.lit("mem_"), d * 3 + k) for k in range(3)))).alias("memory_id"))
    return O.insight_health(ins, seen, v.memory_groups.select("memory_id", "group_id"), "g3")


@query("f14_latency_summary", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def f14(v):
    out = O.latency_summary(v.table("events"), "event_type", "value")
    return out.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p95")))


_DEBT = {"debt": "SELECT user_id, CASE WHEN strategy IN ('preference_clash', 'taste') THEN 'preference' ELSE 'factual' END AS kind FROM contradicts JOIN memories ON memory_id = src WHERE resolved = 0"}


@query("f15_open_debt", "SELECT user_id, kind, grouping(user_id, kind) AS level, count(*) AS n FROM debt GROUP BY CUBE (user_id, kind)", _DEBT)
def f15(v):
    return O.open_debt(v.contradicts, v.memories)


@query("f16_key_family_size", "SELECT content_key, count(*) AS n FROM memories GROUP BY content_key")
def f16(v):
    return O.key_family_size(v.memories)
