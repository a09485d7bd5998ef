"""Registered queries: search and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions.text import map_to_concepts, query_concepts, query_tags
from factweave.functions.times import event_time, freshness
from factweave.operators import counts as C, graph as G, rank as R
from factweave.plans.registry import query
from factweave.plans.texts import tokens_sql
from factweave.sources.views import AS_OF

_VEC = {"near": "SELECT query_id, memory_id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, memory_id) AS rank FROM (SELECT q.query_id, v.memory_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12) AS cosine FROM vector_queries q CROSS JOIN vectors v)"}
_BM = {
    "asked": f"SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({tokens_sql('text')}) AS token FROM queries) GROUP BY ALL",
    "said": f"SELECT memory_id, {tokens_sql('content')} AS tokens, len({tokens_sql('content')}) AS length FROM memories",
    "tf": "SELECT memory_id, length, token, count(*) AS tf FROM (SELECT memory_id, length, unnest(tokens) AS token FROM said) WHERE token IN (SELECT token FROM asked) GROUP BY ALL",
    "bm": "SELECT query_id, memory_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM (SELECT query_id, memory_id, round(least(sum(times * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / (SELECT avg(length) FROM said)))) / (SELECT sum(times) FROM asked x WHERE x.query_id = a.query_id), 1.0), 9) AS score FROM asked a JOIN tf USING (token) GROUP BY query_id, memory_id)",
    "bm_idf": "SELECT query_id, memory_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM (SELECT query_id, memory_id, round(sum(times * ln(1 + ((SELECT count(*) FROM said) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (SELECT avg(length) FROM said)))), 9) AS score FROM asked JOIN (SELECT token, count(*) AS df FROM tf GROUP BY token) USING (token) JOIN tf USING (token) GROUP BY query_id, memory_id)",
}


def _near(v, k):
    return R.vector_topk(v.vector_queries, v.vectors, k)


def _six(df, *columns):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.select(*columns).dtypes))


@query("d1_vector_topk", "SELECT query_id, memory_id, round(cosine, 6) AS cosine, rank FROM near WHERE rank <= 10", _VEC)
def d1(v):
    return _six(_near(v, 10), "query_id", "memory_id", "cosine", "rank")


@query("d2_bm25_topk", "SELECT query_id, memory_id, round(score, 6) AS score, rank FROM bm WHERE rank <= 10", _BM)
def d2(v):
    return _six(R.bm25_topk(v.queries, v.memories, 10), "query_id", "memory_id", "score", "rank")


@query("d3_bm25_idf_topk", "SELECT query_id, memory_id, round(score, 6) AS score, rank FROM bm_idf WHERE rank <= 10", _BM)
def d3(v):
    return _six(R.bm25_idf_topk(v.queries, v.memories, 10), "query_id", "memory_id", "score", "rank")


def _pair_lists(v):
    """Two lists for the same query ids: by keywords without and with document frequencies."""
    return R.bm25_both(v.queries, v.memories, 40)


@query("d4_hybrid_weighted", """SELECT query_id, memory_id, round(score, 6) AS score, rank FROM (SELECT query_id, memory_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM (SELECT query_id, memory_id, round(sum(part), 9) AS score FROM
    (SELECT query_id, memory_id, score * (0.6 / 0.9) AS part FROM bm WHERE rank <= 20 UNION ALL SELECT query_id, memory_id, score * (0.3 / 0.9) FROM bm_idf WHERE rank <= 20) GROUP BY ALL)) WHERE rank <= 10""", _BM)
def d4(v):
    one, two = _pair_lists(v)
    return _six(R.hybrid_weighted(one, two, 0.6, 0.3, 10), "query_id", "memory_id", "score", "rank")


_FUSED = _BM | {"fused": "SELECT query_id, memory_id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, memory_id) AS rank FROM (SELECT query_id, memory_id, round(sum(1.0 / (60 + rank)), 12) AS fused FROM (SELECT query_id, memory_id, rank FROM bm WHERE rank <= 40 UNION ALL SELECT query_id, memory_id, rank FROM bm_idf WHERE rank <= 40) GROUP BY ALL)"}


@query("d5_rrf", "SELECT query_id, memory_id, round(fused, 9) AS fused, rank FROM fused", _FUSED)
def d5(v):
    return R.rrf(_pair_lists(v)).select("query_id", "memory_id", F.round("fused", 9).alias("fused"), "rank")


_FRESH = f"coalesce(least(1.0, greatest(0.0, exp(-(epoch(TIMESTAMP '{AS_OF}') - epoch(moment)) / 86400.0 / 30.0))), 0.5)"
_SEEDS = _FUSED | {
    "accepted": "SELECT f.query_id, f.memory_id, t.content_key, t.moment, row_number() OVER (PARTITION BY f.query_id ORDER BY fused DESC, f.memory_id) AS accepted FROM fused f JOIN timed t USING (memory_id) WHERE (f.query_id % 2 = 1 OR t.user_id IN ('src' || (f.query_id % 20), '')) AND (moment IS NULL OR moment >= TIMESTAMP '2024-02-01')",
    "seeds": f"SELECT query_id, memory_id, content_key, moment, accepted, 0.95 * pow(0.92, accepted - 1) AS semantic, {_FRESH} AS fresh, round(least(1.0, 0.7 * 0.95 * pow(0.92, accepted - 1) + 0.3 * {_FRESH}), 9) AS score FROM accepted",
}


def _seeds(v, floor=0.0):
    user = F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("src"), F.col("query_id") % 20))
    return R.seed_phase(R.rrf(_pair_lists(v)).withColumn("user", user), v.memories, AS_OF, since="2024-02-01", floor=floor)


@query("d6_seed_phase", "SELECT query_id, memory_id, accepted, round(score, 6) AS score FROM seeds WHERE score >= 0.1", _SEEDS)
def d6(v):
    return _six(_seeds(v, 0.1), "query_id", "memory_id", "accepted", "score")


_RANKED = {"found": f"SELECT n.query_id, n.memory_id, content_key, user_id, moment, 0.95 * pow(0.92, rank - 1) AS semantic, {_FRESH} AS fresh, rank AS nth FROM near n JOIN timed USING (memory_id) WHERE rank <= 40"} | _VEC


def _found(v):
    """Vector seeds with rank score and freshness, as the phases behind the search take them."""
    rows = _near(v, 40).join(v.memories.select("memory_id", "content_key", "user_id", event_time().alias("at")), "memory_id")
    return rows.select("query_id", "memory_id", "content_key", "user_id", "at", (0.95 * F.pow(F.lit(0.92), F.col("rank") - 1)).alias("semantic"), freshness("at", 30.0, AS_OF).alias("fresh"), F.col("rank").alias("nth"))


_REAL = "(cosine + 1) / 2"


@query("d7_rerank_seeds", f"SELECT query_id, memory_id, round(least(1.0, 0.7 * CASE WHEN abs({_REAL} - semantic) > 0.01 THEN {_REAL} ELSE semantic END + 0.3 * fresh), 5) AS score FROM found JOIN near USING (query_id, memory_id)", _RANKED)
def d7(v):
    return R.rerank_seeds(_found(v), v.vector_queries, v.vectors).select("query_id", "memory_id", F.round("score", 5).alias("score"))


@query("d8_rerank_expansion", f"SELECT query_id, memory_id, round(CASE WHEN n <= 12 THEN {_REAL} ELSE 0.5 END, 5) AS semantic FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fresh DESC, memory_id) AS n FROM found) JOIN near USING (query_id, memory_id)", _RANKED)
def d8(v):
    out = R.rerank_expansion(_found(v).withColumn("score", F.col("fresh")), v.vector_queries, v.vectors, cap=12)
    return out.select("query_id", "memory_id", F.round("semantic", 5).alias("semantic"))


@query("d9_blend_ppr", "SELECT query_id, memory_id, round(round(least(greatest(0.3 * semantic + 0.5 * CASE WHEN nth % 2 = 0 THEN 1.0 / nth ELSE 0 END + 0.2 * fresh, 0), 1), 9), 6) AS score, round(semantic, 6) AS cosine FROM found", _RANKED)
def d9(v):
    rows = _found(v)
    ppr = rows.where("nth % 2 = 0").select("query_id", "memory_id", (1.0 / F.col("nth")).alias("ppr"))
    return _six(R.blend_ppr(rows, ppr), "query_id", "memory_id", "score", "cosine")


_FLAG = "coalesce((moment < TIMESTAMP '2024-03-01' OR moment > TIMESTAMP '2024-06-30 23:59:59.999') AND nth % 3 <> 0, false)"


def _flagged(v):
    rows = _found(v).withColumn("origin", F.when(F.col("nth") % 3 == 0, "seed").otherwise("graph")).withColumn("score", F.round(0.7 * F.col("semantic") + 0.3 * F.col("fresh"), 9))
    return R.flag_flashbacks(rows, "2024-03-01", "2024-06-30")


@query("d10_flag_flashbacks", f"SELECT query_id, memory_id, {_FLAG} AS flashback, CASE WHEN {_FLAG} THEN strftime(moment, '%Y-%m-%d') END AS flashback_at FROM found", _RANKED)
def d10(v):
    return _flagged(v).select("query_id", "memory_id", "flashback", "flashback_at")


_DEMOTED = _RANKED | {
    "scored": f"SELECT *, round(0.7 * semantic + 0.3 * fresh, 9) AS score, {_FLAG} AS flashback FROM found",
    "placed": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS n FROM scored",
    "demoted": "SELECT p.*, CASE WHEN n <= 24 AND s.src IS NOT NULL THEN round(score * 0.6, 9) ELSE score END AS new_score, CASE WHEN n <= 24 THEN s.src END AS superseded_by FROM placed p LEFT JOIN (SELECT dst, min(src) AS src FROM supersedes GROUP BY dst) s ON s.dst = p.memory_id",
}


@query("d11_demote_superseded", "SELECT query_id, memory_id, round(new_score, 6) AS score, superseded_by, row_number() OVER (PARTITION BY query_id ORDER BY new_score DESC, memory_id) AS rank FROM demoted", _DEMOTED)
def d11(v):
    return _six(R.demote_superseded(_flagged(v), v.supersedes, 8), "query_id", "memory_id", "score", "superseded_by", "rank")


@query("d12_clamp_with_flashbacks", "SELECT query_id, memory_id, flashback, row_number() OVER (PARTITION BY query_id ORDER BY flashback, n) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, flashback ORDER BY score DESC, memory_id) AS n FROM scored) WHERE n <= CASE WHEN flashback THEN 3 ELSE 10 END", {k: x for k, x in _DEMOTED.items() if k in ("scored", "found", "near")})
def d12(v):
    twice = _flagged(v)
    again = twice.withColumn("score", F.col("score") / 2)
    return R.clamp_with_flashbacks(twice.unionByName(again), 10, 3).select("query_id", "memory_id", "flashback", "rank")


_FAMILY = _DEMOTED | {
    "part_of": "SELECT 'mem_' || doc_id AS atom, 'mem_' || (doc_id - doc_id % 10) AS raw FROM memories WHERE doc_id % 10 <> 0",
    "both_of": "SELECT a.query_id, p.raw, p.atom, a.score AS atom_score, r.score AS raw_score FROM part_of p JOIN scored a ON a.memory_id = p.atom JOIN scored r ON r.memory_id = p.raw AND r.query_id = a.query_id",
    "verdict": "SELECT query_id, raw, max(atom_score) >= max(raw_score) AS atom_wins, arg_max(atom, (atom_score, atom)) AS atom FROM both_of GROUP BY ALL",
    "folded_rows": "SELECT query_id, raw AS memory_id, atom AS by_id FROM verdict WHERE atom_wins UNION ALL SELECT b.query_id, b.atom, b.raw FROM both_of b JOIN verdict w USING (query_id, raw) WHERE NOT atom_wins",
}


@query("d13_collapse_raw_families", "SELECT s.query_id, s.memory_id, coalesce((SELECT string_agg(DISTINCT f.memory_id, ',' ORDER BY f.memory_id) FROM folded_rows f WHERE f.query_id = s.query_id AND f.by_id = s.memory_id), '') AS folded FROM scored s WHERE NOT EXISTS (SELECT 1 FROM folded_rows f WHERE f.query_id = s.query_id AND f.memory_id = s.memory_id)", _FAMILY)
def d13(v):
    d = F.col("doc_id")
    part_of = v.memories.where(d % 10 != 0).select(F.col("memory_id").alias("atom"), F.concat(F.lit("mem_"), d - d % 10).alias("raw"))
    return R.collapse_raw_families(_flagged(v), part_of).select("query_id", "memory_id", "folded")


@query("d14_collapse_collective", "SELECT query_id, memory_id, CASE WHEN c > 1 THEN c END AS collapsed_holders FROM (SELECT *, count(*) OVER (PARTITION BY query_id, content_key) AS c, row_number() OVER (PARTITION BY query_id, content_key ORDER BY score DESC, memory_id) AS n FROM seeds) WHERE n = 1", _SEEDS)
def d14(v):
    return R.collapse_collective(_seeds(v)).select("query_id", "memory_id", "collapsed_holders")


@query("d15_collective_boost", "SELECT query_id, memory_id, user_count, round(boosted, 6) AS boosted, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, memory_id) AS rank FROM (SELECT s.query_id, s.memory_id, n AS user_count, round(score * (1 + (n - 1) * 0.1), 9) AS boosted FROM seeds s JOIN (SELECT content_key, count(DISTINCT user_id) AS n FROM memories GROUP BY content_key) USING (content_key))", _SEEDS)
def d15(v):
    return _six(R.collective_boost(_seeds(v), C.user_count(v.holders, v.memories)), "query_id", "memory_id", "user_count", "boosted", "rank")


@query("d18_overlaps")
def d18(v):
    """Concept and tag overlap of seeds with their queries."""
    asked = v.queries.select("query_id", query_concepts("text").alias("asked"), query_tags("text").alias("tags"))
    held = v.memories.select("memory_id", "content", F.transform(map_to_concepts("content", "memory_type"), lambda c: c["concept"]).alias("held"))
    rows = _seeds(v).select("query_id", "memory_id").join(asked, "query_id").join(held, "memory_id")
    return rows.select("query_id", "memory_id", F.round(R.concept_overlap(F.col("asked"), F.col("held")), 6).alias("concepts"), F.round(R.tag_overlap(F.col("tags"), F.col("content")), 6).alias("tags"))


_PASSED = _VEC | {
    "first": "SELECT query_id, memory_id FROM near WHERE rank <= 5",
    "passed0": "SELECT src, dst, CASE edge_type WHEN 'IMPLIES' THEN 0.9 WHEN 'BECAUSE' THEN 0.95 ELSE 0.7 END AS w FROM edges WHERE edge_type <> 'CONTRADICTS' UNION ALL SELECT dst, src, CASE edge_type WHEN 'IMPLIES' THEN 0.8 WHEN 'BECAUSE' THEN 0.85 ELSE 0.6 END FROM edges WHERE edge_type <> 'CONTRADICTS'",
    "once": "SELECT f.query_id, p.dst AS memory_id, max(CAST(w AS DOUBLE)) AS v FROM first f JOIN passed0 p ON p.src = f.memory_id WHERE NOT EXISTS (SELECT 1 FROM first s WHERE s.query_id = f.query_id AND s.memory_id = p.dst) GROUP BY ALL",
    "twice": "SELECT f.query_id, p.dst AS memory_id, max(f.v * p.w) AS v FROM once f JOIN passed0 p ON p.src = f.memory_id WHERE NOT EXISTS (SELECT 1 FROM first s WHERE s.query_id = f.query_id AND s.memory_id = p.dst) GROUP BY ALL",
}


@query("d17_graph_part", "SELECT query_id, memory_id, round(max(v), 6) AS graph_part FROM (SELECT * FROM once UNION ALL SELECT * FROM twice) GROUP BY ALL", _PASSED)
def d17_graph(v):
    """What the five nearest of each search lead to in two levels."""
    return _six(G.spread(_near(v, 5), v.edges), "query_id", "memory_id", "graph_part")


@query("d17_onto_search")
def d17(v):
    """The five-signal blend in contextual mode over the fused seeds and what their edges lead to; the latter have a vector part of one half."""
    asked = v.queries.select("query_id", query_concepts("text").alias("asked"), query_tags("text").alias("tags"))
    held = v.memories.select("memory_id", "content", F.transform(map_to_concepts("content", "memory_type"), lambda c: c["concept"]).alias("held"), freshness(event_time(), 30.0, AS_OF).alias("held_fresh"))
    seeds = _seeds(v).select("query_id", "memory_id", F.col("semantic").alias("vector_part"), F.lit(0.0).alias("graph_part"), F.col("fresh").alias("time_part"))
    led = G.spread(seeds, v.edges).select("query_id", "memory_id", F.lit(0.5).alias("vector_part"), "graph_part", F.lit(None).cast("double").alias("time_part"))
    rows = seeds.unionByName(led).join(asked, "query_id").join(held, "memory_id")
    parts = rows.select("query_id", "memory_id", "vector_part", R.concept_overlap(F.col("asked"), F.col("held"), 0.3).alias("concept_part"), R.tag_overlap(F.col("tags"), F.col("content")).alias("tag_part"), "graph_part", F.coalesce("time_part", "held_fresh").alias("time_part"))
    return _six(R.onto_blend(parts, (0.3, 0.4, 0.15, 0.05, 0.1), 0.2), "query_id", "memory_id", "score", "rank")


@query("d20_dedup_probe", "SELECT n.query_id, n.memory_id, round(cosine, 6) AS cosine FROM near n JOIN memories m ON m.memory_id = n.memory_id JOIN memories q ON q.memory_id = 'mem_' || n.query_id WHERE rank <= 10 AND m.user_id <> q.user_id", _VEC)
def d20(v):
    """Neighbours of other owners; the cut to ten comes first."""
    asker = v.memories.select(F.col("doc_id").alias("query_id"), F.col("user_id").alias("asker"))
    rows = _near(v, 10).join(v.memories.select("memory_id", "user_id"), "memory_id").join(asker, "query_id").where("user_id <> asker")
    return _six(rows, "query_id", "memory_id", "cosine")


@query("d23_eval_ranking", "SELECT query_id, min(rank) FILTER (hit) AS best, round(coalesce(1.0 / min(rank) FILTER (hit), 0), 6) AS reciprocal, coalesce(min(rank) FILTER (hit) <= 5, false) AS hit FROM (SELECT query_id, rank, memory_id IN ('mem_' || (query_id + 100), 'mem_' || query_id) AND rank <= 200 AND (query_id % 200 = 0 OR memory_id <> 'mem_' || query_id) AS hit FROM near) GROUP BY query_id", _VEC)
def d23(v):
    q = v.vector_queries.select("query_id")
    golden = q.select("query_id", F.concat(F.lit("mem_"), F.col("query_id") + 100).alias("memory_id")).unionByName(q.where("query_id % 200 = 0").select("query_id", F.concat(F.lit("mem_"), "query_id").alias("memory_id")))
    return _six(R.eval_ranking(_near(v, 200), golden), "query_id", "best", "reciprocal", "hit")


@query("recall_slice")
def recall_slice(v):
    """Seeds by keywords fused, filtered by period, best ten of each query, with their consensus; the flagship."""
    best = R.clamp_with_flashbacks(_seeds(v).withColumn("flashback", F.lit(False)), 10, 0)
    counted = R.collective_boost(R.collapse_collective(best), C.user_count(v.holders, v.memories))
    return _six(counted, "query_id", "memory_id", "score", "user_count", "boosted", "rank")
