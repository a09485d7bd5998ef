"""Registered queries: dedup, decisions and disputes."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions.text import content_key
from factweave.operators import write as W
from factweave.plans.registry import query



@query("g1_backfill_content_keys", "SELECT memory_id, CASE WHEN doc_id % 3 = 0 THEN 'kept' ELSE content_key END AS content_key FROM memories")
def g1(v):
    some = v.memories.withColumn("content_key", F.when(F.col("doc_id") % 3 == 0, "kept").otherwise(""))
    return W.backfill_content_keys(some).select("memory_id", "content_key")


_NEW = {"fresh_rows": "SELECT 'new_' || m.doc_id AS new_id, 'src' || (m.doc_id % 20) AS user_id, m.memory_type, m.content, CASE WHEN m.doc_id % 2 = 0 THEN m.content_key ELSE sha256(m.content_key) END AS content_key, m.doc_id FROM memories m"}


def _new(v):
    key = F.when(F.col("doc_id") % 2 == 0, F.col("content_key")).otherwise(F.sha2("content_key", 256))
    return v.memories.select(F.concat(F.lit("new_"), F.col("doc_id")).alias("new_id"), F.concat(F.lit("src"), F.col("doc_id") % 20).alias("user_id"), "memory_type", "content", key.alias("content_key"), "doc_id")


@query("g2_exact_dedup", """SELECT new_id, CASE WHEN EXISTS (SELECT 1 FROM old o WHERE o.content_key = f.content_key AND o.user_id = f.user_id) THEN 'known' WHEN row_number() OVER (PARTITION BY content_key, user_id ORDER BY new_id) > 1 THEN 'repeat'
    WHEN EXISTS (SELECT 1 FROM old o WHERE o.content_key = f.content_key) THEN 'family' ELSE 'fresh' END AS status FROM fresh_rows f""", _NEW | {"old": "SELECT * FROM memories WHERE doc_id % 3 = 0"})
def g2(v):
    return W.exact_dedup(_new(v), v.memories.where(F.col("doc_id") % 3 == 0)).select("new_id", "status")


_CAND = {"cand": """SELECT 'new_' || m.doc_id AS new_id, t.memory_id AS target, t.content AS target_text, t.memory_type AS target_type, CAST((m.doc_id * 7 + k * 13) % 101 AS DOUBLE) / 100 AS similarity FROM memories m CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) JOIN memories t ON t.doc_id = m.doc_id - m.doc_id % 4 + k WHERE m.doc_id % 5 <> 0"""}


def _cand(v):
    """Up to three stored facts with a made-up similarity for four new facts of five."""
    steps = v.memories.where(F.col("doc_id") % 5 != 0).select(F.concat(F.lit("new_"), F.col("doc_id")).alias("new_id"), "doc_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    rows = steps.select("new_id", (F.col("doc_id") - F.col("doc_id") % 4 + F.col("k")).alias("t"), (((F.col("doc_id") * 7 + F.col("k") * 13) % 101).cast("double") / 100).alias("similarity"))
    old = v.memories.select(F.col("doc_id").alias("t"), F.col("memory_id").alias("target"), F.col("content").alias("target_text"), F.col("memory_type").alias("target_type"))
    return rows.join(old, "t").drop("t")


_GATE = _CAND | _NEW | {
    "best": "SELECT new_id, max(similarity) AS top, arg_max(target, (similarity, target)) AS target FROM cand GROUP BY new_id",
    "same": "SELECT c.new_id, max(c.target) AS target FROM cand c JOIN fresh_rows f USING (new_id) WHERE trim(c.target_text) = trim(f.content) GROUP BY c.new_id",
    "gate": """SELECT f.new_id, CASE WHEN b.new_id IS NULL THEN 'ADD' WHEN s.target IS NOT NULL THEN 'NOOP' WHEN top < 0.7 THEN 'ADD' WHEN memory_type IN ('preference', 'goal', 'opinion') THEN NULL WHEN top >= 0.98 THEN 'NOOP' END AS operation,
        CASE WHEN b.new_id IS NULL THEN 100 WHEN s.target IS NOT NULL THEN 100 WHEN top < 0.7 THEN 95 WHEN memory_type IN ('preference', 'goal', 'opinion') THEN NULL WHEN top >= 0.98 THEN 98 END AS confidence,
        CASE WHEN b.new_id IS NULL THEN NULL WHEN s.target IS NOT NULL THEN s.target WHEN top < 0.7 THEN NULL WHEN memory_type IN ('preference', 'goal', 'opinion') THEN NULL WHEN top >= 0.98 THEN b.target END AS target FROM fresh_rows f LEFT JOIN best b USING (new_id) LEFT JOIN same s ON s.new_id = f.new_id""",
}


@query("g4_decision_gate", "SELECT * FROM gate", _GATE)
def g4(v):
    return W.decision_gate(_new(v), _cand(v))


_SAID = {"said": "SELECT new_id, doc_id, content, memory_type, (['ADD', 'UPDATE', 'SUPERSEDE', 'CONTRADICT', 'DELETE', 'NOOP'])[CAST(doc_id % 6 AS INTEGER) + 1] AS operation, doc_id * 11 % 131 - 10 AS confidence, 'mem_' || (doc_id - doc_id % 4 + 2) AS target FROM fresh_rows"}


def _said(v):
    op = F.get(F.array(*map(F.lit, ("ADD", "UPDATE", "SUPERSEDE", "CONTRADICT", "DELETE", "NOOP"))), (F.col("doc_id") % 6).cast("int"))
    return _new(v).select("new_id", "doc_id", "content", "memory_type", op.alias("operation"), (F.col("doc_id") * 11 % 131 - 10).alias("confidence"), F.concat(F.lit("mem_"), F.col("doc_id") - F.col("doc_id") % 4 + 2).alias("target"), "user_id")


@query("g5_validate_decision", "SELECT s.new_id, CASE WHEN operation <> 'ADD' AND b.new_id IS NULL THEN 'ADD' ELSE operation END AS operation, least(greatest(confidence, 0), 100) AS confidence, CASE WHEN operation <> 'ADD' AND b.new_id IS NOT NULL THEN CASE WHEN EXISTS (SELECT 1 FROM cand c WHERE c.new_id = s.new_id AND c.target = s.target) THEN s.target ELSE b.target END END AS target FROM said s LEFT JOIN best b USING (new_id)", _GATE | _SAID)
def g5(v):
    return W.validate_decision(_said(v).select("new_id", "operation", "confidence", "target"), _cand(v))


def _full(v):
    """Decisions with their target's text and type and the similarity."""
    return _said(v).join(_cand(v), ["new_id", "target"])


_FULL = _GATE | _SAID | {"whole": "SELECT s.*, c.target_text, c.target_type, c.similarity FROM said s JOIN cand c USING (new_id, target)"}
_SUBJ = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 4 AND NOT list_contains(['this', 'that', 'with', 'from', 'have', 'been', 'were', 'will', 'which', 'would', 'should', 'there'], w))"
_SHARES = f"(len({_SUBJ.format('content')}) = 0 OR list_has_any({_SUBJ.format('content')}, {_SUBJ.format('target_text')}))"
_PROT = "(memory_type IN ('preference', 'goal', 'opinion') OR target_type IN ('preference', 'goal', 'opinion'))"


@query("g6_conflict_guard", f"SELECT new_id, CASE WHEN (operation = 'CONTRADICT' OR (operation IN ('UPDATE', 'SUPERSEDE') AND {_PROT})) AND NOT ({_SHARES} AND similarity >= 0.88) THEN 'ADD' ELSE operation END AS operation FROM whole", _FULL)
def g6(v):
    return W.conflict_guard(_full(v)).select("new_id", "operation")


_REASON = f"CASE WHEN operation = 'DELETE' THEN 'auto_delete' WHEN operation = 'CONTRADICT' THEN 'contradiction' WHEN operation IN ('UPDATE', 'SUPERSEDE') AND {_PROT} THEN 'protected_type_rewrite' WHEN operation IN ('UPDATE', 'SUPERSEDE') AND confidence < 70 THEN 'low_confidence_rewrite' END"


@query("g7_escalate", f"SELECT new_id, {_REASON} AS reason, ({_REASON}) IS NOT NULL AND operation IN ('UPDATE', 'SUPERSEDE', 'DELETE') AS deferred FROM whole", _FULL)
def g7(v):
    return W.escalate(_full(v)).select("new_id", "reason", "deferred")


_DONE = _FULL | {
    "esc": f"SELECT *, ({_REASON}) IS NOT NULL AND operation IN ('UPDATE', 'SUPERSEDE', 'DELETE') AS deferred FROM whole",
    "acted": "SELECT *, CASE WHEN deferred THEN 'DEFER' WHEN operation = 'DELETE' THEN 'SUPERSEDE' ELSE operation END AS op FROM esc",
}


def _applied(v):
    return W.apply_decisions(W.escalate(_full(v)), v.memories)


@query("g8_apply_decisions", "SELECT new_id AS src, target AS dst, CASE WHEN op = 'DEFER' THEN 'charter_deferred' ELSE 'contradict_' || memory_type END AS strategy, 0 AS resolved FROM acted WHERE op IN ('DEFER', 'CONTRADICT')", _DONE)
def g8(v):
    """The disputes that decisions open."""
    return _applied(v)["contradicts"]


@query("g8_facts", "SELECT m.memory_id, coalesce(u.content, m.content) AS content, m.user_id, m.memory_type FROM memories m LEFT JOIN (SELECT target, arg_max(content, new_id) AS content FROM acted WHERE op = 'UPDATE' GROUP BY target) u ON u.target = m.memory_id UNION ALL SELECT a.new_id, a.content, f.user_id, a.memory_type FROM acted a JOIN fresh_rows f USING (new_id) WHERE op IN ('ADD', 'SUPERSEDE', 'CONTRADICT', 'DEFER')", _DONE)
def g8_facts(v):
    """All facts after the decisions: rewritten in place, and added."""
    return _applied(v)["facts"]


@query("g8_supersedes", "SELECT new_id AS src, target AS dst FROM acted WHERE op = 'SUPERSEDE'", _DONE)
def g8_supersedes(v):
    return _applied(v)["supersedes"]


@query("g8_history", "SELECT CASE WHEN op = 'UPDATE' THEN target ELSE new_id END AS memory_id, CASE WHEN op IN ('CONTRADICT', 'DEFER') THEN 'ADD' ELSE op END AS action FROM acted WHERE op <> 'NOOP'", _DONE)
def g8_history(v):
    return _applied(v)["history"].select("memory_id", "action")


_VERD = {"verd": "SELECT a, b, (['entail', 'contradict', 'neutral'])[CAST((a * 31 + b * 17) % 3 AS INTEGER) + 1] AS label, 0.5 + CAST((a + b) % 50 AS DOUBLE) / 100 AS probability FROM (SELECT doc_id AS a, doc_id + k AS b FROM memories CROSS JOIN (SELECT unnest([1, 7]) AS k) UNION ALL SELECT doc_id + k, doc_id FROM memories CROSS JOIN (SELECT unnest([1, 7]) AS k))"}


def _verdicts(v):
    fwd = v.memories.select(F.col("doc_id").alias("a"), F.explode(F.array(F.col("doc_id") + 1, F.col("doc_id") + 7)).alias("b"))
    both = fwd.unionByName(fwd.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = F.get(F.array(F.lit("entail"), F.lit("contradict"), F.lit("neutral")), ((F.col("a") * 31 + F.col("b") * 17) % 3).cast("int"))
    return both.select("a", "b", label.alias("label"), (0.5 + ((F.col("a") + F.col("b")) % 50).cast("double") / 100).alias("probability"))


@query("g10_route_pairs", """SELECT a, b, edge_type, CASE WHEN edge_type <> 'RESIDUAL' THEN CAST(round(100 * p) AS INTEGER) END AS strength FROM (SELECT a, b, p, CASE WHEN p >= 0.85 AND label = 'entail' THEN 'SUPPORTS' WHEN p >= 0.85 AND label = 'contradict' AND a % 2 = 0 THEN 'CONTRADICTS' ELSE 'RESIDUAL' END AS edge_type FROM
    (SELECT f.a, f.b, CASE WHEN f.label = 'neutral' THEN r.label ELSE f.label END AS label, CASE WHEN f.label = 'neutral' THEN r.probability ELSE f.probability END AS p FROM verd f JOIN verd r ON r.a = f.b AND r.b = f.a WHERE f.a < f.b))""", _VERD)
def g10(v):
    pairs = _verdicts(v).where("a < b").select("a", "b", (F.col("a") % 2 == 0).alias("subject"))
    return W.route_pairs(pairs, _verdicts(v))


@query("g11_same_fact", "SELECT least(a, b) AS a, greatest(a, b) AS b FROM verd GROUP BY ALL HAVING bool_or(label = 'entail') AND NOT bool_or(label = 'contradict')", _VERD)
def g11(v):
    return W.same_fact(_verdicts(v).where("a < b").select("a", "b"), _verdicts(v))


@query("g13_unify_keys", "SELECT memory_id, low AS content_key, n AS user_count FROM (SELECT memory_id, user_id, low, count(DISTINCT user_id) OVER (PARTITION BY low) AS n FROM (SELECT memory_id, user_id, CASE WHEN doc_id % 10 < 4 THEN min(k) FILTER (doc_id % 10 < 4) OVER (PARTITION BY doc_id // 10) ELSE k END AS low FROM (SELECT *, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS k FROM memories)))")
def g13(v):
    """Chains of four keys in every ten."""
    key = lambda k: F.lpad(k.cast("string"), 9, "0")
    pairs = v.memories.where((F.col("doc_id") % 10 < 3) & (F.col("doc_id") + 1 < v.n)).select(key(F.col("doc_id")).alias("a"), key(F.col("doc_id") + 1).alias("b"))
    return W.unify_keys(pairs, v.memories.withColumn("content_key", key(F.col("doc_id"))))


@query("g15_link_entities", "SELECT DISTINCT memory_id, CAST(doc_id % 97 AS VARCHAR) AS entity_id, 50 AS confidence FROM memories WHERE doc_id % 97 < 60")
def g15(v):
    mentions = v.memories.where(F.col("doc_id") % 97 < 60).select("memory_id", F.concat(F.lit("  Name "), F.col("doc_id") % 97, F.lit(" ")).alias("name"))
    known = v.memories.select((F.col("doc_id") % 97).alias("entity_id"), F.concat(F.lit("NAME "), F.col("doc_id") % 97).alias("name")).distinct()
    return W.link_entities(mentions, known)[0]


@query("g15_new_entities", "SELECT DISTINCT 'ent_' || left(sha256('name ' || (doc_id % 97)), 16) AS entity_id, 'name ' || (doc_id % 97) AS name FROM memories WHERE doc_id % 97 BETWEEN 30 AND 59")
def g15_new(v):
    """Half of the names are known; the rest become entities."""
    name = lambda form: F.concat(F.lit(form), F.col("doc_id") % 97)
    mentions = v.memories.where(F.col("doc_id") % 97 < 60).select("memory_id", F.concat(name("  Name "), F.lit(" ")).alias("name"))
    known = v.memories.where(F.col("doc_id") % 97 < 30).select((F.col("doc_id") % 97).alias("entity_id"), name("NAME ").alias("name")).distinct()
    return W.link_entities(mentions, known)[1]


@query("g17_open_contradictions", "SELECT src, dst, strategy FROM contradicts WHERE resolved = 0 AND src IN (SELECT memory_id FROM holders WHERE user_id = 'src2')")
def g17(v):
    return W.open_contradictions(v.contradicts, v.holders, "src2").select("src", "dst", "strategy")


_DRAIN = {"drain": """SELECT src, dst, strategy, CASE WHEN bool_and(label IS NOT NULL) OVER (PARTITION BY src) THEN first_value(label) OVER (PARTITION BY src ORDER BY dst, strategy) ELSE 'kept' END AS outcome FROM (SELECT DISTINCT src, dst, strategy, CASE WHEN strategy IN ('preference_clash', 'taste') THEN 'coexist_preference'
    WHEN src IN (SELECT dst FROM supersedes) OR dst IN (SELECT dst FROM supersedes) THEN 'superseded_side' END AS label FROM contradicts WHERE resolved = 0)"""}


@query("g18_drain_disputes", "SELECT * FROM drain", _DRAIN)
def g18(v):
    return W.drain_disputes(v.contradicts, v.supersedes)


@query("g19_dispute_notices", "SELECT DISTINCT 'cr_' || src || '_' || dst || '_' || user_id AS notice_id, user_id FROM drain JOIN holders ON memory_id = dst WHERE outcome = 'kept' AND user_id <> 'src1'", _DRAIN)
def g19(v):
    kept = W.drain_disputes(v.contradicts, v.supersedes).where("outcome = 'kept'")
    pending = W.dispute_notices(kept, v.holders.where("user_id = 'src1'"), v.spark.createDataFrame([], "notice_id string")).select("notice_id")
    return W.dispute_notices(kept, v.holders, pending)


@query("g20_superseded", "SELECT dst AS memory_id, min(src) AS superseded_by FROM supersedes GROUP BY dst")
def g20(v):
    return W.superseded(v.supersedes)


@query("g23_add_edges", """SELECT src, dst, edge_type, strength FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN d THEN least(src, dst) ELSE src END, CASE WHEN d THEN greatest(src, dst) ELSE dst END, slot ORDER BY nth) AS n FROM prop p WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM have h WHERE h.src = p.src AND h.dst = p.dst AND h.slot = p.slot) AND NOT (d AND EXISTS (SELECT 1 FROM have h WHERE h.src = p.dst AND h.dst = p.src AND h.slot = p.slot))) WHERE n = 1""", {
    "prop0": "SELECT doc_id AS nth, 'mem_' || doc_id AS src, 'mem_' || ((doc_id * 7 + 3 + doc_id % 3) % (SELECT count(*) FROM documents)) AS dst, (['BECAUSE', 'SUPPORTS', 'IMPLIES', 'RELATES_TO'])[CAST(doc_id % 4 AS INTEGER) + 1] AS edge_type, least(greatest(doc_id % 140 - 20, 0), 100) AS strength FROM documents UNION ALL SELECT 1000000 + doc_id, 'mem_' || ((doc_id * 7 + 3 + doc_id % 3) % (SELECT count(*) FROM documents)), 'mem_' || doc_id, 'BECAUSE', 10 FROM documents WHERE doc_id % 4 = 0",
    "prop": "SELECT *, CASE WHEN edge_type IN ('BECAUSE', 'IMPLIES', 'CONTRADICTS') THEN edge_type ELSE 'RELATION' END AS slot, edge_type IN ('BECAUSE', 'IMPLIES') AS d FROM prop0",
    "have": "SELECT src, dst, CASE WHEN edge_type IN ('BECAUSE', 'IMPLIES', 'CONTRADICTS') THEN edge_type ELSE 'RELATION' END AS slot FROM edges"})
def g23(v):
    m = lambda k: F.concat(F.lit("mem_"), k.cast("string"))
    to = (F.col("doc_id") * 7 + 3 + F.col("doc_id") % 3) % v.n
    kind = F.get(F.array(*map(F.lit, ("BECAUSE", "SUPPORTS", "IMPLIES", "RELATES_TO"))), (F.col("doc_id") % 4).cast("int"))
    docs = v.memories
    one = docs.select(F.col("doc_id").alias("nth"), m(F.col("doc_id")).alias("src"), m(to).alias("dst"), kind.alias("edge_type"), (F.col("doc_id") % 140 - 20).alias("strength"))
    two = docs.where(F.col("doc_id") % 4 == 0).select((1_000_000 + F.col("doc_id")).alias("nth"), m(to).alias("src"), m(F.col("doc_id")).alias("dst"), F.lit("BECAUSE").alias("edge_type"), F.lit(10).cast("long").alias("strength"))
    return W.add_edges(one.unionByName(two), v.edges)


_OWNER = {"said": "SELECT src, min(verdict) AS verdict FROM (SELECT src, CASE CAST(substr(src, 5) AS BIGINT) % 3 WHEN 0 THEN 'retract' ELSE 'keep_both' END AS verdict FROM contradicts WHERE resolved = 0 AND CAST(substr(src, 5) AS BIGINT) % 3 < 2) GROUP BY src"}


def _resolved(v):
    """Owners retract every third of their disputed facts, keep both of the next, and say nothing of the last."""
    k = F.substring("src", 5, 20).cast("long") % 3
    said = v.contradicts.where((F.col("resolved") == 0) & (k < 2)).select("src", "dst", F.when(k == 0, "retract").otherwise("keep_both").alias("verdict"))
    return W.resolve_disputes(said, v.contradicts)


@query("g24_resolve_disputes", "SELECT c.src, c.dst, CASE WHEN c.resolved = 0 AND s.verdict IS NOT NULL THEN 'owner_' || s.verdict ELSE c.strategy END AS strategy, CASE WHEN s.verdict IS NOT NULL THEN 1 ELSE c.resolved END AS resolved FROM contradicts c LEFT JOIN said s ON s.src = c.src", _OWNER)
def g24(v):
    return _resolved(v)[0]


@query("g24_retractions", "SELECT DISTINCT src, dst FROM contradicts WHERE resolved = 0 AND CAST(substr(src, 5) AS BIGINT) % 3 = 0")
def g24_retractions(v):
    """What a retraction supersedes."""
    return _resolved(v)[1]


@query("g26_fork_updates", "SELECT memory_id AS target, CASE WHEN (SELECT string_agg(h.group_id, ',' ORDER BY h.group_id) FROM groups h WHERE h.dedup_group_id = g.dedup_group_id) IS NOT DISTINCT FROM m.group_id THEN 'UPDATE' ELSE 'SUPERSEDE' END AS operation FROM memory_groups m JOIN groups g ON g.group_id = m.group_id WHERE g.dedup_group_id IS NOT NULL")
def g26(v):
    scoped = v.groups.where("dedup_group_id is not null").select(F.col("dedup_group_id").alias("scope"), "group_id")
    decisions = v.memory_groups.join(scoped, "group_id").select(F.col("memory_id").alias("target"), "scope", F.lit("UPDATE").alias("operation"))
    return W.fork_updates(decisions, v.memory_groups.select("memory_id", "group_id"), scoped).select("target", "operation")
