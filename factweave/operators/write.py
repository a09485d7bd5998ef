"""The write path: dedup, decisions, disputes and their upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factweave.functions.text import content_key, dispute_kind, edge_type, shares_subject
from factweave.operators.components import connected_components
from factweave.operators.rank import cosine_pairs
from factweave.schemas import PROTECTED_TYPES

# fixed values: gates of similarity, and strategies
SIMILAR, EXACT, CONFLICT = 0.70, 0.98, 0.88
DESTRUCTIVE = ("UPDATE", "SUPERSEDE", "DELETE")


def backfill_content_keys(memories: DataFrame) -> DataFrame:
    """G1: keys where there are none; raw inputs have a type of their own."""
    kind = F.when(F.col("memory_id").startswith("raw_"), "raw_input").otherwise(F.col("memory_type"))
    return memories.withColumn("content_key", F.coalesce(F.nullif(F.col("content_key"), F.lit("")), content_key("content", kind)))


def exact_dedup(new: DataFrame, memories: DataFrame, order: tuple[str, ...] = ("new_id",)) -> DataFrame:
    """``new`` with ``status``: known (same key, same owner), family (same key, another owner), repeat (again in the batch) or fresh.

    The first by ``order`` is no repeat. The owners of a key are never gathered.
    """
    nth = F.row_number().over(Window.partitionBy("content_key", "user_id").orderBy(*order))
    own = memories.select("content_key", "user_id", F.lit(True).alias("_own")).distinct()
    any_ = memories.select("content_key", F.lit(True).alias("_any")).distinct()
    both = new.withColumn("_n", nth).join(own, ["content_key", "user_id"], "left").join(any_, "content_key", "left")
    status = F.when(F.col("_own"), "known").when(F.col("_n") > 1, "repeat").when(F.col("_any"), "family").otherwise("fresh")
    return both.select(*new.columns, status.alias("status"))


def decision_gate(new: DataFrame, candidates: DataFrame) -> DataFrame:
    """``new_id, operation, confidence, target``; a null operation is undecided.

    In this order: no candidate, the same trimmed text, nothing similar, a protected type, an exact one.
    ``candidates`` has new_id, target, target_text, similarity. Of equal candidates the last id wins.
    """
    both = candidates.join(new.select("new_id", F.btrim("content").alias("_text")), "new_id")
    same = F.btrim("target_text") == F.col("_text")
    best = both.groupBy("new_id").agg(F.max(F.when(same, F.col("target"))).alias("same"), F.max(F.struct("similarity", "target")).alias("best"))
    df = new.join(best, "new_id", "left")
    top, protected = F.col("best.similarity"), F.lower("memory_type").isin(*PROTECTED_TYPES)
    cases = [(F.col("best").isNull(), "ADD", 100, None), (F.col("same").isNotNull(), "NOOP", 100, "same"), (top < SIMILAR, "ADD", 95, None), (protected, None, None, None), (top >= EXACT, "NOOP", 98, "best.target")]
    op, conf, target = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("string")
    for when, name, value, at in reversed(cases):
        op, conf = F.when(when, F.lit(name).cast("string")).otherwise(op), F.when(when, F.lit(value).cast("int")).otherwise(conf)
        target = F.when(when, F.col(at) if at else F.lit(None).cast("string")).otherwise(target)
    return df.select("new_id", op.alias("operation"), conf.alias("confidence"), target.alias("target"))


def validate_decision(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Confidence within 0..100; a target that is no candidate gives way to the best one; without candidates it is ADD."""
    best = candidates.groupBy("new_id").agg(F.max(F.struct("similarity", "target")).alias("b"), F.collect_set("target").alias("all"))
    df = decisions.join(best, "new_id", "left")
    needs = ~F.col("operation").isin("ADD")
    target = F.when(F.array_contains("all", F.col("target")), F.col("target")).otherwise(F.col("b.target"))
    op = F.when(needs & F.col("b").isNull(), "ADD").otherwise(F.col("operation"))
    return df.select("new_id", op.alias("operation"), F.least(F.greatest("confidence", F.lit(0)), F.lit(100)).alias("confidence"), F.when(op != "ADD", target).alias("target"))


def conflict_guard(decisions: DataFrame) -> DataFrame:
    """Contradictions, and rewrites that touch a protected type, need a common subject and a similarity of 0.88; else ADD.

    ``decisions`` has content, target_text, memory_type, target_type, similarity and operation.
    """
    protected = F.lower("memory_type").isin(*PROTECTED_TYPES) | F.lower("target_type").isin(*PROTECTED_TYPES)
    guarded = F.col("operation").isin("CONTRADICT", "CROSS_CONTRADICT") | (F.col("operation").isin("UPDATE", "SUPERSEDE") & protected)
    genuine = shares_subject("content", "target_text") & (F.col("similarity") >= CONFLICT)
    return decisions.withColumn("operation", F.when(guarded & ~genuine, "ADD").otherwise(F.col("operation")))


def escalate(decisions: DataFrame, low_confidence: int = 70) -> DataFrame:
    """``reason`` for surfacing a decision (null for none) and ``deferred`` for the destructive ones among them."""
    protected = F.lower("memory_type").isin(*PROTECTED_TYPES) | F.coalesce(F.lower("target_type").isin(*PROTECTED_TYPES), F.lit(False))
    op, rewrite = F.col("operation"), F.col("operation").isin("UPDATE", "SUPERSEDE")
    reason = F.when(op == "DELETE", "auto_delete").when(op == "CONTRADICT", "contradiction").when(op == "CROSS_CONTRADICT", "cross_user_contradiction").when(rewrite & protected, "protected_type_rewrite").when(rewrite & (F.col("confidence") < low_confidence), "low_confidence_rewrite")
    return decisions.withColumn("reason", reason).withColumn("deferred", F.col("reason").isNotNull() & op.isin(*DESTRUCTIVE))


def apply_decisions(decisions: DataFrame, memories: DataFrame, order: str = "new_id") -> dict[str, DataFrame]:
    """The rows that decisions make: facts (updates in place, new ones added), supersedes, contradicts and history.

    A deletion supersedes; a deferred decision adds its fact beside the old one with an open dispute. Of several
    updates of a fact the last by ``order`` (then new_id) holds. History has the ``new_id`` that each change came from.
    """
    op = F.when(F.col("deferred"), "DEFER").when(F.col("operation") == "DELETE", "SUPERSEDE").otherwise(F.col("operation"))
    d = decisions.withColumn("op", op)
    adds = d.where("op in ('ADD', 'SUPERSEDE', 'CONTRADICT', 'DEFER')").select(F.col("new_id").alias("memory_id"), "content", "user_id", "memory_type")
    update = d.where("op = 'UPDATE'").groupBy(F.col("target").alias("memory_id")).agg(F.max_by("content", F.struct(order, F.col("new_id").alias("_id"))).alias("new_content"))
    kept = memories.select("memory_id", "content", "user_id", "memory_type").join(update, "memory_id", "left")
    facts = kept.select("memory_id", F.coalesce("new_content", "content").alias("content"), "user_id", "memory_type").unionByName(adds)
    supersedes = d.where("op = 'SUPERSEDE'").select(F.col("new_id").alias("src"), F.col("target").alias("dst"))
    strategy = F.when(F.col("op") == "DEFER", "charter_deferred").otherwise(F.concat(F.lit("contradict_"), "memory_type"))
    contradicts = d.where("op in ('CONTRADICT', 'DEFER')").select(F.col("new_id").alias("src"), F.col("target").alias("dst"), F.lit(0).alias("resolved"), strategy.alias("strategy"))
    history = d.where("op <> 'NOOP'").select(F.when(F.col("op") == "UPDATE", F.col("target")).otherwise(F.col("new_id")).alias("memory_id"), F.when(F.col("op").isin("CONTRADICT", "DEFER"), "ADD").otherwise(F.col("op")).alias("action"), "new_id")
    return {"facts": facts, "supersedes": supersedes, "contradicts": contradicts, "history": history}


def route_pairs(pairs: DataFrame, verdicts: DataFrame, min_prob: float = 0.85) -> DataFrame:
    """``a, b, edge_type, strength`` by verdicts (a, b, label, probability): the forward one, the reverse where it is neutral.

    Entailment supports; contradiction needs a common subject (``subject`` of the pair); the rest is RESIDUAL.
    """
    fwd = verdicts.select("a", "b", F.col("label").alias("l1"), F.col("probability").alias("p1"))
    rev = verdicts.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("label").alias("l2"), F.col("probability").alias("p2"))
    both = pairs.join(fwd, ["a", "b"]).join(rev, ["a", "b"], "left")
    back = (F.col("l1") == "neutral") & F.col("l2").isNotNull()
    label, p = F.when(back, F.col("l2")).otherwise(F.col("l1")), F.when(back, F.col("p2")).otherwise(F.col("p1"))
    sure = p >= min_prob
    edge = F.when(sure & (label == "entail"), "SUPPORTS").when(sure & (label == "contradict") & F.col("subject"), "CONTRADICTS").otherwise("RESIDUAL")
    return both.select("a", "b", edge.alias("edge_type"), F.when(edge != "RESIDUAL", F.round(100 * p).cast("int")).alias("strength"))


def same_fact(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pairs with an entailment one way or the other, and no contradiction."""
    one = verdicts.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "label")
    ok = one.groupBy("a", "b").agg(F.bool_or(F.col("label") == "entail").alias("yes"), F.bool_or(F.col("label") == "contradict").alias("no"))
    return pairs.join(ok.where("yes and not no"), ["a", "b"], "left_semi")


def _keyed(memories: DataFrame) -> DataFrame:
    return memories.where(~F.col("memory_id").startswith("raw_") & (F.coalesce("content_key", F.lit("")) != ""))


def paraphrase_candidates(near: DataFrame, memories: DataFrame, least_cos: float = 0.82) -> DataFrame:
    """Ordered pairs of near facts of one owner domain with different keys, no raw rows. ``near`` is a self-search."""
    own = _keyed(memories)
    a = own.select(F.col("memory_id").alias("a"), F.col("content_key").alias("ka"), F.col("domain").alias("da"))
    b = own.select(F.col("memory_id").alias("b"), F.col("content_key").alias("kb"), F.col("domain").alias("db"))
    pairs = near.where(F.col("cosine") >= least_cos).select(F.least("from_id", "memory_id").alias("a"), F.greatest("from_id", "memory_id").alias("b"), "cosine").where("a <> b").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    return pairs.join(a, "a").join(b, "b").where("ka <> kb and da = db").select("a", "b", "cosine")


def paraphrases(vectors: DataFrame, memories: DataFrame, least_cos: float = 0.82) -> DataFrame:
    """G12 for all vectors against each other: keys and domains go with the vectors, so no pair is joined with its facts."""
    rows = vectors.select("memory_id", "embedding").join(_keyed(memories).select("memory_id", "content_key", "domain"), "memory_id")
    return cosine_pairs(rows, least_cos, same="domain", other="content_key")


def unify_keys(pairs: DataFrame, memories: DataFrame) -> DataFrame:
    """``memory_id, content_key, user_count`` after confirmed pairs of keys (a, b) moved to the least key of their component."""
    to = connected_components(pairs).select(F.col("node").alias("content_key"), F.col("component").alias("to"))
    moved = memories.join(to, "content_key", "left").select("memory_id", "user_id", F.coalesce("to", "content_key").alias("content_key"))
    n = moved.groupBy("content_key").agg(F.count_distinct("user_id").alias("user_count"))
    return moved.join(n, "content_key").select("memory_id", "content_key", "user_count")


def open_contradictions(contradicts: DataFrame, holders: DataFrame, user: str) -> DataFrame:
    """Unresolved outgoing disputes of a user's facts."""
    held = holders.where(F.col("user_id") == user).select(F.col("memory_id").alias("src")).distinct()
    return contradicts.where("resolved = 0").join(held, "src", "left_semi")


def superseded(supersedes: DataFrame) -> DataFrame:
    """Facts with a successor, and the first of these."""
    return supersedes.groupBy(F.col("dst").alias("memory_id")).agg(F.min("src").alias("superseded_by"))


def drain_disputes(contradicts: DataFrame, supersedes: DataFrame) -> DataFrame:
    """Open disputes with ``outcome``: a fact's disputes resolve only if all of them do, with the first one's label; else kept."""
    gone = supersedes.select("dst").distinct()
    a = gone.select(F.col("dst").alias("src"), F.lit(True).alias("src_gone"))
    b = gone.select("dst", F.lit(True).alias("dst_gone"))
    open_ = contradicts.where("resolved = 0").select("src", "dst", "strategy").distinct().join(a, "src", "left").join(b, "dst", "left")
    label = F.when(dispute_kind("strategy") == "preference", "coexist_preference").when(F.col("src_gone") | F.col("dst_gone"), "superseded_side")
    w = Window.partitionBy("src")
    df = open_.withColumn("label", label)
    every = F.bool_and(F.col("label").isNotNull()).over(w)
    first = F.min(F.struct("dst", "strategy", "label")).over(w)["label"]
    return df.withColumn("outcome", F.when(every, first).otherwise("kept")).select("src", "dst", "strategy", "outcome")


def dispute_notices(kept: DataFrame, holders: DataFrame, pending: DataFrame) -> DataFrame:
    """One notice for each owner of the target, unless it is pending."""
    who = kept.select("src", "dst").distinct().join(holders.select(F.col("memory_id").alias("dst"), "user_id").distinct(), "dst")
    return who.select(F.concat_ws("_", F.lit("cr"), "src", "dst", "user_id").alias("notice_id"), "user_id").join(pending, "notice_id", "left_anti")


def add_edges(new: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges that may be added: clamped strength, no self-loops, no BECAUSE or IMPLIES against one that is there or comes first.

    Duplicates are skipped; all relations other than BECAUSE, IMPLIES and CONTRADICTS share one place for two facts.
    """
    slot = F.when(F.col("edge_type").isin("BECAUSE", "IMPLIES", "CONTRADICTS"), F.col("edge_type")).otherwise("RELATION")
    own = new.where("src <> dst").withColumn("strength", F.least(F.greatest("strength", F.lit(0)), F.lit(100))).withColumn("slot", slot)
    have = edges.select("src", "dst", slot.alias("slot")).distinct()
    back = have.where("slot in ('BECAUSE', 'IMPLIES')").select(F.col("src").alias("dst"), F.col("dst").alias("src"), "slot")
    fresh = own.join(have, ["src", "dst", "slot"], "left_anti").join(back, ["src", "dst", "slot"], "left_anti")
    directed = F.col("slot").isin("BECAUSE", "IMPLIES")
    a, b = F.when(directed, F.least("src", "dst")).otherwise(F.col("src")), F.when(directed, F.greatest("src", "dst")).otherwise(F.col("dst"))
    w = Window.partitionBy(a, b, "slot").orderBy("nth")
    return fresh.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("src", "dst", "edge_type", "strength")


def resolve_disputes(verdicts: DataFrame, contradicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Disputes after verdicts (src, dst, verdict): all open ones of src resolve; a retraction supersedes dst."""
    said = verdicts.groupBy("src").agg(F.min("verdict").alias("verdict"))
    out = contradicts.join(said, "src", "left")
    done = (F.col("resolved") == 0) & F.col("verdict").isNotNull()
    after = out.select("src", "dst", F.when(done, F.concat(F.lit("owner_"), "verdict")).otherwise(F.col("strategy")).alias("strategy"), F.when(done, 1).otherwise(F.col("resolved")).alias("resolved"))
    return after, verdicts.where("verdict = 'retract'").select("src", "dst").distinct()


def link_entities(mentions: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``memory_id, entity_id, confidence`` by trimmed lower-case name, and the entities that are new."""
    norm = F.lower(F.btrim("name"))
    known = entities.groupBy(norm.alias("norm")).agg(F.min("entity_id").alias("entity_id"))
    said = mentions.select("memory_id", norm.alias("norm")).where("norm <> ''").distinct()
    new = said.select("norm").distinct().join(known, "norm", "left_anti").select(F.concat(F.lit("ent_"), F.substring(F.sha2("norm", 256), 1, 16)).alias("entity_id"), F.col("norm"))
    every = known.select("norm", F.col("entity_id").cast("string").alias("entity_id")).unionByName(new)
    return said.join(every, "norm").select("memory_id", "entity_id", F.lit(50).alias("confidence")), new.select("entity_id", F.col("norm").alias("name"))


def raw_source_rows(messages: DataFrame, atoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A raw row for each message of over 100 bytes with several atoms, and the atoms' PART_OF edges."""
    n = atoms.groupBy("message_id").agg(F.count("*").alias("n")).where("n > 1").select("message_id")
    own = messages.where(F.octet_length("text") > 100).join(n, "message_id", "left_semi")
    rows = own.select(F.concat(F.lit("raw_"), "message_id").alias("memory_id"), F.col("text").alias("content"), F.lit(70).alias("certainty"), F.lit(40).alias("importance"))
    part = atoms.join(own.select("message_id"), "message_id", "left_semi").select("atom_id", F.concat(F.lit("raw_"), "message_id").alias("raw_id"))
    return rows, part


def fork_updates(decisions: DataFrame, memory_groups: DataFrame, scope_groups: DataFrame) -> DataFrame:
    """An UPDATE becomes SUPERSEDE where the target's groups differ from the scope's of today (``scope``, ``group_id``)."""
    held = memory_groups.groupBy(F.col("memory_id").alias("target")).agg(F.array_sort(F.collect_set("group_id")).alias("held"))
    now = scope_groups.groupBy("scope").agg(F.array_sort(F.collect_set("group_id")).alias("now"))
    df = decisions.join(held, "target", "left").join(now, "scope", "left")
    differs = ~F.col("held").eqNullSafe(F.col("now"))
    return df.withColumn("operation", F.when((F.col("operation") == "UPDATE") & differs, "SUPERSEDE").otherwise(F.col("operation"))).drop("held", "now")


def cross_user_effects(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What verdicts on facts of other owners do: open disputes, and holder rows of those who dispute.

    ``verdicts`` has new_id, user_id, target, operation, conflict_type and confidence. Only CROSS_CONTRADICT changes
    anything: links and repeats are counted by the key that both owners' facts share.
    """
    clash = verdicts.where((F.col("operation") == "CROSS_CONTRADICT") & F.col("target").isNotNull())
    kind = F.coalesce(F.nullif("conflict_type", F.lit("")), F.lit("preference"))
    disputes = clash.select(F.col("new_id").alias("src"), F.col("target").alias("dst"), F.lit(0).alias("resolved"), F.concat(F.lit("cross_user_"), kind).alias("strategy"))
    return disputes, clash.select("user_id", F.col("target").alias("memory_id"), F.lit("disputes").alias("stance"), F.col("confidence").alias("certainty"))


def resolve_relations(extracted: DataFrame, stored: DataFrame) -> DataFrame:
    """``message_id, nth, src, dst, edge_type, strength``: proposed relations with both ends found among the message's stored facts.

    An end is found by its index, else by its whole text whatever the case (the last of equal ones), else where one
    text holds the other (the first by index). ``extracted`` has message_id, nth, from_index, from_text, to_index,
    to_text, edge_type, strength; ``stored`` has message_id, idx, memory_id, text. Texts meet inside a message only.
    """
    facts = stored.select("message_id", "idx", "memory_id", F.lower("text").alias("low"))
    side = lambda s: extracted.select("message_id", "nth", F.lit(s).alias("side"), F.col(f"{s}_index").alias("idx"), F.lower(F.coalesce(f"{s}_text", F.lit(""))).alias("low"))
    ends = side("from").unionByName(side("to"))
    by_index = ends.join(facts.select("message_id", "idx", F.col("memory_id").alias("one")), ["message_id", "idx"], "left")
    whole = facts.groupBy("message_id", "low").agg(F.max_by("memory_id", "idx").alias("two"))
    both = by_index.join(whole, ["message_id", "low"], "left").withColumn("two", F.when(F.col("low") != "", F.col("two")))
    left = both.where(F.col("one").isNull() & F.col("two").isNull() & (F.col("low") != ""))
    inside = left.select("message_id", "nth", "side", "low").join(facts.withColumnRenamed("low", "text"), "message_id").where(F.col("text").contains(F.col("low")) | F.col("low").contains(F.col("text")))
    three = inside.groupBy("message_id", "nth", "side").agg(F.min_by("memory_id", "idx").alias("three"))
    found = both.join(three, ["message_id", "nth", "side"], "left").select("message_id", "nth", "side", F.coalesce("one", "two", "three").alias("id"))
    pair = found.groupBy("message_id", "nth").agg(F.max(F.when(F.col("side") == "from", F.col("id"))).alias("src"), F.max(F.when(F.col("side") == "to", F.col("id"))).alias("dst"))
    rows = extracted.select("message_id", "nth", edge_type("edge_type").alias("edge_type"), "strength")
    return rows.join(pair.where("src is not null and dst is not null"), ["message_id", "nth"]).select("message_id", "nth", "src", "dst", "edge_type", "strength")


def entity_relations(extracted: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """``src, dst, relation, strength`` between entities: ends named in the same message, resolved by trimmed lower-case name.

    ``extracted`` has message_id, from_local, to_local, relation, strength; ``mentions`` has message_id, local_id, name.
    An end that the message does not name, or that no entity is called, drops the relation.
    """
    norm = F.lower(F.btrim("name"))
    known = entities.groupBy(norm.alias("norm")).agg(F.min("entity_id").alias("id"))
    named = mentions.select("message_id", "local_id", norm.alias("norm")).join(known, "norm").select("message_id", "local_id", "id").dropDuplicates(["message_id", "local_id"])
    a = named.select("message_id", F.col("local_id").alias("from_local"), F.col("id").alias("src"))
    b = named.select("message_id", F.col("local_id").alias("to_local"), F.col("id").alias("dst"))
    return extracted.join(a, ["message_id", "from_local"]).join(b, ["message_id", "to_local"]).select("src", "dst", "relation", "strength")


# fixed values: labels of generated facts, and who owns them
HYPOTHESIS, VERIFIED, SYSTEM = "HYPOTHESIS (generated, requires verification)", "VERIFIED (generated, confirmed by review)", "system"


def aging_hypotheses(memories: DataFrame, provenance: DataFrame, as_of: str, most: int | None = 3, min_hours: int = 48, retire_hours: int = 168) -> DataFrame:
    """The oldest unverified hypotheses, with up to six witnesses of 240 characters, and what is to be done: judge, retire or keep.

    Without a witness nothing can be judged: such a hypothesis retires once it is old enough. ``provenance`` has
    insight_id and witness_id; ``most`` is the feature's limit of a pass (None: all).
    """
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp("created_at"))
    old = memories.where((F.col("user_id") == SYSTEM) & F.col("content").startswith("HYPOTHESIS (generated")).withColumn("age", age).where(F.col("age") >= min_hours * 3600)
    if most is not None:
        old = old.orderBy("created_at", "memory_id").limit(most)
    texts = memories.where("content <> ''").select(F.col("memory_id").alias("witness_id"), F.substring("content", 1, 240).alias("said"))
    seen = provenance.join(old.select(F.col("memory_id").alias("insight_id")), "insight_id", "left_semi").join(texts, "witness_id")
    nth = F.row_number().over(Window.partitionBy("insight_id").orderBy("witness_id"))
    few = seen.withColumn("nth", nth).where("nth <= 6").groupBy(F.col("insight_id").alias("memory_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "said"))), lambda x: x["said"]).alias("witnesses"))
    out = old.join(few, "memory_id", "left")
    action = F.when(F.col("witnesses").isNotNull(), "judge").when(F.col("age") >= retire_hours * 3600, "retire").otherwise("keep")
    return out.select("memory_id", "content", "created_at", F.coalesce("witnesses", F.array().cast("array<string>")).alias("witnesses"), action.alias("action"))


def apply_review(aging: DataFrame, verdicts: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """``memory_id, outcome, content`` after review (memory_id, verdict, reason), and the notes of retired ones with what they supersede.

    Promoted: the label changes and the reason is added. Retired: the text stays, a note supersedes it. All else is kept.
    """
    both = aging.join(verdicts.select("memory_id", "verdict", "reason"), "memory_id", "left")
    outcome = F.when((F.col("action") == "judge") & (F.col("verdict") == "promote"), "promoted").when((F.col("action") == "judge") & (F.col("verdict") == "retire") | (F.col("action") == "retire"), "retired").otherwise("kept")
    day, reason = as_of[:10], F.when(F.col("action") == "retire", "unverifiable: no witness provenance").otherwise(F.substring(F.coalesce("reason", F.lit("")), 1, 140))
    done = both.withColumn("outcome", outcome)
    start = F.instr("content", HYPOTHESIS)
    relabelled = F.when(start > 0, F.concat(F.expr("substring(content, 1, instr(content, '" + HYPOTHESIS + "') - 1)"), F.lit(VERIFIED), F.expr(f"substring(content, instr(content, '{HYPOTHESIS}') + {len(HYPOTHESIS)})"))).otherwise(F.col("content"))
    content = F.when(F.col("outcome") == "promoted", F.concat(relabelled, F.lit(f" [verified {day}: "), reason, F.lit("]"))).otherwise(F.col("content"))
    summary = F.substring("content", len(HYPOTHESIS) + 3, 140)
    note = F.concat(F.lit(f"RETIRED hypothesis (failed verification {day}): "), summary, F.lit(" \u2014 "), reason)
    notes = done.where("outcome = 'retired'").select(F.concat(F.lit("note_"), "memory_id").alias("src"), F.col("memory_id").alias("dst"), note.alias("content"), F.lit(85).alias("certainty"), F.lit(40).alias("importance"))
    return done.select("memory_id", "outcome", content.alias("content")), notes
