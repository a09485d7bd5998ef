"""Registered queries: times, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions.text import sanitize_unit
from factweave.functions.times import event_time, freshness, in_window, last_days
from factweave.operators import filters as O
from factweave.plans.registry import query
from factweave.sources.views import AS_OF

_STAMP = "yyyy-MM-dd HH:mm:ss"


@query("b1_event_time", "SELECT memory_id, strftime(moment, '%Y-%m-%d %H:%M:%S') AS event_time FROM timed")
def b1(v):
    return v.memories.select("memory_id", F.date_format(event_time(), _STAMP).alias("event_time"))


@query("b3_in_window", "SELECT memory_id FROM timed WHERE moment IS NULL OR (moment >= TIMESTAMP '2024-03-01' AND moment <= TIMESTAMP '2024-06-30 23:59:59.999')")
def b3(v):
    return in_window(v.memories, "2024-03-01", "2024-06-30").select("memory_id")


@query("b4_last_days", "SELECT memory_id FROM timed WHERE moment IS NULL OR moment >= TIMESTAMP '2024-12-01 00:00:00'")
def b4(v):
    return last_days(v.memories, 30, AS_OF).select("memory_id")


@query("b5_owner_scope", "SELECT memory_id, user_id FROM memories WHERE user_id = 'src3' OR user_id = ''")
def b5(v):
    return O.owner_scope(v.memories, "src3").select("memory_id", "user_id")


@query("b6_by_tag", "SELECT memory_id FROM memories WHERE context_tags = 'Work' ORDER BY memory_id LIMIT 50")
def b6(v):
    return O.by_tag(v.memories, "Work", 50).select("memory_id")


_NAMES = "CASE WHEN context_tags LIKE '{%' THEN list_transform(json_keys(context_tags), lambda x: lower(x)) WHEN context_tags = '' THEN [] ELSE [lower(context_tags)] END"


@query("b7_filter_by_context", f"SELECT memory_id FROM memories WHERE list_has_any({_NAMES}, ['work', 'fr'])")
def b7(v):
    return O.filter_by_context(v.memories, ["WORK", "fr"], False).select("memory_id")


@query("b7_filter_by_context_all", f"SELECT memory_id FROM memories WHERE list_has_all({_NAMES}, ['work', 'lang:en'])")
def b7_all(v):
    return O.filter_by_context(v.memories, ["work", "Lang:en"], True).select("memory_id")


@query("b8_context_relevance", f"SELECT memory_id, CASE WHEN len({_NAMES}) = 0 THEN 0.5 ELSE len(list_intersect({_NAMES}, ['work', 'en'])) / 2.0 END::DOUBLE AS relevance FROM memories")
def b8(v):
    return O.context_relevance(v.memories, ["work", "en"]).select("memory_id", "relevance")


@query("b9_exclude_raw", "SELECT memory_id FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN 'raw_' || doc_id ELSE memory_id END AS memory_id FROM memories) WHERE memory_id NOT LIKE 'raw\\_%' ESCAPE '\\'")
def b9(v):
    some_raw = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("raw_"), "doc_id")).otherwise(F.col("memory_id"))
    return O.exclude_raw(v.memories.select(some_raw.alias("memory_id")))


@query("b10_user_memories", "SELECT memory_id, memory_type FROM memories WHERE memory_id IN (SELECT memory_id FROM holders WHERE user_id = 'src5') ORDER BY memory_id LIMIT 100")
def b10(v):
    return O.user_memories(v.holders, v.memories, "src5", 100).select("memory_id", "memory_type")


@query("b11_visible_memories", "SELECT o.memory_id, o.owner FROM memory_groups o WHERE o.group_id IN (SELECT group_id FROM bindings WHERE subject = 'u7')")
def b11(v):
    from factweave.operators.access import active_bindings, readable_groups

    readable = readable_groups(active_bindings(v.assignments))
    return O.visible_memories(v.memory_groups.select("memory_id", "owner"), "u7", readable, v.memory_groups.select("memory_id", "group_id"))


@query("b12_in_write_scope", "SELECT memory_id FROM (SELECT memory_id, coalesce('rbac:dedup:' || dedup_group_id, 'rbac:group:' || group_id) AS s FROM memory_groups JOIN groups USING (group_id)) WHERE s = 'rbac:dedup:d1'")
def b12(v):
    from factweave.operators.access import memory_scope

    stamped = v.memory_groups.join(memory_scope(v.groups), "group_id").select("memory_id", F.col("scope").alias("rbac_scope"))
    return O.in_write_scope(stamped, "rbac:dedup:d1").select("memory_id")


@query("b13_category_text_filter", "SELECT category_id FROM categories WHERE contains(lower(category_id), '#3') OR contains(lower(coalesce(name, '')), '#3') OR contains(lower(coalesce(description, '')), '#3')")
def b13(v):
    return O.category_text_filter(v.categories, "#3").select("category_id")


@query("b14_dedup_best", "SELECT user_id, max(round(value, 6)) AS score FROM events WHERE value >= 5 GROUP BY user_id")
def b14(v):
    return O.dedup_best(v.table("events").select("user_id", "event_id", F.round("value", 6).alias("score")), ["user_id"], floor=5.0).select("user_id", "score")


@query("b15_sanitize_unit", "SELECT event_id, CASE WHEN event_id % 10 < 2 THEN 0.0 ELSE least(greatest(value / 20 - 0.2, 0.0), 1.0) END AS unit FROM events")
def b15(v):
    nan = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).when(F.col("event_id") % 10 == 1, F.lit(float("-inf"))).otherwise(F.col("value") / 20 - 0.2)
    return v.table("events").select("event_id", sanitize_unit(nan).alias("unit"))


@query("b16_list_memories", "SELECT memory_id FROM (SELECT memory_id, memory_type FROM memories WHERE memory_id IN (SELECT memory_id FROM holders WHERE user_id = 'src5') ORDER BY memory_id LIMIT 100) WHERE memory_type = 'action'")
def b16(v):
    return O.list_memories(v.holders, v.memories, "src5", "action", 100).select("memory_id")


@query("b17_list_users", "SELECT user_id, name, created_at FROM (SELECT user_id, min(user_id) AS name, max(created_at) AS created_at FROM memories GROUP BY user_id) ORDER BY created_at DESC, user_id LIMIT 10")
def b17(v):
    users = v.memories.groupBy("user_id").agg(F.min("user_id").alias("name"), F.max("created_at").alias("created_at"))
    return O.list_users(users, 10)


@query("c17_freshness", f"SELECT memory_id, round(coalesce(least(1.0, greatest(0.0, exp(-(epoch(TIMESTAMP '{AS_OF}') - epoch(moment)) / 86400.0 / 30.0))), 0.5), 6) AS fresh FROM timed")
def c17(v):
    return v.memories.select("memory_id", F.round(freshness(event_time(), 30.0, AS_OF), 6).alias("fresh"))
