"""Registered queries: presence, queues and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.plans.registry import query
from factweave.streaming import presence as P

_AT = "2024-01-15 00:00:00"
_PRES = {"latest": "SELECT agent_id, principal_id, host, status, epoch(TIMESTAMP '2024-01-15 00:00:00')::BIGINT - floor(epoch(ts))::BIGINT AS age FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, event_id DESC) AS n FROM heartbeats WHERE ts < TIMESTAMP '2024-01-15 00:00:00') WHERE n = 1",
    "pres": "SELECT *, status NOT IN ('failed') AND age BETWEEN 0 AND 40000 AS active, age > 80000 AS hidden FROM latest"}


def _presence(v):
    return P.presence(v.heartbeats.where(F.col("ts") < F.lit(_AT).cast("timestamp")), _AT, 40_000, 80_000)


@query("k5_presence", "SELECT agent_id, status, age, active, hidden, CASE WHEN active OR status = 'failed' THEN status ELSE 'stale (last reported: ' || status || ')' END AS shown FROM pres", _PRES)
def k5(v):
    return _presence(v).select("agent_id", "status", "age", "active", "hidden", "shown")


@query("k8_agent_families", "SELECT principal_id, count(*) AS instances, count(*) FILTER (active) AS active_instances, string_agg(DISTINCT host, ',' ORDER BY host) AS hosts, count(*) FILTER (active) > 0 AS active FROM pres GROUP BY principal_id", _PRES)
def k8(v):
    return P.agent_families(_presence(v))


@query("k4_recover_stuck", "SELECT event_id, CASE WHEN event_type = 'view' AND event_id % 10 <> 0 AND floor(epoch(TIMESTAMP '2024-01-15')) - floor(epoch(ts)) > 120 THEN 'pending' WHEN event_type = 'view' THEN 'processing' ELSE 'done' END AS status FROM events")
def k4(v):
    rows = v.table("events").select("event_id", F.when(F.col("event_type") == "view", "processing").otherwise("done").alias("status"), F.when(F.col("event_id") % 10 != 0, F.col("ts")).alias("started_at"))
    return P.recover_stuck(rows, _AT).select("event_id", "status")


_STREAK = """SELECT stream, nth, max(streak >= 3) OVER (PARTITION BY stream ORDER BY nth) AS paused FROM (SELECT *, sum(hit) OVER (PARTITION BY stream, run ORDER BY nth) AS streak FROM (SELECT user_id AS stream, event_id AS nth, CASE WHEN value >= 10 THEN 1 ELSE 0 END AS hit, sum(CASE WHEN value < 10 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events))"""


@query("k6_flood_streak", _STREAK)
def k6(v):
    rows = v.table("events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("nth"), F.col("value").alias("persisted"), F.lit(10.0).alias("cap"))
    return P.flood_streak(rows).select("stream", "nth", "paused")


@query("k7_resolve_principal", "SELECT agent_id, coalesce(CASE WHEN x % 4 = 0 THEN 'given' END, (SELECT arg_max(p, length(p)) FROM (SELECT DISTINCT 'agent-' || (user_id % 15) AS p FROM events) WHERE starts_with(agent_id, p)), agent_id) AS principal FROM (SELECT DISTINCT 'agent-' || user_id || '-web' AS agent_id, user_id AS x FROM events UNION SELECT DISTINCT 'other-' || user_id, user_id FROM events)")
def k7(v):
    e = v.table("events").select("user_id").distinct()
    ids = e.select("user_id", F.concat(F.lit("agent-"), "user_id", F.lit("-web")).alias("agent_id")).unionByName(e.select("user_id", F.concat(F.lit("other-"), "user_id").alias("agent_id")))
    agents = ids.select("agent_id", F.when(F.col("user_id") % 4 == 0, "given").otherwise("").alias("given"))
    known = e.select(F.concat(F.lit("agent-"), F.col("user_id") % 15).alias("principal")).distinct()
    return P.resolve_principal(agents, known)


_SENT = "SELECT event_id AS notice_id FROM events WHERE user_id = 7 AND event_id % 2 = 0 ORDER BY ts, event_id LIMIT 20"


def _drained(v):
    rows = v.table("events").select(F.col("event_id").alias("notice_id"), F.col("user_id").cast("string").alias("user_id"), F.col("ts").alias("created_at"), (F.col("event_id") % 2).cast("int").alias("delivered"))
    return P.drain_outbox(rows, "7", 20)


@query("k10_drain_outbox", _SENT)
def k10(v):
    return _drained(v)[0].select("notice_id")


@query("k10_outbox_after", "SELECT event_id AS notice_id, CASE WHEN event_id % 2 = 1 OR event_id IN (SELECT notice_id FROM sent) THEN 1 ELSE 0 END AS delivered FROM events", {"sent": _SENT})
def k10_after(v):
    """The whole outbox, with what was drained marked."""
    return _drained(v)[1].select("notice_id", "delivered")


@query("k11_activity_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def k11(v):
    return P.activity_windows(v.table("events")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("k11_sessions", "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS s FROM events)) GROUP BY user_id, g")
def k11_sessions(v):
    return P.sessions(v.table("events"), "6 hours").select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("k12_history_asof", "SELECT point_id, memory_id, event_id, action FROM (SELECT p.event_id AS point_id, p.user_id AS memory_id, h.event_id, h.event_type AS action, row_number() OVER (PARTITION BY p.event_id ORDER BY h.ts DESC, h.event_id DESC) AS n FROM (SELECT event_id, user_id, ts - INTERVAL 1 DAY AS at FROM events) p LEFT JOIN events h ON h.user_id = p.user_id AND h.ts <= p.at) WHERE n = 1")
def k12(v):
    points = v.table("events").select(F.col("event_id").alias("point_id"), F.col("user_id").alias("memory_id"), F.timestamp_add("DAY", F.lit(-1), "ts").alias("at"))
    return P.history_asof(v.history, points)


@query("k3_queue_status", "SELECT user_id AS pending_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'done' WHEN arg_max(event_type, ts) = 'click' THEN CASE WHEN count(*) FILTER (event_type = 'click') > 5 THEN 'failed' ELSE 'processing' END ELSE 'pending' END AS status, count(*) FILTER (event_type = 'click') AS attempts FROM events GROUP BY user_id")
def k3(v):
    kind = F.col("event_type")
    rows = v.table("events").select(F.col("user_id").alias("pending_id"), "ts", F.when(kind == "purchase", "done").when(kind == "click", "processing").otherwise("pending").alias("status"))
    return P.queue_status(rows)
