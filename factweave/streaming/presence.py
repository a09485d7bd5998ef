"""Presence, queue state and change logs: as batch rules, and as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factweave.schemas import TERMINAL_STATUS


def presence(heartbeats: DataFrame, as_of: str, active_s: int = 90, ttl_s: int = 1800) -> DataFrame:
    """K5: the latest row of each agent with its age, whether it is active, hidden, and what to show."""
    last = heartbeats.groupBy("agent_id").agg(F.max(F.struct("ts", "event_id", "principal_id", "host", "status")).alias("l")).select("agent_id", "l.*")
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("ts")
    terminal = F.lower("status").isin(*TERMINAL_STATUS)
    active = F.coalesce(~terminal & (age >= 0) & (age <= active_s), F.lit(False))
    shown = F.when(active | terminal, F.col("status")).otherwise(F.concat(F.lit("stale (last reported: "), "status", F.lit(")")))
    return last.select("agent_id", "principal_id", "host", "status", age.alias("age"), active.alias("active"), F.coalesce(age > ttl_s, F.lit(True)).alias("hidden"), shown.alias("shown"))


def flood_streak(passes: DataFrame, n: int = 3) -> DataFrame:
    """K6: ``paused`` from the pass on at which ``n`` passes in a row hit the cap; it stays. Passes have a stream and an order; no cap is never hit."""
    hit = (F.col("cap") > 0) & (F.col("persisted") >= F.col("cap"))
    w = Window.partitionBy("stream").orderBy("nth")
    miss = F.sum((~hit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = passes.withColumn("_run", miss)
    streak = F.sum(hit.cast("int")).over(Window.partitionBy("stream", "_run").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return run.withColumn("streak", streak).withColumn("paused", F.max(F.col("streak") >= n).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_run")


def resolve_principal(agents: DataFrame, principals: DataFrame) -> DataFrame:
    """K7: the given principal, else the longest known one that begins the agent's id, else the id.

    An id is compared by its own beginnings, so this is an equi-join whatever the number of principals.
    """
    starts = agents.select("agent_id", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("agent_id")), lambda k: F.substring(F.col("agent_id"), F.lit(1), k))).alias("principal"))
    best = starts.join(principals, "principal").groupBy("agent_id").agg(F.max_by("principal", F.char_length("principal")).alias("known"))
    return agents.join(best, "agent_id", "left").select("agent_id", F.coalesce(F.nullif("given", F.lit("")), "known", "agent_id").alias("principal"))


def agent_families(rows: DataFrame) -> DataFrame:
    """K8: instances, active ones and hosts of each principal, active ones first."""
    g = rows.groupBy("principal_id").agg(F.count("*").alias("instances"), F.count_if("active").alias("active_instances"), F.array_join(F.array_sort(F.collect_set("host")), ",").alias("hosts"))
    return g.withColumn("active", F.col("active_instances") > 0)


def recover_stuck(queue: DataFrame, as_of: str, deadline_s: int = 60) -> DataFrame:
    """K4: processing rows older than the deadline and a minute go back to pending; without a time they stay."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("started_at")
    stuck = F.coalesce((F.col("status") == "processing") & (age > deadline_s + 60), F.lit(False))
    return queue.withColumn("status", F.when(stuck, "pending").otherwise(F.col("status")))


def drain_outbox(notices: DataFrame, user: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """A user's oldest undelivered notices, and the table with these marked."""
    out = notices.where((F.col("delivered") == 0) & (F.col("user_id") == user)).orderBy("created_at", "notice_id").limit(limit)
    sent = out.select("notice_id", F.lit(1).alias("_sent"))
    after = notices.join(sent, "notice_id", "left").withColumn("delivered", F.coalesce("_sent", "delivered")).drop("_sent")
    return out, after


def history_asof(history: DataFrame, points: DataFrame) -> DataFrame:
    """For each point (point_id, memory_id, at) the last change at or before it.

    Changes and points of a fact are sorted together and the last change is carried on, so no pairs are made.
    """
    a = history.select("memory_id", F.col("ts").alias("at"), F.lit(0).alias("way"), F.struct("ts", "event_id", "action").alias("change"), F.col("event_id").alias("nth"), F.lit(None).cast("long").alias("point_id"))
    p = points.select("memory_id", "at", F.lit(1).alias("way"), F.lit(None).cast(a.schema["change"].dataType).alias("change"), F.lit(0).cast("long").alias("nth"), "point_id")
    w = Window.partitionBy("memory_id").orderBy("at", "way", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.unionByName(p).withColumn("last", F.last("change", ignorenulls=True).over(w)).where("way = 1").select("point_id", "memory_id", F.col("last.event_id").alias("event_id"), F.col("last.action").alias("action"))


def stream_dedup(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """K2: the first row of each scope and key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["scope", "content_key"])


def activity_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events of each type by tumbling or sliding window; a stream or a table."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, parted by a gap."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def queue_status(events: DataFrame) -> DataFrame:
    """K3: the state of each pending input from its events: terminal ones win, else the latest; attempts counted."""
    rank = F.when(F.col("status").isin("done", "failed"), 1).otherwise(0)
    g = events.groupBy("pending_id").agg(F.max(F.struct(rank.alias("r"), "ts", "status")).alias("l"), F.count_if(F.col("status") == "processing").alias("attempts"))
    return g.select("pending_id", F.when((F.col("l.status") == "processing") & (F.col("attempts") > 5), "failed").otherwise(F.col("l.status")).alias("status"), "attempts")
