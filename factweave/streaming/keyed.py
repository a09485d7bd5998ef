"""Streams with a state for each key: agents and their owners, brakes on floods, and the life of queued inputs.

Each is a processor over Spark's keyed state (RocksDB store, timers, time to live) and writes what changed into a
journal, a commit for each batch; the table as it stands has one row a key. Rows of one batch are taken in the order of
their time, whatever order they come in, and rows without a time first.

Keys are dealt into blocks by hash. A processor is called once for each block that a batch has rows of, and holds its
keys in a map of the store: only the keys of the batch are read and written. Times are microseconds inside.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from factweave.schemas import TERMINAL_STATUS
from factweave.sources.journal import Journal, Table, bucket_of

# fixed values: how long an input may be worked on, when it counts as stuck, and how often it is tried
DEADLINE_S, STUCK_S, ATTEMPTS = 60, 120, 5
#: blocks of keys; a checkpoint holds for the number that it was begun with
BLOCKS = 1024
#: stands for a missing time or place, which come first
_NONE = -(1 << 63)

TABLES = {
    "agents": Table("agent_id string, principal_id string, status string, last_seen timestamp, refused long", None, ("agent_id",)),
    "brakes": Table("stream string, nth long, streak int, paused boolean"),
    "queue": Table("pending_id string, status string, attempts int, at timestamp", None, ("pending_id",)),
}


def journal(spark: SparkSession, path: str) -> Journal:
    return Journal(spark, path, TABLES)


def by_key(rows: Iterator[pd.DataFrame], key: str, *by: str) -> list[tuple]:
    """Each key of a block with all its rows of this batch, as tuples, in order."""
    found: dict = {}
    for r in pd.concat(list(rows)).sort_values(list(by), kind="stable").itertuples(index=False):
        found.setdefault(getattr(r, key), []).append(r)
    return list(found.items())


class Agents(StatefulProcessor):
    """K9: an agent belongs to whom it first announced itself for; a terminal status ends it, a later sign of life brings it back."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("agent", "agent_id string", "owner string, status string, at long, event_id long, refused long")

    def _due(self, at: int) -> int:
        """The millisecond from which an agent last heard of at a time is forgotten."""
        return max(at // 1000 + 1 + self.ttl_ms, 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for agent, acts in by_key(rows, "agent_id", "at", "event_id"):
            owner, status, at, event_id, refused = self.state.getValue((agent,)) or (None, None, None, None, 0)
            for r in acts:
                if at is not None and self.ttl_ms is not None and r.at - at >= self.ttl_ms * 1000:
                    owner, status, at, event_id, refused = None, None, None, None, 0
                if owner is None and (r.terminal or r.principal_id is None):
                    continue
                owner = r.principal_id if owner is None else owner
                if r.principal_id != owner:
                    refused += r.principal_id is not None
                elif at is None or (r.at, r.event_id) > (at, event_id):
                    status, at, event_id = r.status, r.at, r.event_id
            if owner is not None:
                self.state.updateValue((agent,), (owner, status, at, event_id, refused))
                out.append((agent, owner, status, at, refused))
        if self.ttl_ms is not None:
            # a block is gone through at quarters of the time to live, not for each agent
            grid = max(self.ttl_ms // 4, 1)
            for due in sorted({-(-self._due(x[3]) // grid) * grid for x in out}):
                self.handle.registerTimer(due)
        if out:
            yield pd.DataFrame(out, columns=["agent_id", "principal_id", "status", "last_seen", "refused"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Forget the agents of a block that were not heard of for so long; an event that comes later finds none of them either way."""
        due = expiredTimerInfo.getExpiryTimeInMs()
        for agent in [agent for agent, found in self.state.iterator() if self._due(found[2]) <= due]:
            self.state.removeKey(agent)
        return iter([])


class Brakes(StatefulProcessor):
    """K6: a stream is paused from the pass on that hits its cap as the ``n``-th in a row, and stays so."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("brake", "stream string", "streak int, paused boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for stream, passes in by_key(rows, "stream", "nth"):
            streak, paused = self.state.getValue((stream,)) or (0, False)
            for r in passes:
                streak = streak + 1 if r.hit else 0
                paused = paused or streak >= self.n
                out.append((stream, r.nth, streak, paused))
            self.state.updateValue((stream,), (streak, paused))
        yield pd.DataFrame(out, columns=["stream", "nth", "streak", "paused"])


def step(state: tuple, kind: str, at: float) -> tuple:
    """K3 and K4: ``status, attempts, since`` of an input after an event at a time in seconds.

    queued makes a pending input; claim starts work on it; error is a failed attempt, after which it is tried again
    within the deadline and up to five times, else it has failed; done ends it. Ended inputs stay so, and what was
    never queued is not known. Work that began more than two minutes before is lost: the input is pending again.
    """
    status, attempts, since = state
    if status == "processing" and at - since > STUCK_S:
        status, attempts, since = "pending", 0, None
    if status is None:
        return ("pending", 0, None) if kind == "queued" else (None, 0, None)
    if status == "pending" and kind == "claim":
        return "processing", 1, at
    if status == "processing" and kind == "done":
        return "done", attempts, since
    if status == "processing" and kind == "error":
        return ("failed", attempts, since) if attempts >= ATTEMPTS or at - since >= DEADLINE_S else ("processing", attempts + 1, since)
    return status, attempts, since


class Inputs(StatefulProcessor):
    """K3 and K4: the state of each queued input; a timer frees what is stuck when no event comes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("input", "pending_id string", "status string, attempts int, since double, at double")
        self.stuck = handle.getMapState("stuck", "due long", "pending_ids array<string>")

    def _load(self, pending: str) -> tuple:
        return tuple(self.state.getValue((pending,)) or (None, 0, None, None))

    def _keep(self, pending: str, state: tuple, at: float) -> tuple:
        self.state.updateValue((pending,), (*state, at))
        return pending, *state[:2], round(at * 1e6)

    def _rows(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=["pending_id", "status", "attempts", "at"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, begun = [], {}
        for pending, events in by_key(rows, "pending_id", "at", "event_id"):
            *state, at = self._load(pending)
            before = state = tuple(state)
            for r in events:
                at = r.at / 1e6
                state = step(state, r.kind, at)
            if state[0] is not None:
                if state[0] == "processing" and state[2] != before[2]:
                    begun.setdefault(int((state[2] + STUCK_S) * 1000) + 1, []).append(pending)
                out.append(self._keep(pending, state, at))
        for due, some in begun.items():
            (known,) = self.stuck.getValue((due,)) or ([],)
            self.stuck.updateValue((due,), ([*known, *some],))
            self.handle.registerTimer(due)
        yield from self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Of the inputs whose work began two minutes before, free those that are still worked on."""
        due, out = expiredTimerInfo.getExpiryTimeInMs(), []
        (some,) = self.stuck.getValue((due,)) or ([],)
        for pending in dict.fromkeys(some):
            *state, _ = self._load(pending)
            after = step(tuple(state), "", due / 1000)
            if after != tuple(state):
                out.append(self._keep(pending, after, due / 1000))
        self.stuck.removeKey((due,))
        yield from self._rows(out)


def _into(changes: DataFrame, tables: Journal, table: str, checkpoint: str):
    def put(batch: DataFrame, n: int) -> None:
        if not tables.has(n):
            tables.write(n, {table: batch})
            tables.commit(n)
            if len(tables.folders()) > 32:
                tables.fold()

    return changes.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint)


def _stateful(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, time: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.withColumn("block", bucket_of(key, BLOCKS)).groupBy("block").transformWithStateInPandas(processor, schema, "update", time)


def _order(column: Column) -> Column:
    """A whole number to sort by; missing ones are first."""
    return F.coalesce(column.cast("long"), F.lit(_NONE))


def _time(column: str) -> Column:
    return F.timestamp_micros(F.nullif(F.col(column), F.lit(_NONE))).alias(column)


def agents(events: DataFrame, tables: Journal, checkpoint: str, ttl_days: float | None = None, late: str = "1 minute"):
    """K9 as a stream of agent_id, principal_id, status, ts, event_id into ``agents``.

    Events come roughly in time: an event that is older than what is known counts for refusals only. With ``ttl_days``
    events later than ``late`` are dropped, and an agent that is silent for so long, by the time of the events, is
    forgotten: it keeps its last row, and may come back in another's name.
    """
    ts = F.col("ts").cast("timestamp")
    terminal = F.coalesce(F.lower("status").isin(*TERMINAL_STATUS), F.lit(False))
    named = events.where("agent_id is not null").select("agent_id", "principal_id", "status", terminal.alias("terminal"), ts.alias("ts"), _order(F.unix_micros(ts)).alias("at"), _order(F.col("event_id")).alias("event_id"))
    timed = named.drop("ts") if ttl_days is None else named.withWatermark("ts", late)
    ttl = None if ttl_days is None else int(ttl_days * 86_400_000)
    known = _stateful(timed, "agent_id", Agents(ttl), "agent_id string, principal_id string, status string, last_seen long, refused long", "none" if ttl is None else "eventTime")
    return _into(known.select("agent_id", "principal_id", "status", _time("last_seen"), "refused"), tables, "agents", checkpoint)


def brakes(passes: DataFrame, tables: Journal, checkpoint: str, n: int = 3):
    """K6 as a stream of stream, nth, persisted, cap into ``brakes``, a row for each pass."""
    hit = F.coalesce((F.col("cap") > 0) & (F.col("persisted") >= F.col("cap")), F.lit(False))
    rows = passes.select(F.col("stream").cast("string").alias("stream"), _order(F.col("nth")).alias("nth"), hit.alias("hit"))
    known = _stateful(rows, "stream", Brakes(n), "stream string, nth long, streak int, paused boolean", "none")
    return _into(known.withColumn("nth", F.nullif(F.col("nth"), F.lit(_NONE))), tables, "brakes", checkpoint)


def inputs(events: DataFrame, tables: Journal, checkpoint: str, late: str = "0 seconds"):
    """K3 and K4 as a stream of pending_id, kind, ts, event_id into ``queue``; the clock is the latest ``ts`` less ``late``.

    Rows of any id move the clock, so a row of an id that is never queued is a tick; one without a time is left out.
    """
    ts = F.col("ts").cast("timestamp")
    timed = events.where("pending_id is not null and ts is not null").select("pending_id", "kind", ts.alias("ts"), F.unix_micros(ts).alias("at"), _order(F.col("event_id")).alias("event_id")).withWatermark("ts", late)
    known = _stateful(timed, "pending_id", Inputs(), "pending_id string, status string, attempts int, at long", "eventTime")
    return _into(known.withColumn("at", _time("at")), tables, "queue", checkpoint)


def pending_status(asked: DataFrame, tables: Journal) -> DataFrame:
    """The state of each asked ``pending_id``; not_found for one that was never queued."""
    return asked.join(tables.read("queue").select("pending_id", "status", "attempts"), "pending_id", "left").withColumn("status", F.coalesce("status", F.lit("not_found")))
