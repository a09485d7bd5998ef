"""Keyed state against the batch forms and against plain Python, over several batches."""

import random
import uuid
from datetime import datetime, timedelta


from factweave.streaming import ingest as I, keyed as K, presence as P

T0 = datetime(2024, 1, 1)


def files(spark, path, schema, *batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(query):
    query.trigger(availableNow=True).start().awaitTermination()


AGENT = "agent_id string, principal_id string, status string, ts timestamp, event_id long"


def test_agents_as_the_batch_form(spark, tmp_path):
    """Owners that stay, refusals, revivals and farewells of unknown agents; three batches, each in any order."""
    rng = random.Random(3)
    rows = [(f"a{rng.randrange(6)}", rng.choice(["p", "p", "q"]), rng.choice(["working", "idle", "Done", "farewell"]), T0 + timedelta(seconds=k // 2), k) for k in range(90)]
    rows += [("late", "p", "farewell", T0 + timedelta(seconds=100), 100), ("back", "p", "idle", T0 + timedelta(seconds=101), 101), ("back", "p", "done", T0 + timedelta(seconds=102), 102), ("back", "q", "idle", T0 + timedelta(seconds=103), 103), ("back", "p", "idle", T0 + timedelta(seconds=104), 104)]
    parts = [rows[:40], rows[40:93], rows[93:]]
    for part in parts:
        rng.shuffle(part)
    tables = K.journal(spark, str(tmp_path / "j"))
    run(K.agents(files(spark, str(tmp_path / "in"), AGENT, *parts), tables, str(tmp_path / "cp")))
    want = I.farewell(spark.createDataFrame(rows, AGENT))
    columns = ["agent_id", "principal_id", "status", "last_seen", "refused"]
    got = {tuple(r) for r in tables.read("agents").select(*columns).collect()}
    assert got == {tuple(r) for r in want.select(*columns).collect()}
    back = next(r for r in got if r[0] == "back")
    assert back[1:3] == ("p", "idle") and back[4] == 1 and not any(r[0] == "late" for r in got)


def test_a_silent_agent_is_forgotten(spark, tmp_path):
    day = lambda k: T0 + timedelta(days=k)
    parts = [[("a", "p", "idle", day(0), 1), ("b", "p", "idle", day(0), 2)], [("b", "p", "idle", day(2), 3)], [("c", "p", "idle", day(4), 4)], [("a", "q", "idle", day(4), 5), ("b", "q", "idle", day(4), 6)]]
    tables = K.journal(spark, str(tmp_path / "j"))
    run(K.agents(files(spark, str(tmp_path / "in"), AGENT, *parts), tables, str(tmp_path / "cp"), ttl_days=3))
    got = {r.agent_id: (r.principal_id, r.refused) for r in tables.read("agents").collect()}
    assert got == {"a": ("q", 0), "b": ("p", 1), "c": ("p", 0)}


def test_brakes_as_the_batch_form(spark, tmp_path):
    rng = random.Random(8)
    schema = "stream string, nth long, persisted long, cap long"
    rows = [(f"s{k % 4}", k, rng.choice([3, 6, 6]), 0 if k % 4 == 3 else 6) for k in range(60)]
    parts = [rows[:25], rows[25:26], rows[26:]]
    for part in parts:
        rng.shuffle(part)
    tables = K.journal(spark, str(tmp_path / "j"))
    run(K.brakes(files(spark, str(tmp_path / "in"), schema, *parts), tables, str(tmp_path / "cp")))
    want = P.flood_streak(spark.createDataFrame(rows, schema))
    columns = ["stream", "nth", "streak", "paused"]
    got = {tuple(r) for r in tables.read("brakes").select(*columns).collect()}
    assert got == {tuple(r) for r in want.select(*columns).collect()} and {r[3] for r in got if r[0] == "s3"} == {False}


def machine(events, clock):
    """Inputs by hand: (time, id, kind) in order, and at last what the clock frees."""
    state = {}

    def free(i, at):
        if state[i]["status"] == "processing" and at > state[i]["since"] + 120:
            state[i] = {"status": "pending", "attempts": 0, "since": None}

    for at, i, kind in events:
        if i not in state:
            if kind == "queued":
                state[i] = {"status": "pending", "attempts": 0, "since": None}
            continue
        free(i, at)
        s = state[i]
        if kind == "claim" and s["status"] == "pending":
            state[i] = {"status": "processing", "attempts": 1, "since": at}
        elif kind == "done" and s["status"] == "processing":
            s["status"] = "done"
        elif kind == "error" and s["status"] == "processing":
            if s["attempts"] == 5 or at >= s["since"] + 60:
                s["status"] = "failed"
            else:
                s["attempts"] += 1
    for i in state:
        free(i, clock)
    return {i: (s["status"], s["attempts"]) for i, s in state.items()}


def test_inputs_as_a_machine_by_hand(spark, tmp_path):
    """Random events in four batches, inputs that nothing more is heard of, and a tick that frees them."""
    rng = random.Random(11)
    schema = "pending_id string, kind string, ts timestamp, event_id long"
    events = sorted((rng.randrange(700), f"i{rng.randrange(30)}", rng.choice(["queued", "claim", "claim", "error", "error", "error", "done"])) for _ in range(500))
    events += [(700, "stuck", "queued"), (701, "stuck", "claim"), (702, "five", "queued"), (703, "five", "claim"), *((704 + k, "five", "error") for k in range(5)), (710, "no", "claim")]
    rows = [(i, kind, T0 + timedelta(seconds=at), n) for n, (at, i, kind) in enumerate(events)]
    borders = sorted(rng.sample(range(1, len(rows)), 3))
    parts = [rows[a:b] for a, b in zip([0, *borders], [*borders, len(rows)], strict=True)] + [[("tick", "tick", T0 + timedelta(seconds=1000), len(rows))]]
    for part in parts:
        rng.shuffle(part)
    tables = K.journal(spark, str(tmp_path / "j"))
    run(K.inputs(files(spark, str(tmp_path / "in"), schema, *parts), tables, str(tmp_path / "cp"), "1 second"))
    got = {r.pending_id: (r.status, r.attempts) for r in tables.read("queue").collect()}
    assert got == machine(events, 999)
    assert got["stuck"] == ("pending", 0) and got["five"] == ("failed", 5) and "no" not in got and len({s for s, _ in got.values()}) == 3 + ("processing" in {s for s, _ in got.values()})
    asked = spark.createDataFrame([("five",), ("no",)], "pending_id string")
    assert {(r.pending_id, r.status) for r in K.pending_status(asked, tables).collect()} == {("five", "failed"), ("no", "not_found")}


def test_query_of_the_queue(spark):
    """The registered stream over the events, against the machine by hand."""
    from factweave.plans import registry

    data = "/root/testdata/sf0.001"
    kinds = {"view": "queued", "click": "claim", "error": "error", "purchase": "done"}
    rows = spark.read.parquet(f"{data}/events.parquet").select("ts", "user_id", "event_type", "event_id").collect()
    events = [(r.ts.timestamp(), str(r.user_id), kinds.get(r.event_type, "tick")) for r in sorted(rows, key=lambda r: (r.ts, r.event_id))]
    got = {r.pending_id: (r.status, r.attempts) for r in registry.queries()["k3_queue_stream"](spark, data).collect()}
    assert got == machine(events, max(e[0] for e in events))


def test_a_processor_is_called_for_blocks_of_keys(spark, tmp_path, monkeypatch):
    """Eighty keys in a few batches are a few calls, with rows of nobody's name and without a time among them."""
    monkeypatch.setattr(K, "BLOCKS", 4, raising=False)
    calls = tmp_path / "calls"
    calls.mkdir()

    def counted(kind):
        class Counted(kind):
            def handleInputRows(self, key, rows, timerValues):
                (calls / f"{kind.__name__}-{uuid.uuid4().hex}").touch()
                yield from kind.handleInputRows(self, key, rows, timerValues)

        return Counted

    for kind in (K.Agents, K.Brakes, K.Inputs):
        monkeypatch.setattr(K, kind.__name__, counted(kind))
    at = lambda k: T0 + timedelta(seconds=k)
    acts = [[(f"a{k}", "p" if k % 7 else None, "idle" if k % 5 else None, at(n) if k % 9 else None, n * 100 + k) for k in range(80)] for n in (0, 1)]
    tables = K.journal(spark, str(tmp_path / "j1"))
    run(K.agents(files(spark, str(tmp_path / "agents"), AGENT, *acts), tables, str(tmp_path / "cp1")))
    got = {r.agent_id: (r.principal_id, r.status, r.last_seen, r.refused) for r in tables.read("agents").collect()}
    assert got == {f"a{k}": ("p", "idle" if k % 5 else None, at(1) if k % 9 else None, 0) for k in range(80) if k % 7}
    passes = [[(f"s{k}" if k else None, n, 5, 5 if k % 2 else None) for k in range(80)] for n in (0, 1, 2)]
    tables = K.journal(spark, str(tmp_path / "j2"))
    run(K.brakes(files(spark, str(tmp_path / "brakes"), "stream string, nth long, persisted long, cap long", *passes), tables, str(tmp_path / "cp2")))
    assert {(r.stream, r.nth, r.paused) for r in tables.read("brakes").collect()} == {(f"s{k}" if k else None, n, n == 2 and k % 2 == 1) for k in range(80) for n in (0, 1, 2)}
    queue = [[(f"i{k}", kind, at(n + k % 3), n) for k in range(80)] for n, kind in ((0, "queued"), (10, "claim"))] + [[("i1", "done", at(20), 20)], [("tick", "tick", at(500), 500)]]
    tables = K.journal(spark, str(tmp_path / "j3"))
    run(K.inputs(files(spark, str(tmp_path / "queue"), "pending_id string, kind string, ts timestamp, event_id long", *queue), tables, str(tmp_path / "cp3"), "1 second"))
    rows = {r.pending_id: (r.status, r.attempts, r.at) for r in tables.read("queue").collect()}
    assert rows == {f"i{k}": ("done", 1, at(20)) if k == 1 else ("pending", 0, at(130 + k % 3) + timedelta(milliseconds=1)) for k in range(80)}
    names = [f.name.split("-")[0] for f in calls.iterdir()]
    assert 2 <= names.count("Agents") <= 8 and 3 <= names.count("Brakes") <= 12 and 3 <= names.count("Inputs") <= 10


def test_a_forgotten_agent_leaves_the_store(spark, tmp_path):
    day = lambda k: T0 + timedelta(days=k)
    parts = [[(f"a{k}", "p", "idle", day(0), k) for k in range(20)], [("a3", "p", "idle", day(2), 30)], [("c", "p", "idle", day(4), 40)], [("c", "p", "idle", day(4.5), 50)]]
    tables = K.journal(spark, str(tmp_path / "j"))
    run(K.agents(files(spark, str(tmp_path / "in"), AGENT, *parts), tables, str(tmp_path / "cp"), ttl_days=3))
    held = spark.read.format("statestore").option("stateVarName", "agent").load(str(tmp_path / "cp"))
    assert {r.user_map_key.agent_id for r in held.collect()} == {"a3", "c"}
    assert {r.agent_id for r in tables.read("agents").collect()} == {"c", *(f"a{k}" for k in range(20))}
