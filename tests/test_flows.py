"""Recall over a small corpus with known answers, and rules of the paths built on it."""

import pytest
from pyspark.sql import functions as F

from factweave.operators import counts as C, flows as X, graph as G, mine as M, rank as R, write as W
from factweave.plans import flows, registry
from factweave.sources.views import Views

DATA = "/root/testdata/sf0.001"
TOPICS = ["parser", "tokenizer", "scheduler", "compiler", "garden", "kitchen", "harbour", "orchard"]


@pytest.fixture(scope="module")
def corpus(spark):
    """Three facts on each of eight topics, each with a vector near its topic's; one fact is superseded, one lies far back, one is a copy of another owner's."""
    facts, vectors = [], []
    for t, name in enumerate(TOPICS):
        for k in range(3):
            i = f"m{t}{k}"
            facts.append((i, f"The {name} needs {'care' if k == 0 else 'water' if k == 1 else 'rest'} in part {k}", "ann" if k else "bob", "fact", 50, 50, f"2024-0{1 + k * 3}-10T00:00:00Z", "", f"key{t}{k}"))
            vectors.append((i, [1.0 if d == t else 0.05 * k if d == (t + 1) % 8 else 0.0 for d in range(8)]))
    facts.append(("copy", facts[0][1], "ann", "fact", 50, 50, facts[0][6], "", "key00"))
    vectors.append(("copy", vectors[0][1]))
    memories = spark.createDataFrame(facts, "memory_id string, content string, user_id string, memory_type string, certainty long, importance long, created_at string, valid_from string, content_key string")
    edges = spark.createDataFrame([("m00", "m40", "BECAUSE", 100), ("m01", "m02", "IMPLIES", 90), ("m30", "m31", "SUPPORTS", 80)], "src string, dst string, edge_type string, strength long")
    supersedes = spark.createDataFrame([("m12", "m11")], "src string, dst string")
    none = spark.createDataFrame([], "atom string, raw string")
    holders = memories.select("user_id", "memory_id")
    return memories, spark.createDataFrame(vectors, "memory_id string, embedding array<double>"), edges, supersedes, none, C.user_count(holders, memories)


def asked(spark, user=None):
    rows = [(t, [1.0 if d == t else 0.0 for d in range(8)], f"what does the {name} need", user) for t, name in enumerate(TOPICS)]
    return spark.createDataFrame(rows, "query_id long, embedding array<double>, text string, user string")


def test_recall_finds_the_topic_and_ranks_it_first(spark, corpus):
    found = X.recall(asked(spark), *corpus, "2024-12-31 00:00:00", mode="full", limit=6).cache()
    got = found.collect()
    first = {r.query_id: r.memory_id for r in got if r.rank == 1}
    assert first.keys() == set(range(8)) and all(m[1] == str(q) or m == "copy" for q, m in first.items())
    golden = spark.createDataFrame([(t, f"m{t}{k}") for t in range(8) for k in range(3)], "query_id long, memory_id string")
    score = R.eval_ranking(found, golden).agg(F.avg(F.col("hit").cast("double")), F.avg("reciprocal")).first()
    assert score[0] == 1.0 and score[1] >= 0.9
    rows = {(r.query_id, r.memory_id): r for r in got}
    # two owners hold one text: one row, counted for both
    assert sum((0, m) in rows for m in ("m00", "copy")) == 1 and max(r.user_count for r in got if r.query_id == 0) == 2
    # a superseded fact loses four tenths of its score, which may take it off the list
    assert (1, "m12") in rows and ((1, "m11") not in rows or rows[1, "m11"].superseded_by == "m12" and rows[1, "m11"].rank > rows[1, "m12"].rank)
    assert all(r.superseded_by is None for r in got if r.memory_id != "m11")
    # what only an edge leads to comes by the walk
    assert any(r.origin == "graph" for r in got) or rows[0, "m40"].origin == "seed"


def test_recall_keeps_to_owner_period_and_visibility(spark, corpus):
    own = X.recall(asked(spark, "ann"), *corpus, "2024-12-31 00:00:00", mode="full", limit=4).collect()
    assert own and all(r.memory_id == "copy" or r.memory_id[2] != "0" for r in own if r.origin == "seed")
    late = X.recall(asked(spark), *corpus, "2024-12-31 00:00:00", mode="full", limit=4, since="2024-04-01").collect()
    assert all(r.memory_id[2] != "0" for r in late if r.origin == "seed") and all(r.flashback for r in late if r.memory_id in ("m00", "m40"))
    groups = spark.createDataFrame([("m00", "g1"), ("m11", "g1"), ("m21", "g2")], "memory_id string, group_id string")
    readable = spark.createDataFrame([("ann", "g1")], "actor string, group_id string")
    seen = X.recall(asked(spark, "ann"), *corpus, "2024-12-31 00:00:00", mode="full", limit=4, readable=readable, memory_groups=groups)
    assert {r.memory_id for r in seen.collect()} <= {"m00", "m11"}


def test_recall_tells_stances_controversy_and_order(spark, corpus):
    """Everyone's rows have the stances and a contradicting fact; an owner's have neither, and flashbacks behind; an actor of no group sees nothing."""
    holders = spark.createDataFrame([("ann", "m00", "knows"), ("bob", "m00", ""), ("cat", "m00", "disputes")], "user_id string, memory_id string, stance string")
    contradicts = spark.createDataFrame([("m00", "m01", 0, "factual"), ("m02", "m00", 0, "factual"), ("copy", "m02", 0, "taste")], "src string, dst string, resolved int, strategy string")
    owner = {r.memory_id: r.user_id for r in corpus[0].collect()}
    found = X.recall(asked(spark), *corpus, "2024-12-31 00:00:00", mode="full", limit=6, holders=holders, contradicts=contradicts).where("query_id = 0").collect()
    top = next(r for r in found if r.memory_id in ("m00", "copy"))
    assert (top.stances, top.against) == (("disputes:1,knows:2", "m01") if top.memory_id == "m00" else (None, None)) and all(r.against is None or owner[r.against] != owner[r.memory_id] for r in found)
    own = X.recall(asked(spark, "ann"), *corpus, "2024-12-31 00:00:00", mode="full", limit=4, since="2024-04-01", holders=holders, contradicts=contradicts).collect()
    assert all(r.stances is None and r.against is None for r in own)
    for q in range(8):
        flags = [r.flashback for r in sorted((r for r in own if r.query_id == q), key=lambda r: r.rank)]
        assert flags == sorted(flags)
    groups = spark.createDataFrame([("m00", "g1"), ("m11", "g1"), ("m21", "g2")], "memory_id string, group_id string")
    readable = spark.createDataFrame([("eve", "g1", False), ("root", None, True)], "actor string, group_id string, unrestricted boolean")
    for actor, want in (("eve", lambda ids: ids <= {"m00", "m11"}), ("root", lambda ids: len(ids) > 8), ("nobody", lambda ids: not ids)):
        as_one = asked(spark).withColumn("actor", F.lit(actor))
        assert want({r.memory_id for r in X.recall(as_one, *corpus, "2024-12-31 00:00:00", mode="full", limit=6, readable=readable, memory_groups=groups).collect()})


def test_recall_of_the_tables_has_each_fact_once(spark):
    rows = flows._recall(Views(spark, DATA), since="2024-02-01", until="2024-10-31").collect()
    seen = registry.queries()["d16_recall"](spark, DATA).collect()
    assert {(r.query_id, r.memory_id) for r in seen} <= {(r.query_id, r.memory_id) for r in rows}
    assert rows and len({(r.query_id, r.memory_id) for r in rows}) == len(rows)
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    assert all(sorted(x.rank for x in q) == list(range(1, len(q) + 1)) and sum(not x.flashback for x in q) <= 10 and sum(x.flashback for x in q) <= 3 for q in by.values())
    assert {r.origin for r in rows} == {"seed", "graph"}


def test_relations_are_found_by_index_text_and_part(spark):
    stored = spark.createDataFrame([("x", 0, "a", "Pumps need oil"), ("x", 1, "b", "PUMPS NEED OIL"), ("x", 2, "c", "Oil is dear"), ("y", 0, "d", "Oil is dear")], "message_id string, idx int, memory_id string, text string")
    said = [("x", 0, 0, "", 2, "", "because"), ("x", 1, None, "pumps need oil", None, "is dear", "odd one"), ("x", 2, 9, "", 0, "", "IMPLIES"), ("x", 3, None, "that oil is dear to us", 0, "", "is a"), ("y", 4, None, "pumps", 0, "", "because"), ("y", 5, None, None, None, None, None)]
    rows = spark.createDataFrame(said, "message_id string, nth int, from_index int, from_text string, to_index int, to_text string, edge_type string").withColumn("strength", F.lit(50))
    got = {(r.nth, r.src, r.dst, r.edge_type) for r in W.resolve_relations(rows, stored).collect()}
    assert got == {(0, "a", "c", "BECAUSE"), (1, "b", "c", "RELATES_TO"), (3, "c", "a", "IS_A")}


def rows_of(df):
    return sorted(str(r) for r in df.collect())


def test_insight_pass_has_the_rows_of_its_stages_and_goes_on_where_it_stopped(spark, tmp_path):
    v = Views(spark, DATA)
    stages = X.Stages(spark, str(tmp_path / "pass"))
    made = flows._pass(v, stages)
    names = ["tagged", "graph", "communities", "routes", "witnesses", "gate", "curated", "insights", "stitched", "ageing", "reviewed", "retired"]
    assert stages.made == names and list(made) == names and stages.counts == {n: df.count() for n, df in made.items()}
    # each stage is what its operator makes of the tables before it
    every = v.tags.select("memory_id", "category_id").unionByName(made["tagged"].select(F.concat(F.lit("mem_"), "query_id").alias("memory_id"), "category_id")).distinct()
    assert rows_of(made["tagged"]) == rows_of(registry.queries()["h3_grow_tags"](spark, DATA)) and made["tagged"].count() > 0
    assert rows_of(made["communities"]) == rows_of(G.communities(made["graph"]))
    assert rows_of(made["routes"]) == rows_of(M.route_subsets(made["graph"], made["communities"], 5))
    assert rows_of(made["witnesses"]) == rows_of(M.witnesses(made["routes"], every, flows._aged(v)[0]))
    sound = {r.chain_id for r in made["gate"].where("verdict = 'hypothesis'").collect()}
    assert {r.chain_id for r in made["gate"].collect()} == {r.seed for r in made["routes"].where("hops > 0").collect()}
    assert rows_of(made["curated"]) == rows_of(M.curate(made["routes"].where(F.col("seed").isin(*sound)), 1, -10.0)) and made["insights"].count() <= 6
    assert rows_of(made["reviewed"]) == rows_of(W.apply_review(made["ageing"], v.memories.select("memory_id", F.when(F.col("doc_id") % 3 == 0, "promote").when(F.col("doc_id") % 3 == 1, "retire").otherwise("unclear").alias("verdict"), F.concat(F.lit("seen by "), "user_id").alias("reason")), "2024-07-01")[0]) and made["ageing"].count() == 3
    # a pass that lost its later commits makes these stages again, and only these
    before = {n: rows_of(df) for n, df in made.items()}
    for name in ("curated", "insights", "stitched", "ageing", "reviewed", "retired"):
        (tmp_path / "pass" / "commits" / name).unlink()
    again = X.Stages(spark, str(tmp_path / "pass"))
    assert {n: rows_of(df) for n, df in flows._pass(v, again).items()} == before and again.made == names[6:]


def test_pairs_with_their_verdicts_are_made_once(spark):
    """Stitching judged pairs joins the holders of an entity once, and only those with a good verdict are made distinct."""
    plan = registry.queries()["i10_stitch"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
