"""Small cases with results by hand."""

import time

import pytest
from pyspark.sql import functions as F

from factweave.functions import text as T, times
from factweave.operators import atoms, graph, mine, rank, write
from factweave.operators.components import connected_components
from factweave.operators.paths import longest_path
from factweave.sources import tables
from factweave.streaming import presence as P


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_content_key_folds_space_and_case_and_keeps_types_and_scopes_apart(spark):
    df = spark.createDataFrame([("a  B\tc", "Fact"), ("A b C", "fact"), ("a b c", "goal"), ("b c", "fact a")], "t string, k string")
    keys = [r[0] for r in df.select(T.content_key("t", "k")).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3
    assert df.select(T.content_key("t", "k", F.lit("s"))).first()[0] not in keys


def test_window_bounds(spark):
    df = spark.createDataFrame([("2024-01-31T23:59:59Z",), ("2024-02-01T00:00:00Z",), ("never",)], "t string")
    kept = times.in_window(df, None, "2024-01-31", times.parsed("t"))
    assert values(kept, "t") == [("2024-01-31T23:59:59Z",), ("never",)]
    with pytest.raises(Exception, match="time bound"):
        times.in_window(df, "soon", None, times.parsed("t")).collect()


def test_scores(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-1.0,), (0.4,), (7.0,)], "x double")
    assert [r[0] for r in df.select(T.sanitize_unit("x")).collect()] == [0.0, 0.0, 0.0, 0.4, 1.0]
    future = spark.range(1).select(times.freshness(F.lit("2025-01-01 00:00:00").cast("timestamp"), 30.0, "2024-01-01 00:00:00"), times.freshness(F.lit(None).cast("timestamp"), 30.0, "2024-01-01 00:00:00"))
    assert tuple(future.first()) == (1.0, 0.5)


def test_connectives_go_by_list_order(spark):
    df = spark.createDataFrame([("we left therefore it rained because of wind",), ("because x",), ("A, is part of B",)], "t string")
    got = [r[0] for r in df.select(T.split_causal("t")).collect()]
    assert tuple(got[0]) == ("of wind", "we left therefore it rained") and got[1] is None
    assert tuple(df.select(T.split_structural("t")).collect()[2][0]) == ("PART_OF", "A", "B")


def test_chunks_rebuild_the_text(spark):
    texts = [(1, "short"), (2, "x" * 1300), (3, "word " * 400), (4, ""), (5, None)]
    df = spark.createDataFrame(texts, "k int, t string")
    chunks = atoms.chunk_text(df, "k", "t")
    assert all(r[0] <= 512 for r in chunks.select(F.length("chunk")).collect())
    assert dict(atoms.reconstruct(chunks, "k").collect()) == {k: t for k, t in texts if t is not None}


def test_rrf_order(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, memory_id string, rank int")
    b = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id long, memory_id string, rank int")
    assert [r["memory_id"] for r in rank.rrf([a, b]).orderBy("rank").collect()] == ["b", "a", "c"]


def test_clamp_counts_flashbacks_apart(spark):
    rows = [(1, f"m{i}", 1.0 - i / 10, i % 2 == 1) for i in range(8)] + [(1, "m0", 0.2, False)]
    df = spark.createDataFrame(rows, "query_id long, memory_id string, score double, flashback boolean")
    out = rank.clamp_with_flashbacks(df, 2, 1).orderBy("rank").collect()
    assert [(r.memory_id, r.flashback) for r in out] == [("m0", False), ("m2", False), ("m1", True)]


def test_pagerank(spark):
    seeds = spark.createDataFrame([(1, "s", 1.0), (2, "alone", 1.0)], "query_id long, node string, score double")
    ego = spark.createDataFrame([(1, "s", "a", 1.0), (1, "s", "b", 1.0), (1, "a", "c", 1.0), (1, "b", "c", 1.0)], "query_id long, parent string, child string, weight double")
    got = {(r.query_id, r.memory_id): r.ppr for r in graph.personalized_pagerank(ego, seeds).collect()}
    assert got[2, "alone"] == 1.0 and got[1, "s"] == 1.0 and got[1, "c"] > got[1, "a"] * 0.9


def test_beam_cuts_children_of_a_hub(spark):
    walk = spark.createDataFrame([("h", f"c{i}", "X", i / 10) for i in range(1, 7)] + [("c6", "h", "X", 1.0), ("c1", "deep", "X", 1.0)], "src string, dst string, edge_type string, weight double")
    rows, ego = graph.expand_beam(spark.createDataFrame([(1, "h", 1.0)], "query_id long, node string, score double"), walk, 2)
    assert rows.where("depth = 1").count() == 6 and rows.where("memory_id = 'deep'").count() == 0
    assert ego.where("child = 'h'").count() == 1


def test_connect_finds_shortest_and_shared(spark):
    walk = spark.createDataFrame([(a, b, "X", 0.5) for x, y in (("a", "b"), ("b", "c"), ("c", "d"), ("a", "d2")) for a, b in ((x, y), (y, x))], "src string, dst string, edge_type string, weight double")
    pairs = spark.createDataFrame([(1, "a", "a"), (1, "b", "d"), (2, "a", "c"), (2, "b", "c"), (3, "a", "a"), (3, "b", "zz")], "pair_id long, side string, node string")
    got = {r.pair_id: (r.path, r.shared_seed) for r in graph.connect(pairs, walk, 5).collect()}
    assert got == {1: (["a", "b", "c", "d"], False), 2: (["c"], True)}


def test_longest_path_and_budget():
    adj = {"a": [("b", 0.5), ("c", 0.9)], "b": [("d", 0.5)], "c": [("d", 0.9)], "d": [("a", 1.0)]}
    assert longest_path(adj, ["a"], 1000, lambda x, y: x * y, 1.0) == (["a", "c", "d"], pytest.approx(0.81))
    assert longest_path(adj, ["a"], 0, min, 1.0)[0] == ["a"]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = dict(connected_components(links).collect())
    assert {got[i] for i in range(41)} == {0} and got[101] == 100


def test_gate_order(spark):
    new = spark.createDataFrame([("n1", "x", "fact"), ("n2", " same ", "goal"), ("n3", "x", "fact"), ("n4", "x", "goal"), ("n5", "x", "fact"), ("n6", "x", "fact")], "new_id string, content string, memory_type string")
    cand = spark.createDataFrame([("n2", "t", "same", 0.1), ("n3", "t", "y", 0.69), ("n4", "t", "y", 0.99), ("n5", "t", "y", 0.98), ("n6", "t", "y", 0.979)], "new_id string, target string, target_text string, similarity double")
    got = {r.new_id: (r.operation, r.confidence) for r in write.decision_gate(new, cand).collect()}
    assert got == {"n1": ("ADD", 100), "n2": ("NOOP", 100), "n3": ("ADD", 95), "n4": (None, None), "n5": ("NOOP", 98), "n6": (None, None)}


def test_streak_pauses_and_stays(spark):
    hits = [1, 1, 0, 1, 1, 1, 0, 0]
    df = spark.createDataFrame([("s", i, h, 1) for i, h in enumerate(hits)], "stream string, nth int, persisted int, cap int")
    assert [r.paused for r in P.flood_streak(df).orderBy("nth").collect()] == [False] * 5 + [True] * 3


def test_longest_principal_wins(spark):
    agents = spark.createDataFrame([("codex-web-build", ""), ("x", ""), ("codex", "given")], "agent_id string, given string")
    known = spark.createDataFrame([("codex",), ("codex-web",)], "principal string")
    assert dict(P.resolve_principal(agents, known).collect()) == {"codex-web-build": "codex-web", "x": "x", "codex": "given"}


def test_curation_drops_covered_paths(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], 3, 2.0), (["b", "c", "d"], 2, 2.5), (["x", "y", "z"], 2, 1.0), (["p", "q"], 1, 9.0)], "path array<string>, hops int, min_pmi double")
    assert values(mine.curate(df), "text") == [("a -> b -> c -> d",), ("x -> y -> z",)]


def test_journal_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(f"i{k}", "t", f"2024-01-0{k}") for k in range(1, 6)], "insight_id string, text string, created_at string")
    tables.write_insights(df, str(tmp_path / "j"))
    assert [r.insight_id for r in tables.read_insights(spark, str(tmp_path / "j"), 2).collect()] == ["i5", "i4"]


def test_stream_dedup_and_sink(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select 's' scope, cast(id % 3 as string) content_key, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id as int)) ts from range(9)").write.parquet(src)
    stream = spark.readStream.schema("scope string, content_key string, ts timestamp").parquet(src)
    q = tables.notice_sink(P.stream_dedup(stream), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_words_are_looked_for_once_in_all_atoms():
    """Holding is holding as a part; repeats of a word count, texts do not run into each other, and long messages end soon."""
    texts, words = ["the rain came", None, "rainy days", "", "ra", "in the rain rain", "a\0b"], ["rain", "rain", "came", "days", "ra\0in", "a\0b", "rai"]
    assert atoms.held_words(texts, words).tolist() == [sum(w in (t or "") for w in words) for t in texts]
    many = [f"some words about {k} and the rest of it" for k in range(5000)]
    began = time.perf_counter()
    assert max(atoms.held_words(many, [f"w{k}x" for k in range(5000)] + ["words"])) == 1
    assert time.perf_counter() - began < 20


def test_pick_cause_effect_of_several_clauses(spark):
    a = spark.createDataFrame([("m", 0, "It rained hard"), ("m", 1, "the street was flooded"), ("m", 2, "it RAINED hard"), ("n", 0, "only one")], "message_id string, nth int, text string")
    c = spark.createDataFrame([("m", "it rained", "the street flooded"), ("m", "nothing", "flooded"), ("n", "only", "one")], "message_id string, cause string, effect string")
    assert [tuple(r) for r in atoms.pick_cause_effect(a, c).collect()] == [("m", 2, 1)]


def test_concepts_lower_a_text_once(spark):
    df = spark.createDataFrame([("I like it", "fact")], "content string, memory_type string")
    made = df.select(T.map_to_concepts("content", "memory_type").alias("c"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("lower(content") == 1
