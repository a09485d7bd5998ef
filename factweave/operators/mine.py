"""Tags and cross-category mining."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from factweave.functions.storage import cut, stored
from factweave.functions.text import chain_set, content_key, truncate_chars
from factweave.operators.components import connected_components
from factweave.operators.graph import ancestors
from factweave.operators.paths import longest_route

# fixed values: starter categories and their parents
SEED_CATEGORIES = (
    ("raw material", None), ("agriculture", "raw material"), ("petrochemicals", "raw material"), ("minerals and metals", "raw material"), ("food industry", None), ("energy", None),
    ("finance", None), ("technology", None), ("weather and climate", None), ("health and medicine", None), ("logistics and supply chain", None), ("geography and regions", None),
)


def auto_tag(near: DataFrame, tree: DataFrame, k: int = 5, threshold: float = 0.65) -> DataFrame:
    """H1: ``memory_id, category_id, confidence`` from a search of facts against categories (query_id is the fact): the best k from
    the threshold on, and their ancestors at full confidence."""
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "memory_id")
    own = near.where(F.col("cosine") >= threshold).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    direct = own.select("query_id", F.col("memory_id").alias("category_id"), F.round(100 * F.col("cosine")).cast("int").alias("confidence"))
    up = direct.join(ancestors(tree).select(F.col("node").alias("category_id"), "ancestor"), "category_id").select("query_id", F.col("ancestor").alias("category_id"), F.lit(100).alias("confidence"))
    return direct.unionByName(up).groupBy("query_id", "category_id").agg(F.max("confidence").alias("confidence"))


def untagged(memories: DataFrame, tags: DataFrame) -> DataFrame:
    """H2: facts without a tag."""
    return memories.join(tags, "memory_id", "left_anti").select("memory_id")


def grow_tags(near: DataFrame, threshold: float = 0.62, margin: float = 0.07) -> DataFrame:
    """H3: all categories from the threshold on that come within the margin of the fact's best."""
    best = F.max("cosine").over(Window.partitionBy("query_id"))
    return near.withColumn("best", best).where((F.col("cosine") >= threshold) & (F.col("cosine") >= F.col("best") - margin)).select("query_id", F.col("memory_id").alias("category_id"), F.round(100 * F.col("cosine")).cast("int").alias("confidence"))


def mint_merge(near: DataFrame, threshold: float = 0.86) -> DataFrame:
    """H4: the existing category that a proposed one reuses: its nearest, from the threshold on."""
    return near.where(F.col("cosine") >= threshold).groupBy("query_id").agg(F.max_by("memory_id", F.struct("cosine", "memory_id")).alias("category_id"))


def alias_pairs(near: DataFrame, known: DataFrame, threshold: float = 0.86, most: int = 4) -> DataFrame:
    """H5: near-synonyms, the larger id to the smaller, without known aliases; ``most`` per pass, which is the feature's limit."""
    pairs = near.where((F.col("cosine") >= threshold) & (F.col("from_id") > F.col("memory_id"))).select(F.col("from_id").alias("alias"), F.col("memory_id").alias("canonical"), "cosine")
    return pairs.join(known, "alias", "left_anti").orderBy(F.desc("cosine"), "alias", "canonical").limit(most)


def seed_categories(spark: SparkSession) -> DataFrame:
    """H6: the starter categories."""
    return spark.createDataFrame(list(SEED_CATEGORIES), "name string, parent string")


def tag_stats(memories: DataFrame, tags: DataFrame) -> DataFrame:
    """H7: facts scanned and facts with a tag, and the tags given."""
    hit = tags.groupBy("memory_id").agg(F.count("*").alias("n"))
    return memories.join(hit, "memory_id", "left").agg(F.count("*").alias("scanned"), F.count("n").alias("matched"), F.coalesce(F.sum("n"), F.lit(0)).alias("given"))


def _by_fact(tags: DataFrame) -> DataFrame:
    """``memory_id, category_id`` once each, dealt by fact: shuffled once for all that is grouped or joined by fact after it."""
    return tags.where("memory_id is not null").select("memory_id", "category_id").repartition("memory_id").distinct()


def category_pmi(tags: DataFrame, universe: int | None = None) -> DataFrame:
    """``a, b, n_ab, pmi`` (a < b) of categories that meet in a fact; the natural logarithm of how much more often than by chance.

    Pairs that never meet have a PMI of minus infinity and no row here. Tags may be repeated. They are gone through once,
    and the folded counts are written, however often the result is read; without ``universe`` it is the facts with a tag.
    """
    t = _by_fact(tags)
    nowhere = tags.where("memory_id is null").select("category_id").distinct()
    none = F.lit(None).cast("string")
    met = t.withColumnRenamed("category_id", "a").join(t.withColumnRenamed("category_id", "b"), "memory_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    size = t.select("category_id").unionByName(nowhere).groupBy("category_id").agg(F.count("*").alias("n")).where("category_id is not null")
    facts = t.groupBy("memory_id").count().agg(F.count("*").alias("n"))
    counts = stored(met.unionByName(size.select(F.col("category_id").alias("a"), none.alias("b"), "n")).unionByName(facts.select(none.alias("a"), none.alias("b"), "n")))
    if universe is None:
        universe = counts.where("a is null").first()["n"]
    size = counts.where("a is not null and b is null")
    both = counts.where("b is not null").withColumnRenamed("n", "n_ab")
    sized = both.join(size.select("a", F.col("n").alias("n_a")), "a").join(size.select(F.col("a").alias("b"), F.col("n").alias("n_b")), "b")
    return sized.select("a", "b", "n_ab", F.round(F.log(F.col("n_ab") * F.lit(float(universe)) / (F.col("n_a") * F.col("n_b"))), 9).alias("pmi"))


def pmi_graph(pmi: DataFrame, bar: float = 0.5) -> DataFrame:
    """Pairs at the bar or above, both ways."""
    over = pmi.where(F.col("pmi") >= bar).select("a", "b", "pmi")
    return over.unionByName(over.select(F.col("b").alias("a"), F.col("a").alias("b"), "pmi"))


def longest_routes(adjacency: DataFrame, budget: int = 200_000, chunk: int = 256, window: int = 1024) -> DataFrame:
    """``seed, path, pmis``: the longest simple path from each category, ties by the larger weakest link; neighbours go by id.

    Each ``chunk`` seeds get a packed copy of the first ``window`` categories of their component by id, with as many
    neighbours of each, and the seeds' own; walks try small ids first, so that in a dense graph this is all they see before
    ``budget``, the feature's limit of steps for a seed, ends them. Seeds whose walk needs more are walked again with
    four times the window, until none is left.
    """
    adjacency = stored(adjacency.select("a", "b", "pmi"))
    part = connected_components(adjacency)
    place = stored(part.withColumn("x", F.row_number().over(Window.partitionBy("component").orderBy("node")) - 1))
    links = adjacency.join(place.select(F.col("node").alias("a"), "component", "x"), "a").join(place.select(F.col("node").alias("b"), F.col("x").alias("y")), "b")
    near = links.groupBy("component", "x").agg(F.sort_array(F.collect_list(F.struct("y", "pmi"))).alias("near"))
    lists = stored(place.join(near, ["component", "x"], "left").select("component", "x", "node", *(F.coalesce(f"near.{c}", F.array().cast(f"array<{kind}>")).alias(c) for c, kind in (("y", "int"), ("pmi", "double")))))
    done, todo = [], lists.where(F.size("y") > 0).select("component", "x")
    while True:
        found = stored(_walked(lists, todo, budget, chunk, window))
        done.append(found.where("path is not null").select("seed", "path", "pmis"))
        todo = found.where("path is null").select("component", "x")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, done)
        window *= 4


def _walked(lists: DataFrame, todo: DataFrame, budget: int, chunk: int, window: int) -> DataFrame:
    """``component, x, seed, path, pmis`` of walks in one window; path is null where it was too small."""
    short = lists.select("component", "x", "node", *(F.slice(c, 1, window).alias(c) for c in ("y", "pmi")), (F.size("y") <= window).alias("whole"))

    def flat(rows: str, name: str) -> list[Column]:
        r = F.col(rows)
        return [r["x"].alias(f"{name}_x"), r["node"].alias(f"{name}_node"), F.transform(r["y"], F.size).alias(f"{name}_n"), F.flatten(r["y"]).alias(f"{name}_y"), F.flatten(r["pmi"]).alias(f"{name}_pmi"), r["whole"].alias(f"{name}_whole")]

    rows = F.sort_array(F.collect_list(F.struct("x", "node", "y", "pmi", "whole")))
    inner = short.where(F.col("x") < window).groupBy("component").agg(rows.alias("r")).select("component", *flat("r", "inner"))
    size = stored(todo.groupBy("component").agg(F.ceil(F.count("*") / chunk).alias("chunks")))
    asked = short.join(todo, ["component", "x"]).join(size, "component")
    groups = asked.groupBy("component", F.pmod(F.xxhash64("x"), F.col("chunks")).alias("part")).agg(rows.alias("r")).select("component", "part", *flat("r", "seed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                packed: dict[int, tuple[np.ndarray, np.ndarray, bool]] = {}
                names: dict[int, str] = {}
                for side in ("inner", "seed"):
                    x, n, y, pmi, whole = (batch.column(f"{side}_{c}")[i].values.to_numpy(zero_copy_only=False) for c in ("x", "n", "y", "pmi", "whole"))
                    stop = np.cumsum(n)
                    packed |= {a: (y[c - k : c], pmi[c - k : c], w) for a, k, c, w in zip(x.tolist(), n.tolist(), stop.tolist(), whole.tolist(), strict=True)}
                    names |= dict(zip(x.tolist(), batch.column(f"{side}_node")[i].as_py(), strict=True))

                @cache
                def near(a: int) -> tuple[list[int], list[float], bool] | None:
                    own = packed.get(a)
                    return own and (own[0].tolist(), own[1].tolist(), own[2])

                component = batch.column("component")[i].as_py()
                # a few seeds a batch: their paths may be long
                for at in range(0, len(x), 64):
                    seeds = x[at : at + 64].tolist()
                    walks = [longest_route(a, near, budget) for a in seeds]
                    paths = [w and [names[a] for a in w[0]] for w in walks]
                    yield pa.RecordBatch.from_arrays([pa.array([component] * len(seeds), pa.string()), pa.array(seeds, pa.int32()), pa.array([names[a] for a in seeds], pa.string()), pa.array(paths, pa.list_(pa.string())), pa.array([w and w[1] for w in walks], pa.list_(pa.float64()))], ["component", "x", "seed", "path", "pmis"])

    # chunks are few and small but long to walk: a number given by hand keeps them from being put together into one task
    n = max(1, min(4 * (size.agg(F.sum("chunks")).first()[0] or 0), 4000))
    dealt = groups.join(inner, "component").repartition(n, "component", "part").drop("part")
    return dealt.mapInArrow(run, "component string, x int, seed string, path array<string>, pmis array<double>")


def polysemy_cut(paths: DataFrame, adjacency: DataFrame, communities: DataFrame) -> DataFrame:
    """I4: ``paths`` (path, and the weights pmis of its links) cut at the first inner node whose neighbours lie in different
    communities and do not touch; the node itself stays, and ``bridge`` is its place (null: none).

    Each row is told apart by itself. A node without a community differs from none.
    """
    rows = cut(paths.withColumn("_row", F.monotonically_increasing_id()))
    inner = rows.where(F.size("path") > 2).select("_row", F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 2), lambda i: F.struct(i.alias("i"), F.get("path", i - 1).alias("a"), F.get("path", i + 1).alias("b")))).alias("p")).select("_row", "p.*")
    label = lambda end: communities.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
    apart = inner.join(label("a"), "a").join(label("b"), "b").where("a_label <> b_label").join(adjacency.select("a", "b").distinct(), ["a", "b"], "left_anti")
    first = apart.groupBy("_row").agg(F.min("i").alias("bridge"))
    done = rows.join(first, "_row", "left")
    return done.withColumn("path", F.when(F.col("bridge").isNull(), F.col("path")).otherwise(F.slice("path", 1, F.col("bridge") + 1))).withColumn("pmis", F.when(F.col("bridge").isNull(), F.col("pmis")).otherwise(F.slice("pmis", 1, F.col("bridge")))).drop("_row")


def route_subsets(adjacency: DataFrame, communities: DataFrame, max_hops: int, budget: int = 200_000) -> DataFrame:
    """``seed, path, hops, min_pmi``: the longest route from each category, cut to ``max_hops`` and then at its first bridge."""
    routes = longest_routes(adjacency, budget).select("seed", F.slice("path", 1, max_hops + 1).alias("path"), F.slice("pmis", 1, max_hops).alias("pmis"))
    cut_ones = polysemy_cut(routes, adjacency, communities)
    return cut_ones.select("seed", "path", (F.size("path") - 1).alias("hops"), F.coalesce(F.array_min("pmis"), F.lit(0.0)).alias("min_pmi"))


def witnesses(paths: DataFrame, tags: DataFrame, memories: DataFrame, n: int = 3, snippet: int = 110) -> DataFrame:
    """Up to ``n`` facts with both categories of each hop, by id, with the start of their text."""
    hop = F.explode(F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(i.alias("hop"), F.get("path", i).alias("a"), F.get("path", i + 1).alias("b"))))
    hops = paths.where("hops > 0").select("seed", hop.alias("h")).select("seed", "h.*")
    asked = stored(hops.select("a", "b").distinct())
    ends = asked.select(F.explode(F.array("a", "b")).alias("category_id")).distinct()
    t = _by_fact(tags.join(ends, "category_id", "left_semi"))
    pairs = t.withColumnRenamed("category_id", "a").join(t.withColumnRenamed("category_id", "b"), "memory_id").where("a <> b").join(asked, ["a", "b"])
    w = Window.partitionBy("a", "b").orderBy("memory_id")
    few = pairs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n").join(memories.select("memory_id", truncate_chars("content", snippet).alias("snippet")), "memory_id", "left")
    return hops.join(few, ["a", "b"]).select("seed", "hop", "a", "b", "memory_id", "snippet")


def coherence_gate(chains: DataFrame) -> DataFrame:
    """By chain (chain_id, edge_type, weight): geometric mean of weights, share of reasoning hops, and the verdict."""
    w = F.least(F.greatest("weight", F.lit(1e-9)), F.lit(1.0))
    kind = F.regexp_replace("edge_type", "_IN$", "").isin("IMPLIES", "BECAUSE", "CONTRADICTS", "SUPPORTS")
    g = chains.groupBy("chain_id").agg(F.exp(F.avg(F.log(w))).alias("strength"), F.avg(kind.cast("double")).alias("share"))
    return g.withColumn("verdict", F.when((F.col("strength") >= 0.5) & (F.col("share") >= 0.5), "hypothesis").otherwise("apophenia"))


def curate(paths: DataFrame, min_hops: int = 2, min_pmi: float = 1.0) -> DataFrame:
    """Paths by value (hops times weakest link), without those whose categories lie in a better one's."""
    good = paths.where((F.col("hops") >= min_hops) & (F.col("min_pmi") >= min_pmi)).withColumn("value", F.round(F.col("hops") * F.col("min_pmi"), 9)).withColumn("text", F.array_join("path", " -> "))
    good = good.groupBy("text").agg(F.first("path").alias("path"), F.first("hops").alias("hops"), F.first("min_pmi").alias("min_pmi"), F.first("value").alias("value"))
    # what covers a path covers its first category too, so that is the key to meet on
    better = good.select(F.explode("path").alias("first"), F.col("path").alias("p2"), F.col("value").alias("v2"), F.col("text").alias("t2"))
    own = good.withColumn("first", F.get("path", F.lit(0)))
    covered = own.join(better, "first").where((F.size(F.array_except("path", "p2")) == 0) & ((F.col("v2") > F.col("value")) | ((F.col("v2") == F.col("value")) & (F.col("t2") < F.col("text"))))).select("text").distinct()
    return good.join(covered, "text", "left_anti")


def new_insights(curated: DataFrame, existing: DataFrame, cap: int = 6) -> DataFrame:
    """I8: insights to keep of one pass, six at most: no subset of a known one's chain, no known key."""
    sets = existing.select(chain_set("text").alias("known"), "content_key")
    text = F.concat(F.lit("HYPOTHESIS (generated): these may be linked via the chain "), F.array_join("path", " -> "), F.lit(". Found by co-occurrence."))
    rows = curated.withColumn("insight", text).withColumn("content_key", content_key("insight", F.lit("fact"))).join(existing.select("content_key"), "content_key", "left_anti")
    low = F.transform("path", lambda x: F.lower(x))
    member = sets.select(F.explode("known").alias("first"), "known")
    inside = rows.withColumn("low", low).withColumn("first", F.get("low", F.lit(0))).join(member, "first").where(F.size(F.array_except("low", "known")) == 0).select("insight").distinct()
    best = rows.join(inside, "insight", "left_anti").orderBy(F.desc("value"), "insight").limit(cap)
    return best.select("insight", "content_key", F.lit(40).alias("certainty"), F.least(F.lit(85), 50 + 5 * F.col("hops")).alias("importance"))


def shared_entity_pairs(memories: DataFrame, entities: DataFrame, linked: DataFrame, window: int = 40, cap: int = 12) -> DataFrame:
    """Pairs of a user's newest facts that share an entity and are not linked, most shared first; both limits are the feature's."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), "memory_id"))
    recent = cut(memories.withColumn("_n", nth).where(F.col("_n") <= window).select("user_id", "memory_id"))
    held = recent.join(entities.join(recent, "memory_id", "left_semi"), "memory_id")
    b = held.withColumnRenamed("memory_id", "b")
    pairs = held.withColumnRenamed("memory_id", "a").join(b, ["user_id", "entity_id"]).where("a < b").groupBy("user_id", "a", "b").agg(F.count("*").alias("shared"))
    fresh = pairs.join(linked.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")
    w = Window.partitionBy("user_id").orderBy(F.desc("shared"), "a", "b")
    return fresh.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= cap)


def stitch(pairs: DataFrame, verdicts: DataFrame | None = None, most: int = 6) -> DataFrame:
    """Hypotheses of one pass from BECAUSE verdicts of 70 or more, with both witnesses; ``pairs`` may carry their verdicts."""
    sure = (verdicts if verdicts is not None else pairs).where("verdict = 'BECAUSE' and confidence >= 70")
    good = (pairs.join(sure, ["a", "b"]) if verdicts is not None else sure).orderBy(F.desc("confidence"), "a", "b").limit(most)
    return good.select("a", "b", "confidence", F.concat(F.lit("ins_"), F.substring(F.sha2(F.concat_ws("|", "a", "b"), 256), 1, 16)).alias("insight_id"))


def consolidate_candidates(memories: DataFrame, entities: DataFrame, per_memory: int) -> DataFrame:
    """For each fact up to ``per_memory`` others that share an entity, most shared first.

    Hot entities: pairs are counted with partial sums, and only facts of the table asked for start one.
    """
    own = entities.join(memories.select("memory_id"), "memory_id", "left_semi")
    b = own.withColumnRenamed("memory_id", "other")
    pairs = own.join(b, "entity_id").where("memory_id <> other").groupBy("memory_id", "other").agg(F.count("*").alias("shared"))
    w = Window.partitionBy("memory_id").orderBy(F.desc("shared"), "other")
    return pairs.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_memory)
