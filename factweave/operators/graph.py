"""Graph operators over ``edges(src, dst, edge_type, strength)``; all run for whole tables of queries at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from factweave.functions.storage import cut, stored
from factweave.functions.text import edge_strength
from factweave.operators.components import connected_components
from factweave.operators.paths import longest_in_net
from factweave.schemas import EDGE_WEIGHTS, RELATION_DAMPING, RELATION_WEIGHT, REVERSE_DAMPING


def _of(kind: Column, table: dict[str, float], rest: float) -> Column:
    out = F.lit(rest)
    for name, value in table.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def walk_edges(edges: DataFrame) -> DataFrame:
    """Every edge both ways as ``src, dst, edge_type, weight``; the way back is named _IN and damped; strength counts."""
    kind, strength = F.col("edge_type"), edge_strength("strength")
    weight = _of(kind, EDGE_WEIGHTS, RELATION_WEIGHT)
    out = edges.select("src", "dst", "edge_type", (weight * strength).alias("weight"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat(kind, F.lit("_IN")).alias("edge_type"), (weight * _of(kind, REVERSE_DAMPING, RELATION_DAMPING) * strength).alias("weight"))
    return out.unionByName(back)


def neighbours(frontier: DataFrame, walk: DataFrame, hot: int = 1000) -> DataFrame:
    """The edges that leave the nodes of a frontier (``query_id, node``).

    A node of more than ``hot`` edges meets its queries in cells of about ``hot`` edges by ``hot`` queries, so that no task
    holds a whole hub.
    """
    wide = walk.groupBy(F.col("src").alias("node")).agg(F.ceil(F.count("*") / hot).cast("int").alias("parts")).where("parts > 1")
    size = cut(frontier.join(wide, "node").groupBy("node", "parts").agg(F.ceil(F.count("*") / hot).cast("int").alias("shares")))
    cells = size.agg(F.sum(F.col("parts") * F.col("shares"))).first()[0]
    plain = lambda rows: rows.join(walk, rows["node"] == walk["src"]).drop("src")
    if not cells:
        return plain(frontier)
    n = int(min(max(cells, int(walk.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 4000))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    keys = ["node", "part", "share"]
    here = frontier.join(size, "node").withColumn("share", F.pmod(F.xxhash64("query_id"), "shares").cast("int")).withColumn("part", every("parts"))
    away = walk.withColumnRenamed("src", "node").join(size, "node").withColumn("part", F.pmod(F.xxhash64("dst", "edge_type"), "parts").cast("int")).withColumn("share", every("shares"))
    met = here.drop("parts", "shares").repartition(n, *keys).join(away.drop("parts", "shares").repartition(n, *keys), keys).drop("part", "share")
    light = plain(frontier.join(size.select("node"), "node", "left_anti"))
    return light.unionByName(met.select(*light.columns))


def fronts(seeds: DataFrame, walk: DataFrame, depth: int, beam: int = 3) -> list[DataFrame]:
    """The fronts ``query_id, node, score`` from which ``expand_beam`` takes its levels, written.

    Of the edges of one weight of a node, which score alike, only so many go on, by the id they lead to, that the beam
    is full even if all nodes visited are among them: a hub of many alike edges costs a query no more than another node.
    """
    front = cut(seeds.groupBy("query_id", "node").agg(F.max("score").alias("score")))
    found, visited = [front], front.select("query_id", "node")
    most = (front.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0) * sum(beam**k for k in range(max(depth - 1, 1)))
    alike = Window.partitionBy("src", "weight").orderBy("dst")
    few = walk.withColumn("_n", F.dense_rank().over(alike)).where(F.col("_n") <= beam + most).drop("_n")
    few = cut(few) if depth > 1 else few
    for _ in range(depth - 1):
        fresh = neighbours(front, few).join(visited.withColumnRenamed("node", "dst"), ["query_id", "dst"], "left_anti").withColumn("graph_score", F.round(F.col("score") * F.col("weight"), 12))
        w = Window.partitionBy("query_id", "node").orderBy(F.col("graph_score").desc(), "dst", "edge_type")
        best = fresh.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= beam)
        front = cut(best.groupBy("query_id", F.col("dst").alias("node")).agg(F.max("graph_score").alias("score")))
        visited = visited.unionByName(front.select("query_id", "node"))
        found.append(front)
    return found


def _once(walk: DataFrame) -> DataFrame:
    return walk.groupBy("src", "dst", "edge_type").agg(F.max("weight").alias("weight"))


def expand_beam(seeds: DataFrame, walk: DataFrame, depth: int, beam: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rows ``query_id, memory_id, parent, edge, graph_score, depth`` and the distinct edges met.

    ``seeds`` has query_id, node, score. Level by level every child not yet visited is a row; only the best ``beam``
    children of each parent, by score and then id, go on, with their highest score. A hub's children are cut per parent
    before the next join. Fronts are written, rows and edges are not: a node is in one front of a query at most, so they
    need no shuffle. A child may turn up again at a later level if no beam took it.
    """
    levels, seen, rows, ego = fronts(seeds, walk, depth, beam), None, [], []
    own = _once(walk)
    for level, front in enumerate(levels, 1):
        seen = front.select("query_id", "node") if seen is None else seen.unionByName(front.select("query_id", "node"))
        visited = seen.groupBy("query_id").agg(F.collect_set("node").alias("seen"))
        fresh = neighbours(cut(front.join(visited, "query_id")), walk).where(~F.array_contains("seen", F.col("dst")))
        rows.append(fresh.select("query_id", F.col("dst").alias("memory_id"), F.col("node").alias("parent"), F.col("edge_type").alias("edge"), F.round(F.col("score") * F.col("weight"), 12).alias("graph_score"), F.lit(level).alias("depth")))
        ego.append(front.select("query_id", "node"))
    met = neighbours(reduce(DataFrame.unionByName, ego), own)
    return reduce(DataFrame.unionByName, rows), met.select("query_id", F.col("node").alias("parent"), F.col("dst").alias("child"), "edge_type", "weight")


def nets(seeds: DataFrame, walk: DataFrame, depth: int, size: int, beam: int = 3) -> DataFrame:
    """The edges that ``expand_beam`` meets, by blocks of about ``size`` queries: ``block, query_id, parent, child, weight``.

    A row without a child names a node of a query's fronts, with its score as weight where it is a seed; a row without
    query_id is an edge of such a node, once for all queries of its block.
    """
    levels = fronts(seeds, walk, depth, beam)
    none = F.lit(None).cast("string")
    own = levels[0].select("query_id", "node", F.col("score").alias("weight"))
    own = reduce(DataFrame.unionByName, [own, *(x.select("query_id", "node", F.lit(None).cast("double").alias("weight")) for x in levels[1:])])
    blocks = max(1, -(-levels[0].select("query_id").distinct().count() // size))
    own = cut(own.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), "query_id", F.col("node").alias("parent"), none.alias("child"), "weight"))
    edges = neighbours(own.select(F.col("block").alias("query_id"), F.col("parent").alias("node")).distinct(), _once(walk))
    return own.unionByName(edges.select(F.col("query_id").alias("block"), F.lit(None).cast("long").alias("query_id"), F.col("node").alias("parent"), F.col("dst").alias("child"), "weight"))


class _Block:
    """The rows of ``nets`` of one block: names in their order, and edges by parent and child."""

    def __init__(self, pdf: pd.DataFrame, loops: bool):
        edge = pdf.child.notna().to_numpy()
        own, e = pdf[~edge], pdf[edge] if loops else pdf[edge & (pdf.parent != pdf.child).to_numpy()]
        names, place = np.unique(np.concatenate([pdf.parent.to_numpy(object), e.child.to_numpy(object)]), return_inverse=True)
        at = place[: len(pdf)]
        a, b, w = at[e.index.to_numpy()], place[len(pdf) :], e.weight.to_numpy(float)
        order = np.lexsort((w, b, a))
        self.names, self.b, self.w = names, b[order], w[order]
        self.first = np.searchsorted(a[order], np.arange(len(names) + 1))
        query, node, score = own.query_id.to_numpy(np.int64), at[own.index.to_numpy()], own.weight.to_numpy(float)
        by = np.argsort(query, kind="stable")
        ends = np.flatnonzero(np.r_[True, np.diff(query[by]) != 0])
        self.queries = [(int(query[k[0]]), node[k], score[k]) for k in np.split(by, ends[1:])] if len(by) else []


def _ranks(names: np.ndarray, restart: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, alpha: float, iterations: int, eps: float) -> np.ndarray:
    """The ranks of all names, of which ``a`` and ``b`` are places; the highest is 1."""
    restart = restart / restart.sum()
    out = np.bincount(a, weights=w, minlength=len(names))
    w = w / out[a] if len(a) else w
    p = restart.copy()
    for _ in range(iterations):
        walked = np.bincount(b, weights=p[a] * w, minlength=len(names)) if len(a) else np.zeros(len(names))
        new = (1 - alpha) * restart + alpha * (walked + p[out == 0].sum() * restart)
        done, p = np.abs(new - p).sum() < eps, new
        if done:
            break
    return p / p.max()


def personalized_pagerank(ego: DataFrame, seeds: DataFrame, alpha: float = 0.6, iterations: int = 20, eps: float = 1e-9) -> DataFrame:
    """E5: ``query_id, memory_id, ppr`` over each query's own edges (parent, child, weight) and seed weights.

    alpha is the share that walks on. Weights are normalised per node, nodes without a way on give their mass back to
    the seeds, the highest value is 1. The net of a query is bounded by its expansion, so a query is one group.
    ``net_pagerank`` is the same over the blocks of ``nets``.
    """
    edges = ego.select("query_id", F.col("parent").alias("a"), F.col("child").alias("b"), "weight")
    starts = seeds.select("query_id", F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), F.greatest(F.col("score"), F.lit(0.01)).alias("weight"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        home, e = pdf[pdf.b.isna()], pdf[pdf.b.notna()]
        names = np.unique(np.concatenate([pdf.a.to_numpy(str), e.b.to_numpy(str)]))
        restart = np.bincount(np.searchsorted(names, home.a.to_numpy(str)), weights=home.weight, minlength=len(names))
        if restart.sum() <= 0:
            return pd.DataFrame({"query_id": [], "memory_id": [], "ppr": []})
        e = e[e.weight > 0].sort_values(["a", "b"])
        p = _ranks(names, restart, np.searchsorted(names, e.a.to_numpy(str)), np.searchsorted(names, e.b.to_numpy(str)), e.weight.to_numpy(float), alpha, iterations, eps)
        return pd.DataFrame({"query_id": pdf.query_id.iloc[0], "memory_id": names, "ppr": p})

    return edges.unionByName(starts).groupBy("query_id").applyInPandas(run, "query_id long, memory_id string, ppr double")


def net_pagerank(blocks: DataFrame, alpha: float = 0.6, iterations: int = 20, eps: float = 1e-9) -> DataFrame:
    """E5 over the blocks of ``nets``: an edge goes to a block once, not to each query."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        net, out = _Block(pdf, True), []
        for query, nodes, score in net.queries:
            home = ~np.isnan(score)
            if not home.any():
                continue
            n = net.first[nodes + 1] - net.first[nodes]
            at = np.concatenate([np.arange(net.first[x], net.first[x + 1]) for x in np.sort(nodes)]) if n.sum() else np.zeros(0, int)
            a, b, w = np.repeat(np.sort(nodes), net.first[np.sort(nodes) + 1] - net.first[np.sort(nodes)]), net.b[at], net.w[at]
            own = np.unique(np.concatenate([nodes[home], a, b]))
            restart = np.bincount(np.searchsorted(own, nodes[home]), weights=np.maximum(score[home], 0.01), minlength=len(own))
            up = w > 0
            p = _ranks(own, restart, np.searchsorted(own, a[up]), np.searchsorted(own, b[up]), w[up], alpha, iterations, eps)
            out.append(pd.DataFrame({"query_id": query, "memory_id": net.names[own], "ppr": p}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "memory_id": [], "ppr": []})

    return blocks.groupBy("block").applyInPandas(run, "query_id long, memory_id string, ppr double")


def pagerank(walk: DataFrame, restart: DataFrame, alpha: float = 0.6, iterations: int = 20, eps: float = 1e-9, hot: int = 100_000) -> DataFrame:
    """E5 over the whole graph: ``memory_id, ppr`` of all nodes of ``walk`` (src, dst, weight) and of ``restart`` (node, score).

    The rules are those of ``personalized_pagerank``; one table holds the graph and no node is a group. Edges meet the
    ranks by their source, a source of many edges in parts of ``hot``, and what comes back is summed before the shuffle.
    The mass of nodes without a way on is one sum a round, and each round is written.
    """
    w = walk.where("src is not null and dst is not null and weight > 0").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").cast("double").alias("w"))
    home = restart.groupBy(F.col("node").alias("a")).agg(F.sum(F.greatest(F.col("score"), F.lit(0.01))).alias("r"))
    whole = home.agg(F.sum("r")).first()[0]
    if not whole:
        return home.select(F.col("a").alias("memory_id"), F.lit(0.0).alias("ppr")).limit(0)
    out = w.groupBy("a").agg(F.sum("w").alias("out"), F.ceil(F.count("*") / hot).cast("int").alias("parts"))
    every = w.select("a").unionByName(w.select(F.col("b").alias("a"))).unionByName(walk.select(F.explode(F.array("src", "dst")).alias("a")).where("a is not null")).unionByName(home.select("a")).distinct()
    nodes = cut(every.join(home, "a", "left").join(out, "a", "left").select("a", F.coalesce(F.col("r") / whole, F.lit(0.0)).alias("r"), "out", F.coalesce("parts", F.lit(0)).alias("parts")))
    edges = cut(w.join(nodes.select("a", "out", "parts"), "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", (F.col("w") / F.col("out")).alias("w")))
    p = cut(nodes.select("a", "r", "parts", F.col("r").alias("p")))
    for _ in range(iterations):
        lost = p.where("parts = 0").agg(F.coalesce(F.sum("p"), F.lit(0.0))).first()[0]
        sent = p.where("parts > 0 and p > 0").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "p")
        come = sent.join(edges, ["a", "part"]).groupBy(F.col("b").alias("a")).agg(F.sum(F.col("p") * F.col("w")).alias("c"))
        new = (1 - alpha) * F.col("r") + alpha * (F.coalesce("c", F.lit(0.0)) + lost * F.col("r"))
        step = cut(p.withColumnRenamed("p", "old").join(come, "a", "left").select("a", "r", "parts", "old", new.alias("p")))
        p = step.drop("old")
        if step.agg(F.sum(F.abs(F.col("p") - F.col("old")))).first()[0] < eps:
            break
    most = p.agg(F.max("p")).first()[0]
    return p.select(F.col("a").alias("memory_id"), (F.col("p") / most).alias("ppr"))


# fixed values: how much of a fact's relevance its edges pass on, along them and against them
PASSED_ON = {"IMPLIES": (0.9, 0.8), "BECAUSE": (0.95, 0.85)}
PASSED_ON_ELSE = (0.7, 0.6)


def spread(seeds: DataFrame, edges: DataFrame, levels: int = 2) -> DataFrame:
    """``query_id, memory_id, graph_part``: the facts that ``seeds`` (query_id, memory_id) lead to, with the best product of weights.

    Contradictions lead nowhere. Seeds are not among the results. Level by level the best value of each fact goes on if it
    is better than before, so a hub is one row a query.
    """
    kind = F.col("edge_type")
    way = lambda k: _of(kind, {t: x[k] for t, x in PASSED_ON.items()}, PASSED_ON_ELSE[k])
    own = edges.where("edge_type <> 'CONTRADICTS'")
    walk = own.select("src", "dst", way(0).alias("w")).unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), way(1).alias("w"))).groupBy("src", "dst").agg(F.max("w").alias("w")).withColumn("edge_type", F.lit(""))
    start = cut(seeds.select("query_id", "memory_id").distinct())
    front, found = start.withColumn("v", F.lit(1.0)), None
    for _ in range(levels):
        met = neighbours(front.withColumnRenamed("memory_id", "node"), walk).groupBy("query_id", F.col("dst").alias("memory_id")).agg(F.max(F.round(F.col("v") * F.col("w"), 12)).alias("v"))
        met = met.join(start, ["query_id", "memory_id"], "left_anti")
        if found is None:
            front = found = cut(met)
            continue
        both = cut(met.join(found.withColumnRenamed("v", "old"), ["query_id", "memory_id"], "full"))
        front = both.where("v is not null and (old is null or v > old)").select("query_id", "memory_id", "v")
        found = both.select("query_id", "memory_id", F.greatest("v", "old").alias("v"))
    return found.withColumnRenamed("v", "graph_part")


def connect(pairs: DataFrame, walk: DataFrame, max_depth: int, hot: int = 1000) -> DataFrame:
    """``pair_id, path, hops, confidence, shared_seed``: a shortest path between two sets of nodes.

    ``pairs`` has pair_id, side ('a' or 'b') and node. The smaller frontier grows, side a at a tie; a node keeps one
    parent per side (highest weight, then id). The pair ends at the first meeting, the best by weight, then id.
    Of the nodes of a frontier with more than ``hot`` neighbours the largest is held: its neighbours are counted, and the
    other side's nodes are looked up among them, but they are rows of a pair only if they have to grow in turn.
    """
    ways = stored(walk.groupBy("src", "dst").agg(F.max("weight").alias("edge")).withColumn("edge_type", F.lit("")))
    hubs = stored(ways.groupBy(F.col("src").alias("hub")).agg(F.count("*").alias("degree")).where(F.col("degree") > hot))
    near = stored(ways.join(hubs.select(F.col("hub").alias("src")), "src", "left_semi").select(F.col("src").alias("hub"), F.col("dst").alias("node"), "edge"))
    some = not hubs.isEmpty()
    key, columns = ["pair_id", "side"], ["pair_id", "side", "node", "path", "weight", "level"]
    reach = cut(pairs.select("pair_id", "side", "node", F.array("node").alias("path"), F.lit(1.0).alias("weight"), F.lit(0).alias("level")).dropDuplicates(["pair_id", "side", "node"]))
    sizes = cut(reach.groupBy(*key).agg(F.count("*").alias("n")))
    held = cut(reach.select("pair_id", "side", F.col("node").alias("hub"), "path", "weight", "level").limit(0))
    other = F.when(F.col("side") == "a", "b").otherwise("a").alias("side")

    def grown(met: DataFrame) -> DataFrame:
        """The rows with an edge (dst, edge) as children, one level further."""
        return met.select(*key, F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), (F.col("weight") * F.col("edge")).alias("weight"), (F.col("level") + 1).alias("level"))

    def through(rows: DataFrame) -> DataFrame:
        """All neighbours of hubs (node), in cells."""
        return grown(neighbours(rows.withColumn("query_id", F.col("pair_id")), ways))

    def looked_up(rows: DataFrame, by: DataFrame) -> DataFrame:
        """Of the nodes ``rows`` (pair_id, side, node) those next to the hub that ``by`` holds for the side, as its children."""
        met = by.join(rows, key).join(near, ["hub", "node"])
        return met.select(*key, "node", F.concat("path", F.array("node")).alias("path"), (F.col("weight") * F.col("edge")).alias("weight"), (F.col("level") + 1).alias("level"))

    done = None
    for _ in range(max_depth + 1):
        rows = reach
        if some:
            # what the other side has met, unless this side has a way to it already
            rows = rows.unionByName(looked_up(reach.select("pair_id", other, "node"), held).join(reach.select(*key, "node"), [*key, "node"], "left_anti"))
        a = rows.where("side = 'a'").select("pair_id", "node", F.col("path").alias("pa"), F.col("weight").alias("wa"))
        b = rows.where("side = 'b'").select("pair_id", "node", F.col("path").alias("pb"), F.col("weight").alias("wb"))
        meet = a.join(b, ["pair_id", "node"]).withColumn("weight", F.col("wa") * F.col("wb"))
        w = Window.partitionBy("pair_id").orderBy(F.size("pa") + F.size("pb"), F.col("weight").desc(), "node")
        best = meet.withColumn("_n", F.row_number().over(w)).where("_n = 1")
        path = F.concat("pa", F.slice(F.reverse("pb"), 2, 1_000_000))
        found = cut(best.select("pair_id", path.alias("path"), F.least(F.lit(1.0), "weight").alias("confidence")))
        done = found if done is None else cut(done.unionByName(found))
        open_ = reach.join(done.select("pair_id"), "pair_id", "left_anti")
        sizes = sizes.join(done.select("pair_id"), "pair_id", "left_anti")
        size = sizes.groupBy("pair_id").agg(F.sum(F.when(F.col("side") == "a", F.col("n")).otherwise(0)).alias("na"), F.sum(F.when(F.col("side") == "b", F.col("n")).otherwise(0)).alias("nb")).where("na + nb > 0")
        turn = cut(size.select("pair_id", F.when((F.col("na") <= F.col("nb")) & (F.col("na") > 0) | (F.col("nb") == 0), "a").otherwise("b").alias("side")))
        if some:
            due = cut(held.join(turn, key, "left_semi"))
            held = cut(held.join(turn.select("pair_id"), "pair_id", "left_semi").join(turn, key, "left_anti"))
            if not due.isEmpty():
                open_ = cut(open_.unionByName(through(due.withColumnRenamed("hub", "node")).join(open_.select(*key, "node"), [*key, "node"], "left_anti").select(*columns)))
        last = open_.groupBy(*key).agg(F.max("level").alias("last"))
        front = open_.join(turn, key, "left_semi").join(last, key).where("level = last").drop("last")
        light = front
        if some:
            heavy = front.join(hubs.withColumnRenamed("hub", "node"), "node").join(held.select("pair_id", F.lit(True).alias("busy")), "pair_id", "left")
            nth = Window.partitionBy(*key).orderBy(F.desc("degree"), "node")
            heavy = cut(heavy.withColumn("_n", F.row_number().over(nth)).select(*columns, "degree", (F.col("busy").isNull() & (F.col("_n") == 1)).alias("hold")))
            hold = heavy.where("hold").withColumnRenamed("node", "hub").drop("hold")
            light = front.join(hubs.select(F.col("hub").alias("node")), "node", "left_anti")
        step = grown(light.join(ways, light["node"] == ways["src"]))
        if some and not heavy.where("not hold").isEmpty():
            step = step.unionByName(through(heavy.where("not hold").select(*columns)))
        step = step.join(open_.select(*key, "node"), [*key, "node"], "left_anti").select(*columns)
        if some:
            step = cut(step)
            step = step.unionByName(looked_up(step.select(*key, "node").distinct(), hold).select(*columns))
        nth = Window.partitionBy("pair_id", "side", "node").orderBy(F.col("weight").desc(), F.array_join("path", ","))
        new = cut(step.withColumn("_n", F.row_number().over(nth)).where("_n = 1").drop("_n"))
        reach = cut(open_.unionByName(new))
        counted = new.groupBy(*key).agg(F.count("*").alias("n"))
        if some:
            known = looked_up(reach.select(*key, "node"), hold).groupBy(*key).agg(F.count("*").alias("known"))
            more = cut(hold.join(known, key, "left").withColumn("n", F.col("degree") - F.coalesce("known", F.lit(0))).where("n > 0"))
            held = cut(held.unionByName(more.select(*held.columns)))
            counted = counted.unionByName(more.select(*key, "n")).groupBy(*key).agg(F.sum("n").alias("n"))
        counted = cut(counted)
        if counted.isEmpty():
            break
        sizes = cut(sizes.join(turn, key, "left_anti").unionByName(counted))
    return done.select("pair_id", "path", (F.size("path") - 1).alias("hops"), "confidence", (F.size("path") == 1).alias("shared_seed"))


def category_bridge(frontier: DataFrame, tags: DataFrame, cap: int = 25, weight: float = 0.5) -> DataFrame:
    """Hops to facts that share a category: ``cap`` facts of each category at most, by id, at weight 0.5.

    The cap is part of the operator: of a broad category its first facts stand for it.
    """
    w = Window.partitionBy("category_id").orderBy("memory_id")
    few = tags.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).select("category_id", F.col("memory_id").alias("child"))
    own = frontier.join(tags, frontier["node"] == tags["memory_id"]).select("query_id", "node", "category_id")
    return own.join(few, "category_id").where("child <> node").select("query_id", "node", "child", F.lit("VIA_CATEGORY").alias("edge_type"), F.lit(weight).alias("weight")).distinct()


def longest_chain(ego: DataFrame, budget: int = 500_000) -> DataFrame:
    """``query_id, path, hops, confidence``: the longest simple path of each query's net, ties by product of weights.

    ``ego`` has query_id, parent, child, weight, or is made by ``nets``. Neighbours go by id, so the step budget cuts the
    same way in every run. Children without a way on are taken run by run, each still a step.
    """
    if "block" not in ego.columns:
        own = ego.select("query_id", "parent").distinct().select(F.col("query_id").alias("block"), "query_id", "parent", F.lit(None).cast("string").alias("child"), F.lit(None).cast("double").alias("weight"))
        ego = own.unionByName(ego.select(F.col("query_id").alias("block"), F.lit(None).cast("long").alias("query_id"), "parent", "child", F.col("weight").cast("double").alias("weight")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        net, out = _Block(pdf, False), []
        for query, nodes, _ in net.queries:
            inner = np.sort(nodes[net.first[nodes + 1] > net.first[nodes]])
            if len(inner):
                path, confidence = longest_in_net(inner, net.first, net.b, net.w, budget)
                out.append((query, net.names[path].tolist(), len(path) - 1, confidence))
        return pd.DataFrame(out, columns=["query_id", "path", "hops", "confidence"])

    return ego.groupBy("block").applyInPandas(run, "query_id long, path array<string>, hops int, confidence double")


#: which edges a mode of reasoning walks; None is all of them
MODES = {"causal": ("BECAUSE", "BECAUSE_IN", "IMPLIES_IN"), "forward": ("IMPLIES", "IMPLIES_IN", "BECAUSE"), "deep": None}


def reasoning_chain(seeds: DataFrame, walk: DataFrame, closeness: DataFrame | Callable[[DataFrame], DataFrame], mode: str, depth: int) -> DataFrame:
    """``query_id, seed, nth, memory_id, edge``: from each seed the chain of nodes closest to the query.

    ``closeness`` has query_id, memory_id, cosine, or makes such rows for the pairs (query_id, memory_id) it is given. Typed edges come before relations, then the closest, then the id; a
    node comes once in a chain. Deep mode keeps every node it reaches, to a depth of eight at least.
    """
    kinds = MODES.get(mode)
    own = walk if kinds is None else walk.where(F.col("edge_type").isin(*kinds))
    at = cut(seeds.select("query_id", F.col("node").alias("seed"), F.col("node"), F.array("node").alias("seen")))
    rows = at.select("query_id", "seed", F.lit(0).alias("nth"), F.col("node").alias("memory_id"), F.lit("").alias("edge"))
    for nth in range(1, (max(depth, 8) if mode == "deep" else depth) + 1):
        step = at.join(own.select("src", "dst", "edge_type"), at["node"] == F.col("src")).where(~F.array_contains("seen", F.col("dst")))
        near = closeness
        if callable(closeness):
            step = cut(step)
            near = closeness(step.select("query_id", F.col("dst").alias("memory_id")).distinct())
        step = step.join(near.select("query_id", F.col("memory_id").alias("dst"), "cosine"), ["query_id", "dst"], "left")
        typed = F.regexp_replace("edge_type", "_IN$", "").isin("IMPLIES", "BECAUSE", "CONTRADICTS")
        keys = ["query_id", "seed"] + (["dst"] if mode == "deep" else [])
        w = Window.partitionBy(*keys).orderBy(typed.desc(), F.coalesce("cosine", F.lit(-2.0)).desc(), "dst", "edge_type")
        best = step.withColumn("_n", F.row_number().over(w)).where("_n = 1")
        if mode == "deep":
            best = best.join(rows.select("query_id", "seed", F.col("memory_id").alias("dst")), ["query_id", "seed", "dst"], "left_anti")
        at = cut(best.select("query_id", "seed", F.col("dst").alias("node"), F.concat("seen", F.array("dst")).alias("seen"), "edge_type"))
        if not at.limit(1).count():
            break
        rows = cut(rows.unionByName(at.select("query_id", "seed", F.lit(nth).alias("nth"), F.col("node").alias("memory_id"), F.col("edge_type").alias("edge"))))
        at = at.drop("edge_type")
    return rows


def prefer_causal_seeds(seeds: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """Of three times the limit (15 at most) seeds with BECAUSE or IMPLIES edges come first."""
    causal = edges.where(F.col("edge_type").isin("BECAUSE", "IMPLIES"))
    ends = causal.select(F.col("src").alias("memory_id")).unionByName(causal.select(F.col("dst").alias("memory_id"))).distinct().withColumn("causal", F.lit(True))
    few = seeds.where(F.col("rank") <= min(15, 3 * limit)).join(ends, "memory_id", "left").withColumn("causal", F.coalesce("causal", F.lit(False)))
    w = Window.partitionBy("query_id").orderBy(F.col("causal").desc(), "rank")
    return few.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit).select("query_id", "memory_id", "causal", "nth")


def memory_chains(seeds: DataFrame, edges: DataFrame, kinds: tuple[str, ...], depth: int) -> DataFrame:
    """``seed, nodes, depth, rank``: for each seed the number of nodes within ``depth`` by edges of these kinds, both ways.

    Depth is the shortest one; seeds without a neighbour are dropped; most nodes first, then the deepest, then id.
    """
    some = edges.where(F.col("edge_type").isin(*kinds)).select("src", "dst")
    both = some.unionByName(some.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = cut(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("level")).distinct())
    front = seen
    for level in range(1, depth + 1):
        new = front.join(both, front["node"] == both["src"]).select("seed", F.col("dst").alias("node")).distinct().join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        front = cut(new.withColumn("level", F.lit(level)))
        if not front.limit(1).count():
            break
        seen = cut(seen.unionByName(front))
    out = seen.groupBy("seed").agg(F.count("*").alias("nodes"), F.max("level").alias("depth")).where("nodes > 1")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("nodes"), F.desc("depth"), "seed")))


def memory_graph(start: DataFrame, edges: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """The nodes within ``depth`` of the start, either way, and the distinct edges among the steps taken."""
    nodes = cut(start.select("node").distinct())
    front, met = nodes, None
    for _ in range(depth):
        step = edges.join(front.withColumnRenamed("node", "src"), "src", "left_semi").unionByName(edges.join(front.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        met = cut(step if met is None else met.unionByName(step))
        ends = step.select(F.col("src").alias("node")).unionByName(step.select(F.col("dst").alias("node"))).distinct()
        front = cut(ends.join(nodes, "node", "left_anti"))
        nodes = cut(nodes.unionByName(front))
    return nodes, met.dropDuplicates(["src", "dst", "edge_type"])


def graph_stats(memories: DataFrame, entities: DataFrame, tags: DataFrame, edges: DataFrame) -> DataFrame:
    """For each fact its entities, categories and relations out and in."""
    n = lambda df, key, name: df.groupBy(F.col(key).alias("memory_id")).agg(F.count("*").alias(name))
    out = memories.select("memory_id")
    for part in (n(entities, "memory_id", "entities"), n(tags, "memory_id", "categories"), n(edges, "src", "out"), n(edges, "dst", "incoming")):
        out = out.join(part, "memory_id", "left")
    return out.select("memory_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("entities", "categories", "out", "incoming")))


def ancestors(tree: DataFrame, most: int = 32) -> DataFrame:
    """``node, ancestor, distance``, nearest first; cycles end after ``most`` steps or at the node itself."""
    up = tree.where("parent_id is not null and parent_id <> node").select("node", "parent_id")
    rows = front = cut(up.select("node", F.col("parent_id").alias("ancestor"), F.lit(1).alias("distance")))
    for k in range(2, most + 1):
        step = front.join(up.select(F.col("node").alias("ancestor"), "parent_id"), "ancestor").select("node", F.col("parent_id").alias("ancestor"), F.lit(k).alias("distance"))
        front = cut(step.where("ancestor <> node").join(rows.select("node", "ancestor"), ["node", "ancestor"], "left_anti"))
        if not front.limit(1).count():
            break
        rows = cut(rows.unionByName(front))
    return rows


def resolve_aliases(alias: DataFrame, most: int = 32) -> DataFrame:
    """``node, canonical``: where each alias ends, by pointer jumping; in a cycle the smallest name of it."""
    at = cut(alias.select("node", F.col("target").alias("canonical"), F.col("target").alias("low")).where("node <> canonical"))
    hops = 1
    while hops < most:
        jump = at.select(F.col("node").alias("canonical"), F.col("canonical").alias("next"), F.col("low").alias("next_low"))
        at = cut(at.join(jump, "canonical", "left").select("node", F.coalesce("next", "canonical").alias("canonical"), F.least("low", F.coalesce("next_low", "low")).alias("low")))
        hops *= 2
    # whoever still points at an alias is on or behind a cycle; low of a node on it is the least name there
    ring = at.select(F.col("node").alias("canonical"), F.col("low").alias("ring_low"))
    return at.join(ring, "canonical", "left").select("node", F.coalesce("ring_low", "canonical").alias("canonical"))


def communities(adjacency: DataFrame, rounds: int = 8, small: int = 500_000, block: int = 2_000_000) -> DataFrame:
    """``node, label``: label propagation in the order of ids: a node takes the most common label of its neighbours as
    they are by then, ties the smallest; it has no vote of its own.

    A component of up to ``small`` links is gone through in one task. In larger ones nodes wait only for their smaller
    neighbours, so all nodes of one level of the ordered graph move at once, level by level; a dense graph has about as many
    levels as nodes, and goes by runs of nodes with about ``block`` links instead, if these are fewer. The labels are the same.
    """
    both = cut(adjacency.select("a", "b").unionByName(adjacency.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    part = connected_components(both)
    links = both.join(part.withColumnRenamed("node", "a"), "a")
    large = links.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > small).select("component")
    inside = links.join(large, "component", "left_anti").groupBy("component").applyInPandas(lambda pdf: _in_turn(pdf, rounds), "node string, label string")
    alone = adjacency.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(both.select(F.col("a").alias("node")), "node", "left_anti").select("node", F.col("node").alias("label"))
    found = inside.unionByName(alone)
    return found.unionByName(_by_levels(cut(links.join(large, "component", "left_semi").select("a", "b")), rounds, block)) if large.limit(1).count() else found


def _in_turn(links: pd.DataFrame, rounds: int) -> pd.DataFrame:
    near: dict[str, list[str]] = {}
    for a, b in zip(links.a, links.b, strict=True):
        near.setdefault(a, []).append(b)
    label = {n: n for n in near}
    for _ in range(rounds):
        moved = False
        for n in sorted(near):
            votes = Counter(label[m] for m in near[n])
            best = min(votes, key=lambda x: (-votes[x], x))
            moved, label[n] = moved or best != label[n], best
        if not moved:
            break
    return pd.DataFrame({"node": list(label), "label": list(label.values())})


def _by_runs(both: DataFrame, rounds: int, block: int) -> DataFrame:
    """Runs of nodes in their order, of about ``block`` links each: a run is one task, and sees the labels of all before it."""
    spark = both.sparkSession
    size = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n"))
    dealt = cut(size.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "node").withColumn("_p", F.spark_partition_id()))
    # where each range begins, by nodes and by links; one row a range
    sums, before, starts = dealt.groupBy("_p").agg(F.count("*").alias("nodes"), F.sum("n").alias("links")).orderBy("_p").collect(), (0, 0), []
    for r in sums:
        starts.append((r["_p"], *before))
        before = before[0] + r["nodes"], before[1] + r["links"]
    w = Window.partitionBy("_p").orderBy("node")
    at = dealt.join(spark.createDataFrame(starts, "_p int, nodes long, links long"), "_p")
    place = cut(at.select("node", (F.col("nodes") + F.row_number().over(w) - 1).alias("id"), F.floor((F.col("links") + F.sum("n").over(w) - F.col("n")) / block).cast("int").alias("run")))
    links = cut(both.join(place.select(F.col("node").alias("a"), F.col("id").alias("x"), "run"), "a").join(place.select(F.col("node").alias("b"), F.col("id").alias("y")), "b").select("run", "x", "y"))
    runs = sorted(r[0] for r in place.select("run").distinct().collect())

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x", kind="stable")
        own, first = np.unique(pdf.x.to_numpy(), return_index=True)
        y, known = pdf.y.to_numpy(), pdf.label.to_numpy()
        at = np.minimum(np.searchsorted(own, y), len(own) - 1)
        inside = own[at] == y
        label = np.full(len(own), -1)
        label[at[inside]] = known[inside]
        old, ends = label.copy(), np.r_[first[1:], len(y)]
        for k in range(len(own)):
            s = slice(first[k], ends[k])
            names, votes = np.unique(np.where(inside[s], label[at[s]], known[s]), return_counts=True)
            label[k] = names[votes.argmax()]
        return pd.DataFrame({"id": own, "label": label, "moved": label != old})

    # a node without a neighbour in its run does not learn its old label there, and counts as moved: one more round at most
    labels = {k: place.where(F.col("run") == k).select("id", F.col("id").alias("label")) for k in runs}
    for _ in range(rounds):
        moved = False
        for k in runs:
            here = reduce(DataFrame.unionByName, labels.values()).withColumnRenamed("id", "y")
            new = cut(links.where(F.col("run") == k).join(here, "y").groupBy("run").applyInPandas(move, "id long, label long, moved boolean"))
            moved = moved or not new.where("moved").isEmpty()
            labels[k] = new.select("id", "label")
        if not moved:
            break
    found = reduce(DataFrame.unionByName, labels.values())
    return found.join(place.select("id", "node"), "id").join(place.select(F.col("id").alias("label"), F.col("node").alias("name")), "label").select("node", F.col("name").alias("label"))


def _by_levels(both: DataFrame, rounds: int, block: int) -> DataFrame:
    nodes = both.select(F.col("a").alias("node")).distinct()
    runs = -(-both.count() // block)
    level, depth = cut(nodes.withColumn("level", F.lit(0))), 0
    while True:
        if depth >= runs:
            return _by_runs(both, rounds, block)
        above = both.where("b < a").join(level.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg((F.max("level") + 1).alias("up"))
        raised = cut(nodes.join(above, "node", "left").select("node", F.coalesce("up", F.lit(0)).alias("level")))
        deepest = raised.agg(F.max("level")).first()[0]
        if deepest == depth:
            break
        level, depth = raised, deepest
    ranked = cut(both.join(level.withColumnRenamed("node", "a"), "a"))
    labels = cut(level.select("node", "level", F.col("node").alias("label")))
    for _ in range(rounds):
        before = labels
        for k in range(depth + 1):
            votes = ranked.where(F.col("level") == k).select("a", "b").join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a", "label").agg(F.count("*").alias("n"))
            new = votes.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(-F.col("n"), "label"))["label"].alias("new"))
            labels = cut(labels.join(new, "node", "left").select("node", "level", F.coalesce("new", "label").alias("label")))
        if not labels.join(before.select("node", F.col("label").alias("old")), "node").where("label <> old").limit(1).count():
            break
    return labels.select("node", "label")


def neighbour_sets(edges: DataFrame) -> DataFrame:
    """Pairs of nodes that an edge joins, either way."""
    pairs = edges.select("src", "dst")
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
