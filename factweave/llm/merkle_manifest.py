"""Merkle manifest of a table: a tree of hashes for each source, and one over the sources, with every few levels kept.

Only every ``stride``-th level is written (leaves, then one node for every ``arity ** stride`` of them, and so on), each as
blocks: the stored descendants of one stored node. A proof walks down from the root; in each block the levels between
are made again from the stored nodes, the siblings on the way are emitted, and the made nodes are gone with the row.
DataFrame functions throughout.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from factweave.functions.storage import stored
from factweave.llm.order import numbered

ARITY, STRIDE = 16, 2


class Manifest(NamedTuple):
    """What is kept of a table: stored levels of the sources' trees, of the tree over them, and the shape of both.

    A level is a table of blocks ``tree, n, block, nodes``: of a tree whose level has ``n`` nodes the block's, in order,
    each a struct with ``digest``. The nodes of the first level also have the ``id`` and the ``kept`` columns of their row.
    """

    levels: list[DataFrame]
    top: list[DataFrame]
    arity: int
    stride: int


def digest(parts: Column) -> Column:
    """SHA-256 in lowercase hex of an array of strings, one after the other."""
    return F.sha2(F.array_join(parts, ""), 256)


def leaf_digest(columns: Sequence[Column]) -> Column:
    """The leaf of a row: its values as UTF-8 byte count, colon and value, or ``-`` for a null; hashed one after the other."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def _next(own: Column, arity: int) -> Column:
    """The digests of one level over those of the level below it."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / arity).cast("int")), lambda r: digest(F.slice(own, r * arity + 1, arity)))


def _grow(nodes: DataFrame, arity: int, stride: int) -> list[DataFrame]:
    """Stored levels over ``tree, n, at`` and the nodes' fields, up to the one at which each tree has a single node.

    A tree that has come to its root passes it on as it is.
    """
    wide, levels = arity**stride, []
    fields = [c for c in nodes.columns if c not in ("tree", "n", "at")]
    while True:
        blocks = nodes.groupBy("tree", "n", F.floor(F.col("at") / wide).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", *fields))).alias("nodes"))
        levels.append(stored(blocks))
        if (levels[-1].agg(F.max("n")).first()[0] or 0) <= 1:
            return levels
        rows = levels[-1].withColumn("l0", F.transform("nodes", lambda x: x["digest"]))
        top = F.col("l0")[0]
        for k in range(1, stride + 1):
            rows = rows.withColumn(f"l{k}", _next(F.col(f"l{k - 1}"), arity))
            top = F.when(F.col("n") > arity ** (k - 1), F.col(f"l{k}")[0]).otherwise(top)
        nodes, fields = rows.select("tree", F.ceil(F.col("n") / wide).alias("n"), F.col("block").alias("at"), top.alias("digest")), ["digest"]


def build(docs: DataFrame, columns: Sequence[str], id: str = "doc_id", by: str = "source", kept: dict[str, Column] | None = None, arity: int = ARITY, stride: int = STRIDE) -> Manifest:
    """The manifest of ``docs``: leaves over ``columns``, a tree for each value of ``by`` in ascending order of ``id``.

    Null ids come first; rows of one id are ordered by their leaf, so the order of the input never matters and repeated
    rows are leaves each. A null ``by`` is a source of its own and first. ``kept`` names further values of a row that
    its leaf carries along. Texts of any length are hashed whole; other columns, whatever their names, are not read; an
    empty table has a manifest without nodes.
    """
    own = {"id": F.col(f"`{id}`"), **(kept or {})}
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{by}`").cast("string")), F.lit(""))
    leaves = stored(docs.select(tree.alias("tree"), leaf_digest([F.col(f"`{c}`") for c in columns]).alias("digest"), *(c.alias(k) for k, c in own.items())))
    levels = _grow(numbered(leaves, "tree", F.col("id").asc_nulls_first(), F.col("digest")), arity, stride)
    subroots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("nodes")[0]["digest"].alias("digest"))
    top = _grow(numbered(stored(subroots), "tree", F.col("source")), arity, stride)
    return Manifest(levels, top, arity, stride)


def _walk_down(levels: list[DataFrame], above: DataFrame, arity: int, stride: int) -> DataFrame:
    """The nodes of the first level with their ``path`` (lowest first): what the levels hold, then that of ``above``.

    ``above`` has ``tree``, ``path`` and other columns of whole trees, which are passed on.
    """
    more = [c for c in above.columns if c not in ("tree", "path")]
    paths = above.withColumn("block", F.lit(0).cast("long"))
    for level in reversed(levels):
        rows = level.join(paths, ["tree", "block"]).withColumn("l0", F.transform("nodes", lambda x: x["digest"]))
        for k in range(1, stride):
            rows = rows.withColumn(f"l{k}", _next(F.col(f"l{k - 1}"), arity))
        rows = rows.select("*", F.posexplode("nodes").alias("i", "node"))
        steps = []
        for k in range(stride):
            own, i = F.col(f"l{k}"), F.floor(F.col("i") / arity**k).cast("int")
            first = i - i % arity
            left, right = F.slice(own, first + 1, i - first), F.slice(own, i + 2, F.lit(arity - 1) - (i - first))
            steps.append(F.when(F.col("n") > arity**k, F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))))
        paths = rows.select("tree", F.col("node.at").alias("block"), "node", F.concat(F.array_compact(F.array(*steps)), F.col("path")).alias("path"), *more)
        done, paths = paths, paths.drop("node")
    return done


def proofs(manifest: Manifest) -> DataFrame:
    """For each row ``node`` (its ``id``, ``digest`` and kept columns), ``subroot``, ``root`` and ``path``.

    ``path`` is an array of levels from the leaf to the root with the digests of the siblings on the ``left`` and on the
    ``right``, each as one string; a step without siblings has two empty ones.
    """
    arity, stride = manifest.arity, manifest.stride
    root = manifest.top[-1].select("tree", F.array().cast("array<struct<left: string, right: string>>").alias("path"), F.col("nodes")[0]["digest"].alias("root"))
    sources = _walk_down(manifest.top, root, arity, stride)
    above = sources.select(F.col("node.source").alias("tree"), "path", F.col("node.digest").alias("subroot"), "root")
    return _walk_down(manifest.levels, above, arity, stride).select("node", "subroot", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path in one string, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")
