"""Exact clustering around centroids on integer vectors, with Ptolemy's inequality over fixed pairs of pivots.

Every vector is stored once with its distances to a few pivots. In a round only the centroids and their distances to the
pivots go out; for a pair of pivots p, q the distance of v and c is at least |vp * cq - vq * cp| / pq. A centroid
whose bound, rounded down, is above the best exact distance so far is out; all others are measured in 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factweave.functions.storage import stored

#: components are held within this, so that a squared distance of 64 of them fits 64 bits
LIMIT = 1 << 27
#: more than the rounding errors of a bound, relative to its terms
SLACK = 1e-12


class Clusters(NamedTuple):
    """``members``: vec_id, cluster, distance (squared); ``centres``: the final centroids, integers, a row each."""

    members: DataFrame
    centres: np.ndarray


class Pivots:
    """Some vectors far from each other, and the pairs of them that differ."""

    def __init__(self, rows: np.ndarray, count: int):
        chosen = [0] if len(rows) else []
        while chosen and len(chosen) < count:
            near = np.min([squared(rows, rows[c]) for c in chosen], axis=0)
            if not near.max():
                break
            chosen.append(int(near.argmax()))
        self.rows = rows[chosen]
        self.pairs = [(p, q, float(np.sqrt(squared(self.rows[p : p + 1], self.rows[q])[0]))) for p, q in combinations(range(len(chosen)), 2)]

    def distances(self, v: np.ndarray) -> np.ndarray:
        """Distances of each row to each pivot."""
        return np.sqrt(np.stack([squared(v, p) for p in self.rows], axis=1).astype(np.float64)) if len(self.rows) else np.zeros((len(v), 0))


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one vector, or row by row."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def lower_bounds(to_pivots: np.ndarray, of_centres: np.ndarray, pairs: list[tuple[int, int, float]]) -> np.ndarray:
    """Squared distances of all rows and centroids, none above the true one."""
    low = np.zeros((len(to_pivots), len(of_centres)))
    for p, q, apart in pairs:
        a, b = np.outer(to_pivots[:, p], of_centres[:, q]), np.outer(to_pivots[:, q], of_centres[:, p])
        np.maximum(low, (np.abs(a - b) - SLACK * (a + b)) / apart, out=low)
    return low * low * (1 - SLACK)


def nearest(v: np.ndarray, to_pivots: np.ndarray, centres: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row its nearest centroid (of several the first), their squared distance, and how many were measured in all."""
    low = lower_bounds(to_pivots, pivots.distances(centres), pivots.pairs)
    best = low.argmin(axis=1)
    least = squared(v, centres[best])
    guess, measured = best.copy(), len(v)
    for c in range(len(centres)):
        rows = np.flatnonzero((low[:, c] <= least * (1 + SLACK)) & (guess != c))
        d = squared(v[rows], centres[c])
        better = (d < least[rows]) | ((d == least[rows]) & (c < best[rows]))
        best[rows[better]], least[rows[better]] = c, d[better]
        measured += len(rows)
    return best, least, measured


def integer_vectors(embeddings: DataFrame, vector: str = "embedding", size: int = 64, scale: int = 256) -> DataFrame:
    """``vec_id, v``: vectors of exactly ``size`` components, none null or non-finite; each becomes floor(scale * x).

    Components beyond 2 ** 27 are held at it, since squared distances have to fit 64 bits.
    """
    whole = (F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = lambda x: F.greatest(F.least(x, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))
    return embeddings.where(whole).select("vec_id", F.transform(vector, lambda x: F.floor(held(x.cast("double") * scale)).cast("int")).alias("v"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _with_pivots(vectors: DataFrame, pivots: Pivots, size: int) -> DataFrame:
    """The vectors, written, with their distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = pivots.distances(_matrix(b.column("v"), size).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(list(far), pa.list_(pa.float64()))], ["vec_id", "v", "far"])

    return stored(vectors.mapInArrow(run, "vec_id long, v array<int>, far array<double>"))


def _sums(vectors: DataFrame, centres: np.ndarray, pivots: Pivots) -> list:
    """For each cluster with members their number and exact sums; a task gives one row a cluster."""
    k, size = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for b in batches:
            v = _matrix(b.column("v"), size).astype(np.int64)
            of = nearest(v, _matrix(b.column("far"), len(pivots.rows)), centres, pivots)[0]
            n += np.bincount(of, minlength=k)
            for c in np.unique(of):
                total[c] += v[of == c].sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = vectors.mapInArrow(run, "cluster long, n long, total array<long>")
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i].cast("decimal(28, 0)")).alias(f"t{i}") for i in range(size))).collect()


def cluster(vectors: DataFrame, start: Column, k: int = 40, rounds: int = 5, size: int = 64, n_pivots: int = 6) -> Clusters:
    """Clusters of ``vectors`` (``vec_id, v``): the ``k`` first by ``start`` are the centroids, ``rounds`` times moved to the
    floor of their members' mean, and then every vector is assigned once more.

    A centroid without members stays. Fewer than ``k`` vectors are a centroid each; equal centroids leave the vectors
    to the first of them. Repeated rows and null ids are vectors like any other (a null ``start`` comes last, ties go
    by the components). An empty table gives no members. The driver holds ``k`` rows; what a round sends
    is these, and what comes back are ``k`` sums.
    """
    first = vectors.select("v", start.alias("start")).orderBy(F.col("start").asc_nulls_last(), "v").limit(k).collect()
    centres = np.array([r["v"] for r in first], np.int64).reshape(-1, size)
    pivots = Pivots(centres, n_pivots)
    if not len(centres):
        return Clusters(vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centres)
    table = _with_pivots(vectors, pivots, size)
    for _ in range(rounds):
        moved = centres.copy()
        for r in _sums(table, centres, pivots):
            moved[r["cluster"]] = [int(r[f"t{i}"]) // r["n"] for i in range(size)]
        centres = moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, least, _ = nearest(_matrix(b.column("v"), size).astype(np.int64), _matrix(b.column("far"), len(pivots.rows)), centres, pivots)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(of.astype(np.int32)), pa.array(least)], ["vec_id", "cluster", "distance"])

    return Clusters(stored(table.mapInArrow(run, "vec_id long, cluster int, distance long")), centres)


def inertia(clusters: Clusters) -> DataFrame:
    """The members with ``cluster_inertia``, ``inertia`` (distances summed over the cluster and over all) and ``centroid``.

    Sums beyond 64 bits are held at the largest value.
    """
    most = (1 << 63) - 1
    sums = {r["cluster"]: int(r["d"]) for r in clusters.members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28, 0)")).alias("d")).collect()}
    whole = min(sum(sums.values()), most)
    rows = [(c, min(d, most), whole, [int(x) for x in clusters.centres[c]]) for c, d in sums.items()]
    table = clusters.members.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return clusters.members.join(F.broadcast(table), "cluster")
