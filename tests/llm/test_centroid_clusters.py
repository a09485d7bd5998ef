"""Clusters around centroids against plain integers, and the bounds."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import queries as Q
from factweave.llm.centroid_clusters import LIMIT, Pivots, cluster, integer_vectors, lower_bounds, nearest

START = "sha2(concat('2:', cast(vec_id AS string)), 256)"
KIND = "vec_id long, embedding array<float>, label int"


def floors(rows, size):
    """The vectors that count, as integers."""
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            yield i, [math.floor(256 * max(min(x, LIMIT / 256), -LIMIT / 256)) for x in (float(np.float32(x)) for x in v)]


def brute(vectors, k=40, rounds=5):
    vectors = list(vectors)
    start = sorted((x for x in vectors), key=lambda x: (x[0] is None, hashlib.sha256(f"2:{x[0]}".encode()).hexdigest() if x[0] is not None else "", x[1]))[:k]
    centres = [v for _, v in start]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres)) for _, v in vectors]

    for _ in range(rounds):
        of = assign()
        for n in range(len(centres)):
            own = [v for (_, v), (_, m) in zip(vectors, of, strict=True) if m == n]
            if own:
                centres[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    of = assign()
    return Counter((i, n, d) for (i, _), (d, n) in zip(vectors, of, strict=True)), centres


def members(found):
    return Counter(tuple(r) for r in found.members.select("vec_id", "cluster", "distance").collect())


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, centres = brute(floors(rows, 64))
    out = Q.op12_centroid_clusters(spark, sf).collect()
    assert Counter((r.vec_id, r.cluster, r.distance) for r in out) == want
    for r in out:
        assert r.inertia == sum(d * n for (_, _, d), n in want.items())
        assert r.cluster_inertia == sum(d * n for (_, c, d), n in want.items() if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


@pytest.mark.parametrize("n_pivots", [1, 2, 5])
def test_odd_vectors(spark, n_pivots):
    """Nulls, wrong sizes, odd numbers, ties, repeated rows, one vector on a third of all rows, columns that clash."""
    rng = random.Random(n_pivots)
    rows = [(k, [rng.randrange(-3, 4) / 256 for _ in range(4)]) for k in range(60)] + [(k % 7, [0.01, 0.0, -0.01, 0.5]) for k in range(40)]
    rows += [(None, [0.1, 0.2, 0.3, 0.4]), (1, None), (2, []), (3, [0.1] * 5), (4, [0.1, None, 0.2, 0.3]), (5, [float("nan"), 0.0, 0.0, 0.0]), (6, [float("inf"), 0.0, 0.0, 0.0]), (7, [1e38, -1e38, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], KIND).withColumn("cluster", F.lit(1)).withColumn("v", F.lit(2)).withColumn("distance", F.lit("x"))
    got = cluster(integer_vectors(df, size=4), F.expr(START), k=9, size=4, n_pivots=n_pivots)
    want, centres = brute(floors(rows, 4), k=9)
    assert members(got) == want and got.centres.tolist() == centres


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)], KIND)
    assert members(cluster(integer_vectors(df, size=2), F.expr(START), size=2)) == Counter({(1, 0, 0): 1, (2, 0, 0): 1})
    none = cluster(integer_vectors(df.limit(0), size=2), F.expr(START), size=2)
    assert none.members.count() == 0 and none.members.columns == ["vec_id", "cluster", "distance"]


def test_no_bound_is_above_the_distance():
    """Near and far vectors, also at the largest components; fewer are measured where groups are apart."""
    rng = np.random.default_rng(2)
    for scale in (1, 1000, LIMIT):
        v = rng.integers(-scale, scale + 1, (400, 64))
        v[::7] = v[0]
        v[1::2] += rng.integers(-1, 2, (200, 64))
        v = np.clip(v, -LIMIT, LIMIT)
        c = v[:30]
        pivots = Pivots(c, 6)
        far = pivots.distances(v)
        low, true = lower_bounds(far, pivots.distances(c), pivots.pairs), np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in v])
        assert (low <= true.astype(float) * (1 + 1e-15)).all()
        of, least, _ = nearest(v, far, c, pivots)
        assert of.tolist() == true.argmin(axis=1).tolist() and least.tolist() == true.min(axis=1).tolist()
    groups = rng.integers(-100_000, 100_000, (8, 64))
    v = np.repeat(groups, 50, axis=0) + rng.integers(-5, 6, (400, 64))
    pivots = Pivots(groups, 6)
    assert nearest(v, pivots.distances(v), groups, pivots)[2] < 0.5 * 400 * 8
