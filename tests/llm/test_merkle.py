"""The Merkle manifest against a tree made in plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factweave.llm import queries as Q
from factweave.llm.merkle_manifest import build, folded, proofs, siblings

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def leaf_of(r, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def tree(leaves, arity=16):
    """The root, and for each leaf its steps: digests on the left and on the right."""
    steps, level, own = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, at in enumerate(own):
            run = at - at % arity
            steps[i].append((level[run:at], level[at + 1 : run + arity]))
            own[i] = at // arity
        level = [H(*level[k : k + arity]) for k in range(0, len(level), arity)]
    return level[0], steps


def manifest(rows, arity=16):
    """For each row: leaf, subroot, root, all siblings in one string, and the root from the tampered leaf."""
    by = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text))):
        by.setdefault(r.source, []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf_of(r, r.text) for r in by[s]], arity) for s in sources}
    root, above = tree([trees[s][0] for s in sources], arity)
    for s, up in zip(sources, above, strict=True):
        for r, own in zip(by[s], trees[s][1], strict=True):
            leaf = leaf_of(r, r.text)
            text = r.text
            if text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            h = leaf_of(r, text)
            for left, right in own + up:
                h = H(*left, h, *right)
            yield r.doc_id, leaf, trees[s][0], root, "".join(x for left, right in own + up for x in left + right), h


def digests(df):
    leaf = F.col("node.digest")
    return Counter((r[0], r[1], r[2], r[3], r[4], r[5]) for r in df.select("node.id", leaf, "subroot", "root", siblings(F.col("path")), folded(F.coalesce("node.tampered", leaf), F.col("path"))).collect())


def test_query_is_the_tree(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = Counter(tuple(r) for r in Q.op13_merkle_manifest(spark, sf).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())
    assert got == Counter((i, leaf, sub, root, H(path), back, back == root) for i, leaf, sub, root, path, back in manifest(rows))
    assert any(not r[6] for r in got) and any(r[6] for r in got)


@pytest.mark.parametrize(("arity", "stride"), [(2, 1), (2, 3), (3, 2), (16, 2)])
def test_any_shape(spark, arity, stride):
    """Sources of 1 to 70 rows, one of them null, several of them, ids that are null, tied and repeated."""
    rng = random.Random(arity * 10 + stride)
    sizes = {None: 5, "": 1, "a": 70, "B": arity, "é": arity + 1, "z": 9}
    rows = [(rng.choice([None, *range(60)]), f"T {rng.randrange(9)}", "en", s, k) for s, n in sizes.items() for k in range(n)] * 1 + [(1, "Same", None, "a", 3)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = digests(proofs(build(docs, COLUMNS, kept={"tampered": F.lit(None).cast("string")}, arity=arity, stride=stride)))
    assert got == Counter((i, leaf, sub, root, path, root) for i, leaf, sub, root, path, _ in manifest(docs.collect(), arity))


def test_odd_rows(spark, odd, empty):
    """Nulls, empty and very long texts, repeated rows and columns named like results; an empty table gives no rows."""
    clash = odd.withColumn("tree", F.lit(1)).withColumn("at", F.lit(2)).withColumn("digest", F.lit("x")).withColumn("n", F.lit(3)).withColumn("path", F.lit(4)).withColumn("node", F.lit(5)).withColumn("id", F.lit(6))
    kept = {"tampered": F.lit(None).cast("string")}
    assert digests(proofs(build(clash, COLUMNS, kept=kept))) == Counter((i, leaf, sub, root, path, root) for i, leaf, sub, root, path, _ in manifest(odd.collect()))
    assert proofs(build(empty, COLUMNS)).count() == 0


def test_levels_kept(spark):
    """Only every second level is stored: 16 ** 2 leaves under each node of the next."""
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    made = build(docs, ["doc_id", "source"])
    assert [level.select(F.sum(F.size("nodes"))).first()[0] for level in made.levels] == [1000, 4, 1]
    assert [level.select(F.max("n")).first()[0] for level in made.levels] == [1000, 4, 1]
