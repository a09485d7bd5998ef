"""SimHash fingerprints and the search within a radius, against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from factweave.llm import queries as Q
from factweave.llm.fingerprints import BITS, as_hex, block_masks, fingerprint_documents, fingerprints, near_prints

SF = "/root/testdata/sf0.001"


def xx(*values):
    """Spark's hash of several columns: each is hashed with the hash before as its seed."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v, seed=h)
    return h


def simhash(text):
    words = [w.encode() for w in re.findall(r"[^\W_]+", (text or "").lower())]
    terms = [xx(a, b) for a, b in zip(words, words[1:], strict=False)] or [xx(w) for w in words]
    votes = [0] * BITS
    for h in terms:
        both = h | xx(h.to_bytes(8, "little")) << 64
        for k in range(BITS):
            votes[k] += both >> k & 1
    return sum(1 << k for k in range(BITS) if 2 * votes[k] > len(terms))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def print_of(doc_id, text):
    return signed(xx((1 if doc_id is None else 0).to_bytes(4, "little"), (text or "").encode()))


def expected(rows):
    """By the contract: the next document in descending id; rows that are the same are one document."""
    ordered = sorted({(i, t or "") for i, t in rows}, key=lambda x: (x[0] is None, -(x[0] or 0), print_of(*x)))
    after = {x: ordered[(k + 1) % len(ordered)] for k, x in enumerate(ordered)}
    out = Counter()
    for i, t in rows:
        text, other = t or "", after[i, t or ""][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        a, b, c = simhash(text), simhash(edited), simhash(other)
        out[i, len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{a:032x}", f"{b:032x}", 1 - (a ^ b).bit_count() / BITS, 1 - (a ^ c).bit_count() / BITS] += 1
    return out


def got(df):
    from factweave.llm.fingerprints import likeness

    f, e, n = ([F.col(f"{side}f1"), F.col(f"{side}f2")] for side in ("", "edited_", "next_"))
    return Counter(tuple(r) for r in df.select("doc_id", "n_chars", "edited_sha256", as_hex(*f), as_hex(*e), likeness(*f, *e), likeness(*f, *n)).collect())


def test_query(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = Q.op11_fingerprints(spark, SF).collect()
    assert Counter(tuple(r)[:7] for r in out) == expected(rows)
    prints = {r.doc_id: int(r.fingerprint, 16) for r in out}
    for r in out:
        assert r.n_near == (sum((prints[r.doc_id] ^ p).bit_count() <= 4 for p in prints.values()) - 1 if r.doc_id % 20 == 0 else None)
    assert sum(r.near_edited for r in out) > sum(r.near_next for r in out) + 0.1 * len(out)


def test_odd_rows(spark, odd, empty):
    clash = odd.withColumn("doc", F.lit(9)).withColumn("print", F.lit(8)).withColumn("f1", F.lit(7)).withColumn("next", F.lit(6)).withColumn("copies", F.lit(5))
    assert got(fingerprint_documents(clash)) == expected([(r.doc_id, r.text) for r in odd.collect()])
    assert fingerprint_documents(empty).count() == 0
    one = spark.createDataFrame([(7, "a text by itself")], "doc_id long, text string")
    assert got(fingerprint_documents(one)) == expected([(7, "a text by itself")])


def test_ties_and_hot_ids(spark):
    """Half of all rows share an id, a tenth have none, and many are equal."""
    rng = random.Random(4)
    rows = [(rng.choice([5, 5, 5, None, rng.randrange(40)]), " ".join(rng.choices("ab cd é ef gh".split(), k=rng.randrange(6)))) for _ in range(300)]
    assert got(fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == expected(rows)


def test_pieces_of_a_long_text(spark):
    """More terms than a lane of a piece counts, and one word very often."""
    rng = random.Random(1)
    rows = [(1, " ".join(f"w{rng.randrange(50)}" for _ in range(40_000))), (2, "same " * 70_000), (3, None)]
    out = {r.k: (r.f1 & (1 << 64) - 1) | (r.f2 & (1 << 64) - 1) << 64 for r in fingerprints(spark.createDataFrame(rows, "k long, text string"), ["k"]).collect()}
    assert out == {k: simhash(t) for k, t in rows}


@pytest.mark.parametrize(("radius", "blocks"), [(4, 6), (2, 3), (0, 2), (7, 9)])
def test_near_prints(spark, radius, blocks):
    """Groups of close fingerprints, one of them large, at distances up to beyond the radius; chunks far smaller than it."""
    rng = random.Random(radius)
    found = {0}
    for size in (1, 3, 120):
        seed = rng.getrandbits(BITS)
        for _ in range(size):
            x = seed
            for _ in range(rng.randrange(radius + 3)):
                x ^= 1 << rng.randrange(BITS)
            found.add(x)
    found = sorted(found)
    rows = [(signed(x & (1 << 64) - 1), signed(x >> 64), 1 + k % 3) for k, x in enumerate(found)]
    prints = spark.createDataFrame(rows, "f1 long, f2 long, n long").repartition(3)
    back = defaultdict(Counter)
    for r in near_prints(prints, prints, radius, blocks, chunk=16).collect():
        back[r.f1, r.f2].update({tuple(x) for x in r.near})
    want = {(a[0], a[1]): Counter(b for y, b in zip(found, rows, strict=True) if (x ^ y).bit_count() <= radius) for x, a in zip(found, rows, strict=True)}
    assert back == want
    assert near_prints(prints.limit(0), prints, radius, blocks).count() == 0


def test_masks_cover_every_choice():
    for radius, blocks in ((4, 6), (1, 2)):
        masks = [(a & (1 << 64) - 1) | (b & (1 << 64) - 1) << 64 for a, b in block_masks(radius, blocks)]
        rng = random.Random(3)
        for _ in range(200):
            x = sum(1 << k for k in rng.sample(range(BITS), radius))
            assert any(not x & m for m in masks)
