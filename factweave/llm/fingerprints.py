"""SimHash: terms vote on the bits of a fingerprint; permuted block tables find all fingerprints within a Hamming radius.

A text's terms are its pairs of neighbouring words, each as often as it stands there. DataFrame functions only: a term's
hash is spread over the lanes of packed sums, four counters of bits in each, so that one row a term and one hash
aggregate give all votes.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factweave.functions.storage import stored
from factweave.llm.order import in_order

BITS = 128
#: bits 0, 16, 32 and 48 of a hash; a piece has at most PIECE terms, so that no lane of 16 bits runs over
EVERY_16TH, PIECE = 0x0001000100010001, 16_384
LOW_OF_32, LOW_32 = 0x0000FFFF0000FFFF, 0xFFFFFFFF
WORD = r"[\p{L}\p{N}]+"


def term_hashes(text: Column) -> Column:
    """Hashes of the pairs of neighbouring words (letters and digits, in lower case); a single word stands for itself."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)
    of = lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))).otherwise(F.transform(w, lambda x: F.xxhash64(x)))
    return F.get(F.transform(F.array(words), of), F.lit(0))


def _lanes(h: Column) -> list[Column]:
    return [F.shiftrightunsigned(h, j).bitwiseAND(F.lit(EVERY_16TH)) for j in range(16)]


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, f1, f2``: the 128 bits of each row's text as two longs; a bit is set if more than half of the terms have it.

    ``keys`` tell the rows apart. A text without words (null, empty) has no votes and the fingerprint zero; a text of
    any length is counted piece by piece, whole. Where the rows are dealt by some of the keys, nothing is shuffled.
    """
    hashes = F.coalesce(term_hashes(F.col(text)), F.array().cast("array<bigint>"))
    terms = texts.select(*keys, F.posexplode(F.when(F.size(hashes) > 0, hashes).otherwise(F.array(F.lit(None).cast("long")))).alias("i", "h1"))
    terms = terms.select(*keys, F.floor(F.col("i") / PIECE).alias("piece"), "h1", F.when(F.col("h1").isNotNull(), F.xxhash64("h1")).alias("h2"))
    sums = [F.sum(lane).alias(f"{h}_{j}") for h in ("h1", "h2") for j, lane in enumerate(_lanes(F.col(h)))]
    pieces = terms.groupBy(*keys, "piece").agg(F.count("h1").alias("n"), *sums)
    # two lanes of 32 bits in a sum: those of the even and of the odd lanes before
    wide = [F.sum(F.shiftrightunsigned(F.coalesce(F.col(f"{h}_{j}"), F.lit(0)), 16 * odd).bitwiseAND(F.lit(LOW_OF_32))).alias(f"{h}_{j}_{odd}") for h in ("h1", "h2") for j in range(16) for odd in (0, 1)]
    votes = pieces.groupBy(*keys).agg(F.sum("n").alias("n"), *wide)

    def word(h: str) -> Column:
        bits = []
        for j in range(16):
            for odd in (0, 1):
                two = F.col(f"{h}_{j}_{odd}")
                for at, count in ((j + 16 * odd, two.bitwiseAND(F.lit(LOW_32))), (j + 16 * odd + 32, F.shiftrightunsigned(two, 32))):
                    bits.append(F.when(count * 2 > F.col("n"), F.lit(1 << at if at < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    return votes.select(*keys, word("h1").alias("f1"), word("h2").alias("f2"))


def as_hex(f1: Column, f2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f2), 16, "0"), F.lpad(F.hex(f1), 16, "0")))


def apart(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """The Hamming distance of two fingerprints."""
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def likeness(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1 - apart(a1, a2, b1, b2) / F.lit(float(BITS))


def block_masks(radius: int, blocks: int) -> list[tuple[int, int]]:
    """The tables: for each choice of ``blocks - radius`` blocks a mask of their bits, as signed longs for f1 and f2.

    Fingerprints that differ in ``radius`` bits at most agree on all bits of one choice at least.
    """
    edges = [BITS * b // blocks for b in range(blocks + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    whole = [sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in choice) for choice in combinations(range(blocks), blocks - radius)]
    return [(signed(m & (1 << 64) - 1), signed(m >> 64)) for m in whole]


def near_prints(prints: DataFrame, queries: DataFrame, radius: int = 4, blocks: int = 6, chunk: int = 256) -> DataFrame:
    """For each query ``f1, f2`` rows with ``near``, arrays of prints ``f1, f2, n`` within ``radius`` bits, itself included if it is one.

    ``prints`` has distinct ``f1, f2`` and ``n`` (how many documents have it); a query's arrays together hold each print once.
    Every print is filed once a table under the bits that the table keeps. A bucket, however large, is cut into chunks;
    the queries of a bucket meet its chunks, so there is one row for a chunk and ``chunk`` queries, and pairs are only
    made inside. Queries without a print near have no row, and so have empty tables.
    """
    masks = block_masks(radius, blocks)
    filed = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), F.col("f1").bitwiseAND(F.lit(a)), F.col("f2").bitwiseAND(F.lit(b))).alias("key")) for t, (a, b) in enumerate(masks)))).alias("in")
    asked = queries.select("f1", "f2").distinct().select("f1", "f2", filed).select("f1", "f2", "in.t", "in.key")
    held = stored(prints.select("f1", "f2", "n", filed).select("f1", "f2", "n", "in.key").join(asked.select("key").distinct(), "key", "left_semi"))
    sizes = held.groupBy("key").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    some = lambda n: F.pmod(F.xxhash64("f1", "f2"), n)
    chunks = held.join(sizes, "key").groupBy("key", some(F.col("chunks")).alias("part")).agg(F.collect_list(F.struct("f1", "f2", "n")).alias("prints"))
    of_key = asked.groupBy("key").agg(F.ceil(F.count("*") / chunk).alias("own"))
    groups = asked.join(of_key, "key").groupBy("key", "t", some(F.col("own")).alias("own")).agg(F.collect_list(F.struct("f1", "f2")).alias("queries"))
    meet = groups.join(sizes, "key").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).join(chunks, ["key", "part"])
    table = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in masks))
    rows = meet.select("t", "prints", F.explode("queries").alias("q"))
    same_bits = lambda x, m: (x["f1"].bitwiseXOR(F.col("q.f1")).bitwiseAND(m["a"]) == 0) & (x["f2"].bitwiseXOR(F.col("q.f2")).bitwiseAND(m["b"]) == 0)
    # a pair that several tables hold is told by the first of them
    first = lambda x: same_bits(x, F.get(table, F.col("t"))) & ~F.exists(F.slice(table, 1, F.col("t")), lambda m: same_bits(x, m))
    near = F.filter("prints", lambda x: F.when(apart(x["f1"], x["f2"], F.col("q.f1"), F.col("q.f2")) <= radius, first(x)).otherwise(F.lit(False)))
    return rows.select("q.f1", "q.f2", near.alias("near")).where(F.size("near") > 0)


def next_keys(docs: DataFrame) -> DataFrame:
    """``doc, print, n_chars, copies, next_doc, next_print``: each document and the next one in descending ``doc_id``.

    A document is named by ``doc`` (its id, 0 for null) and ``print`` (a hash of its text, and of whether it has an id).
    Documents of one id stand in the order of ``print``, null ids last; after the last comes the first. Repeated rows are
    one document. Only names are sorted, not texts.
    """
    names = stored(docs.groupBy("doc_id", "doc", "print").agg(F.min("n_chars").alias("n_chars"), F.count("*").alias("copies")))
    placed = in_order(names, F.col("doc_id").desc_nulls_last(), F.col("print"))
    # one row a range: as many as there are partitions
    firsts = placed.groupBy("part").agg(F.min_by(F.struct("doc", "print"), "place").alias("first")).orderBy("part").collect()
    after = [(r["part"], *firsts[(i + 1) % len(firsts)]["first"]) for i, r in enumerate(firsts)]
    turn = F.broadcast(docs.sparkSession.createDataFrame(after, "part long, first_doc long, first_print long"))
    lead = F.lead(F.struct("doc", "print")).over(Window.partitionBy("part").orderBy("place"))
    linked = placed.withColumn("next", lead).join(turn, "part")
    return linked.select("doc_id", "doc", "print", "n_chars", "copies", F.coalesce("next.doc", "first_doc").alias("next_doc"), F.coalesce("next.print", "first_print").alias("next_print"))


def fingerprint_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each document with its fingerprint, that of its edited text and that of the next document in descending ``doc_id``.

    ``doc_id, n_chars, edited_sha256, f1, f2, edited_f1, edited_f2, next_f1, next_f2``, a row for each row of ``docs``.
    The edited text has its last half replaced by the beginning of the next document. Null texts are empty; equal texts
    have equal fingerprints; repeated rows (same id, same text) are one document and get the same result; ties of ids go by
    a hash of the text, null ids stand last; the next of a single document is itself. Texts of any length are read
    whole; other columns, whatever their names, are not read; an empty table gives no rows.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select("doc_id", body.alias("text")).select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("print"), "text")
    links = stored(next_keys(rows.select("doc_id", "doc", "print", F.char_length("text").alias("n_chars"))))
    # texts go to the place of their name once; from there the beginning that the document before needs goes to that one's
    texts = rows.select("doc", "print", "text").dropDuplicates(["doc", "print"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    wanted = links.select(F.col("next_doc").alias("doc"), F.col("next_print").alias("print"), F.col("doc").alias("to_doc"), F.col("print").alias("to_print"), half.alias("half"))
    tails = texts.join(wanted, ["doc", "print"]).select(F.col("to_doc").alias("doc"), F.col("to_print").alias("print"), F.left("text", F.col("half")).alias("tail"))
    both = texts.join(links.select("doc", "print", "n_chars"), ["doc", "print"]).join(tails, ["doc", "print"])
    edited = both.select("doc", "print", "text", F.concat(F.left("text", F.col("n_chars") - half), "tail").alias("edited"))
    sides = edited.select("doc", "print", F.sha2("edited", 256).alias("sha"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))).alias("s")).select("doc", "print", "sha", "s.side", "s.text")
    voted = fingerprints(sides, ["doc", "print", "sha", "side"])
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    prints = stored(voted.groupBy("doc", "print", "sha").agg(of(0, "f1").alias("f1"), of(0, "f2").alias("f2"), of(1, "f1").alias("edited_f1"), of(1, "f2").alias("edited_f2")))
    follows = prints.select(F.col("doc").alias("next_doc"), F.col("print").alias("next_print"), F.col("f1").alias("next_f1"), F.col("f2").alias("next_f2"))
    done = links.join(prints, ["doc", "print"]).join(follows, ["next_doc", "next_print"])
    return done.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), "f1", "f2", "edited_f1", "edited_f2", "next_f1", "next_f2")
