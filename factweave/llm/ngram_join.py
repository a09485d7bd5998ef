"""N-gram Jaccard join by vertical partitioning.

All shingles stand in one global order: the rare ones by hash, the frequent ones behind them, rarest first. The order is
cut into fragments. Equal sets are one class from the start. Two sets that are similar enough share a shingle among the
first quarter of each, so the fragments propose pairs from these; a pair is decided by the overlaps of all fragments of
the two whole sets, counted fragment by fragment and summed per pair.

A group of many near copies is not spread into all its pairs. In the first round each set meets the least holder of its
shingles; in the next ones the holders of a shingle that are still apart meet a few holders of the least component
there; in the last all holders that are still in different components meet, so that no link is lost. Sizes, places and
a short bitmap of both sets are compared where they meet, so that a row stands only for what may be linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factweave.functions.storage import cut, released, stored
from factweave.llm.shingles import set_print, shingle_sets
from factweave.llm.textkit import blocks
from factweave.operators.components import connected_components

#: links are pairs with 100 * intersection >= PERCENT * union
PERCENT = 75
HOT = np.uint64(1 << 63)
#: at most so many shingles stand behind the rare ones, which bounds the table of them that all tasks receive (8 bytes each)
MOST_FREQUENT = 1 << 21
#: rounds before the last, each with the share of places that take part (one in so many), the holders of the least
#: component that the others of such a place meet, and whether a set then tries only the one it meets most often
ROUNDS = ((1, 3, True), (2, 16, False))
#: rows of 64 bits in the table that tells tasks which texts to read again
WORDS_OF_BITS = 1 << 18
#: a pair with its lesser name first
IN_ORDER = [f"if(a < b, {x}, {y}) as {x}" for x, y in (("a", "b"), ("na", "nb"), ("b", "a"), ("nb", "na"))]
ENTRY = np.dtype([("o", "<u8"), ("c", "<i8"), ("n", "<i4"), ("i", "<i4")])


def prefix_length(n):
    """So many of the first shingles of a set of n hold one of any set that is similar enough."""
    return n + n * PERCENT // -100 + 1


def needed(a, b):
    """The overlap that sets of these sizes need (for columns or arrays)."""
    x = PERCENT * (a + b) + 99 + PERCENT
    return F.floor(x / F.lit(100.0 + PERCENT)) if isinstance(a, Column) else x // (100 + PERCENT)


def may_link(na, i, nb, j):
    """Whether sets of sizes ``na, nb`` can be similar enough if the first shingle they share has the places ``i, j`` in them."""
    lower, low, high = (F.least, F.least(na, nb), F.greatest(na, nb)) if isinstance(na, Column) else (np.minimum, np.minimum(na, nb), np.maximum(na, nb))
    return (100 * low >= PERCENT * high) & (lower(na - i, nb - j) >= needed(na, nb))


def parities(s: np.ndarray) -> bytes:
    """A bitmap of one or two bits a shingle (64 at least): whether the set has an odd number of shingles of each class of hashes."""
    size = max(64, 1 << max(0, len(s) - 1).bit_length())
    return np.packbits(np.bincount((s >> np.uint64(8) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def short_parities(s: np.ndarray) -> list[int]:
    """The same in 256 bits, as four longs, whatever the size of the set."""
    return np.packbits(np.bincount((s >> np.uint64(8) & np.uint64(255)).astype(np.int64), minlength=256) & 1).view(np.int64).tolist()


def least_difference(x: bytes, y: bytes) -> int:
    """Two sets differ in so many shingles at least as their bitmaps do in bits; the longer bitmap is folded."""
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(b, np.uint8).reshape(-1, size), axis=0) for b in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def prints(docs: DataFrame, local: int = 3) -> DataFrame:
    """One pass over the texts: rows of kind 0 with ``doc_id, th``, size ``n``, name ``c`` and both bitmaps of the set, and of kind
    1 with ``c, n`` for shingles that ``local`` or more different sets of one Arrow batch hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, maps, short, seen, sets = [], [], [], [], {}, []
            for block in blocks(batch.column("text")):
                for s in shingle_sets(block):
                    name = set_print(s)
                    if name not in seen:
                        seen[name] = parities(s), short_parities(s)
                        sets.append(s)
                    n.append(len(s))
                    names.append(name)
                    maps.append(seen[name][0])
                    short.append(seen[name][1])
            whole = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            sets.clear()
            whole.sort()
            # equal ones are neighbours: local of them in a row
            often = np.unique(whole[local - 1 :][whole[local - 1 :] == whole[: len(whole) - local + 1]]) if len(whole) >= local else whole[:0]
            count = np.searchsorted(whole, often, "right") - np.searchsorted(whole, often, "left")
            more, none = len(often), pa.nulls(len(often), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([0, 1], np.int32), [len(n), more])),
                    pa.concat_arrays([batch.column("doc_id").cast(pa.int64()), none]),
                    pa.concat_arrays([batch.column("th").cast(pa.int64()), none]),
                    pa.array(np.concatenate([np.array(n, np.int64), count])),
                    pa.array(np.concatenate([np.array(names, np.int64), often.view(np.int64)])),
                    pa.array([*maps, *[None] * more], pa.binary()),
                    pa.array([*short, *[None] * more], pa.list_(pa.int64())),
                ],
                ["kind", "doc_id", "th", "n", "c", "map", "short"],
            )

    return docs.mapInArrow(run, "kind int, doc_id long, th long, n long, c long, map binary, short array<long>")


class Order:
    """The global order of shingles, and its fragments."""

    def __init__(self, frequent: np.ndarray, fragments: int, salts: int):
        """``frequent``: rarest first. A place of the frequent ones is dealt to ``salts`` fragments, since any share of all sets may hold it."""
        self.by_hash = np.argsort(frequent)
        self.frequent, self.fragments, self.salts = frequent[self.by_hash], fragments, salts

    def places(self, s: np.ndarray) -> np.ndarray:
        """Places of shingles, ascending."""
        o = s >> np.uint64(1)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, s), len(self.frequent) - 1)
            o = np.where(self.frequent[at] == s, self.by_hash[at].astype(np.uint64) | HOT, o)
        return np.sort(o)

    def fragment(self, o: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Three quarters of the fragments are for the part of the rare ones where first quarters lie."""
        low = self.fragments * 3 // 4
        rest = self.fragments - low
        x = o.astype(np.float64) / float(1 << 63)
        rare = np.where(x < 0.27, x / 0.27 * low, low + (x - 0.27) / 0.73 * rest).astype(np.int64).clip(0, self.fragments - 1)
        salt = (c % self.salts).astype(np.uint64)
        return np.where(o >= HOT, self.fragments + (((o - HOT) * np.uint64(self.salts) + salt) % np.uint64(max(rest, self.salts))).astype(np.int64), rare)


def fragment_rows(docs: DataFrame, order: Order) -> DataFrame:
    """``f, entries``: for each 2,048 texts and fragment the entries (place, set, size, rank in the set) of the sets' first shingles, packed."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text in (batch.column("text").slice(i, 2048) for batch in batches for i in range(0, batch.num_rows, 2048)):
            found, seen = [], set()
            for block in blocks(text):
                for s in shingle_sets(block):
                    if len(s) and (name := set_print(s)) not in seen:
                        seen.add(name)
                        first = shared.value.places(s)[: prefix_length(len(s))]
                        entries = np.empty(len(first), ENTRY)
                        entries["o"], entries["c"], entries["n"], entries["i"] = first, name, len(s), np.arange(len(first))
                        found.append(entries)
            if not found:
                continue
            whole = np.concatenate(found)
            f = shared.value.fragment(whole["o"], whole["c"])
            by_fragment = np.argsort(f, kind="stable")
            whole, f = whole[by_fragment], f[by_fragment]
            keys, at = np.unique(f, return_index=True)
            ends = [*at[1:].tolist(), len(whole)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([whole[a:b].tobytes() for a, b in zip(at.tolist(), ends, strict=True)], pa.binary())], ["f", "entries"])

    return docs.select("text").mapInArrow(run, "f long, entries binary")


def shared_entries(rows: DataFrame) -> DataFrame:
    """Kind 1: ``a, na, b, nb, k``, each holder ``b`` of a place with its least holder ``a``, and at how many places of the
    fragment; kind 0: ``o, a, na, i``, the holders of places that have three or more. A fragment of frequent ones may
    lack holders of its places, so all these are returned."""

    def run(table: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(table.column("entries").to_pylist()), ENTRY)
        e = e[np.lexsort((e["c"], e["o"]))]
        fresh = np.ones(len(e), bool)
        fresh[1:] = (e["o"][1:] != e["o"][:-1]) | (e["c"][1:] != e["c"][:-1])
        e = e[fresh]
        head = np.ones(len(e), bool)
        head[1:] = e["o"][1:] != e["o"][:-1]
        group = np.cumsum(head) - 1
        held = e[(np.bincount(group, minlength=1)[group] > 2) | (e["o"] >= HOT)]
        pivot, other = e[np.flatnonzero(head)[group[~head]]], e[~head]
        fits = may_link(pivot["n"].astype(np.int64), pivot["i"], other["n"].astype(np.int64), other["i"])
        pairs = np.empty(int(fits.sum()), [("a", "<i8"), ("b", "<i8"), ("na", "<i4"), ("nb", "<i4")])
        pairs["a"], pairs["b"], pairs["na"], pairs["nb"] = pivot["c"][fits], other["c"][fits], pivot["n"][fits], other["n"][fits]
        pairs, k = np.unique(pairs, return_counts=True)
        m, p = len(held), len(pairs)
        both = lambda x, y: pa.array(np.concatenate([np.asarray(x, np.int64), np.asarray(y, np.int64)]))
        none = lambda n: np.zeros(n, np.int64)
        return pa.table({
            "kind": pa.array(np.repeat(np.array([0, 1], np.int32), [m, p])),
            "o": both(held["o"].astype(np.uint64).view(np.int64), none(p)), "i": both(held["i"], none(p)),
            "a": both(held["c"], pairs["a"]), "na": both(held["n"], pairs["na"]),
            "b": both(none(m), pairs["b"]), "nb": both(none(m), pairs["nb"]), "k": both(none(m), k),
        })

    return rows.groupBy("f").applyInArrow(run, "kind int, o long, i long, a long, na long, b long, nb long, k long")


def near_by_bitmap(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b, na, nb`` of the pairs whose bitmaps allow a link."""
    maps = classes.select("c", "map")
    one = pairs.select("a", "b", "na", "nb").join(maps.withColumnsRenamed({"c": "a"}), "a")
    both = one.join(maps.withColumnsRenamed({"c": "b", "map": "map_b"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = np.array([least_difference(x, y) for x, y in zip(batch.column("map").to_pylist(), batch.column("map_b").to_pylist(), strict=True)], np.int64)
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            keep = pa.array((na + nb - differ) // 2 >= needed(na, nb))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in ("a", "b", "na", "nb")], ["a", "b", "na", "nb"])

    return both.mapInArrow(run, "a long, b long, na long, nb long")


def set_fragments(names: DataFrame, classes: DataFrame, docs: DataFrame, parts: int) -> DataFrame:
    """``c, part, held``: the whole sets of these names, cut into ``parts`` fragments of the order by hash.

    One text of each set is read again. A bitmap of fixed size (WORDS_OF_BITS) tells which texts these are; when they
    are very many it lets others through, which are then dropped by name.
    """
    hashes = classes.join(names, "c").select("th")
    word, bit = F.col("th").bitwiseAND(WORDS_OF_BITS - 1).alias("word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(th, 18) & 63L as int))")
    bits = cut(hashes.groupBy(word).agg(F.bit_or(bit).alias("bits")))
    wanted = docs.withColumn("word", word).join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(bit) != 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, seen = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64), set()
        for batch in batches:
            for block in blocks(batch.column("text")):
                c, part, held = [], [], []
                for s in shingle_sets(block):
                    if len(s) and (name := set_print(s)) not in seen:
                        seen.add(name)
                        edges = [0, *np.searchsorted(s, bounds).tolist(), len(s)]
                        for k in range(parts):
                            c.append(name)
                            part.append(k)
                            held.append(s[edges[k] : edges[k + 1]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(part, pa.int32()), pa.array(held, pa.binary())], ["c", "part", "held"])

    return wanted.select("text").mapInArrow(run, "c long, part int, held binary").join(names, "c", "left_semi").dropDuplicates(["c", "part"])


def overlaps(pairs: DataFrame, classes: DataFrame, docs: DataFrame, parts: int = 4) -> DataFrame:
    """``a, b, both``: the whole overlap of each pair of sets, counted fragment by fragment and summed."""
    names = cut(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct())
    sets = stored(set_fragments(names, classes, docs, parts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = [], []
            for side in ("held", "held_b"):
                raw = batch.column(side).to_pylist()
                values.append(np.frombuffer(b"".join(raw), np.uint64))
                rows.append(np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw]))
            row, value = np.concatenate(rows), np.concatenate(values)
            by_row = np.lexsort((value, row))
            row, value = row[by_row], value[by_row]
            twice = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
            both = np.bincount(row[1:][twice], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both, pa.int64())], ["a", "b", "both"])

    one = pairs.select("a", "b").join(sets.withColumnRenamed("c", "a"), "a")
    two = one.join(sets.select(F.col("c").alias("b"), "part", F.col("held").alias("held_b")), ["b", "part"])
    return two.select("a", "b", "held", "held_b").mapInArrow(count, "a long, b long, both long").groupBy("a", "b").agg(F.sum("both").alias("both"))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``a, b`` of the pairs that are links."""
    pairs = cut(near_by_bitmap(pairs, classes))
    found = overlaps(pairs, classes, docs)
    linked = 100 * F.col("both") >= PERCENT * (F.col("na") + F.col("nb") - F.col("both"))
    return released(pairs.join(found, ["a", "b"]).where(linked).select("a", "b"))


def bits_allow(na: Column, short: list[Column], nb: Column, short_b: list[Column]) -> Column:
    """Whether the short bitmaps of two sets differ in no more bits than linked sets of these sizes may in shingles."""
    differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(short, short_b, strict=True)), F.lit(0))
    return differ <= na + nb - 2 * needed(na, nb)


def labelled(entries: DataFrame, components: DataFrame) -> DataFrame:
    """``o, a, na, i, label`` of the holders of places that are in two components or more."""
    near = components.select(F.col("node").alias("a"), "component")
    rows = entries.join(near, "a", "left").select("o", "a", "na", "i", F.coalesce("component", "a").alias("label"))
    open_places = rows.groupBy("o").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("o")
    return stored(rows.join(open_places, "o"))


def best_of(pairs: DataFrame) -> DataFrame:
    """Of each ``b`` the pair with the most places ``k``, and then the least ``a``."""
    best = pairs.groupBy("b").agg(F.max(F.struct("k", (-F.col("a")).alias("x"), "na", "nb")).alias("t"))
    return best.select((-F.col("t.x")).alias("a"), F.col("t.na").alias("na"), "b", F.col("t.nb").alias("nb"))


def ngram_components(docs: DataFrame, text: str = "text", fragment_bytes: int = 24 << 20) -> DataFrame:
    """``doc_id, th, n, label, component_id`` for every row: hash of the text, size of the set, a name of its component (null
    without shingles), and what ``ngram_jaccard_join`` says of it."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    base = base.withColumn("th", F.xxhash64("text"))
    first = stored(prints(base))
    rows = first.where("kind = 0").select("doc_id", "th", "n", "c")
    n_docs, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    often = first.where("kind = 1").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(MOST_FREQUENT)
    found = often.toPandas().sort_values(["n", "c"])
    classes = stored(first.where("kind = 0 and n > 0").groupBy("c").agg(F.min("doc_id").alias("least"), F.min("th").alias("th"), F.first("map").alias("map"), F.first("short").alias("short")))

    fragments = max(64, int(total * ENTRY.itemsize * 0.27) // fragment_bytes)
    order = Order(found["c"].to_numpy(np.int64).view(np.uint64), fragments, 1 + n_docs * ENTRY.itemsize // fragment_bytes)
    shared = stored(shared_entries(fragment_rows(base, order)))
    stars = stored(shared.where("kind = 1").groupBy("a", "na", "b", "nb").agg(F.sum("k").alias("k")))

    # each set with one holder of its places
    fresh = cut(best_of(stars).selectExpr(*IN_ORDER))
    links, tried = verified(fresh, classes, base), fresh.select("a", "b")
    # those of a place that are still apart with some of its least component
    left = shared.where("kind = 0").select("o", "a", "na", "i")
    for k, (one_in, holders, best) in enumerate(ROUNDS):
        # labels that are not settled yet only leave more to try
        left = labelled(left, connected_components(links, rounds=2, settle=False))
        here = left.where(F.pmod(F.xxhash64("o", F.lit(k)), F.lit(one_in)) == 0)
        by_chance = F.xxhash64("a", F.lit(k))
        pivot = here.groupBy("o", F.pmod(by_chance, F.lit(holders)).alias("h")).agg(F.min(F.struct("label", by_chance.alias("x"), "a", "na", "i")).alias("p"))
        meet = here.join(pivot, "o").where((F.col("label") != F.col("p.label")) & may_link(F.col("na"), F.col("i"), F.col("p.na"), F.col("p.i")))
        pairs = meet.groupBy(F.col("p.a").alias("a"), F.col("p.na").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")).agg(F.count("*").alias("k"))
        fresh = cut((best_of(pairs) if best else pairs).selectExpr(*IN_ORDER).distinct().join(tried, ["a", "b"], "left_anti"))
        links = cut(links.unionByName(verified(fresh, classes, base)))
        tried = cut(tried.unionByName(fresh.select("a", "b")))
        left = left.drop("label")
    # all that are still apart, and what the first round put off
    components = connected_components(links)
    bits = [f"s{k}" for k in range(4)]
    left = labelled(left, components).join(classes.select(F.col("c").alias("a"), *(F.col("short")[k].alias(x) for k, x in enumerate(bits))), "a")
    other = left.select("o", *(F.col(k).alias(f"{k}_b") for k in ("a", "na", "i", "label", *bits)))
    fits = (F.col("a") < F.col("a_b")) & (F.col("label") != F.col("label_b")) & may_link(F.col("na"), F.col("i"), F.col("na_b"), F.col("i_b"))
    fits &= bits_allow(F.col("na"), [F.col(x) for x in bits], F.col("na_b"), [F.col(f"{x}_b") for x in bits])
    pairs = left.join(other, "o").where(fits).select("a", "na", F.col("a_b").alias("b"), F.col("na_b").alias("nb"))
    ends = components.select(F.col("node").alias("a"), F.col("component").alias("label"))
    put_off = stars.select("a", "na", "b", "nb").join(ends, "a", "left").join(ends.withColumnsRenamed({"a": "b", "label": "label_b"}), "b", "left")
    put_off = put_off.where(F.coalesce("label", "a") != F.coalesce("label_b", "b")).select("a", "na", "b", "nb")
    pairs = pairs.unionByName(put_off.selectExpr(*IN_ORDER)).distinct().join(tried, ["a", "b"], "left_anti")
    links = links.unionByName(verified(cut(pairs), classes, base))

    joined = connected_components(links)
    least = joined.join(classes.select("c", "least"), F.col("node") == F.col("c")).groupBy("component").agg(F.min("least").alias("low"))
    # written, so that the last join has a shuffle on either side and a set of many copies can be split
    of_class = classes.select("c", "least").join(joined.select(F.col("node").alias("c"), "component"), "c", "left").join(least, "component", "left")
    of_class = cut(of_class.select("c", F.coalesce("component", "c").alias("label"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("low")).alias("component_id")))
    found = rows.join(of_class, "c", "left")
    return found.select("doc_id", "th", "n", "label", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def ngram_jaccard_join(docs: DataFrame, text: str = "text", fragment_bytes: int = 24 << 20) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``; component_id is the least id linked with it, itself included.

    Null and empty texts have no shingles and stand alone. Repeated rows are all returned, alike. A row without an id is
    linked like any other and has the least id of its component, or null. Rows that share an id but not a text are told
    apart by their sets. A very long text is one set of as many shingles as it has, and its work is in proportion. Other
    columns are ignored, whatever their names; an empty table gives no rows. Sets are named by 64 bits.

    Which shingles are frequent only moves them in the order; there are MOST_FREQUENT of them at most.
    """
    return ngram_components(docs, text, fragment_bytes).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: one row of each component stays, that of the least id (then of the least hash of its text).

    Rows without an id come after all others of their component. Rows that share an id but not a component are told apart
    and all stay. Texts without a word are linked with nothing and stay; of repeated rows (id and text alike) one stays.
    All columns are kept, whatever their names; an empty table gives no rows. Ids are compared as numbers, texts of one id
    by 64 bits.
    """
    found = ngram_components(docs, text)
    key = lambda i, th: (F.coalesce(i.cast("string"), F.lit("")).alias("i"), th.alias("t"))
    first = found.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "th")).alias("m"))
    kept = first.select(*key(F.col("m.doc_id"), F.col("m.th"))).unionByName(found.where("label is null").select(*key(F.col("doc_id"), F.col("th"))).distinct())
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *key(F.col("doc_id").cast("long"), F.xxhash64(F.col(text).cast("string"))))
    return rows.dropDuplicates(["i", "t"]).join(kept, ["i", "t"], "left_semi").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
