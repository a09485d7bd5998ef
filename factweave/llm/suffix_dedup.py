"""Suffix-array dedup: every byte that a string of 200 bytes covers, when that string starts anywhere else, goes.

Each window of 200 bytes is filed under one anchor inside it, the least hash of its 56-byte pieces, so equal windows
have equal anchors. The windows of one anchor make a stretch of text of some 270 bytes. Equal stretches repeat as a
whole; stretches that share an anchor but differ meet in one block, where a suffix array with common prefixes is
scanned as an interval tree for maximal repeats with all their occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factweave.functions.storage import cut
from factweave.llm.suffix_repeats import maximal_repeats
from factweave.llm.textkit import Block, blocks, mixed, slices

LENGTH, PIECE = 200, 56
# anchor, hash of the stretch, name of the text, first window, windows
ENTRY = np.dtype([("g", "<u8"), ("x", "<u8"), ("r", "<i8"), ("lo", "<i4"), ("n", "<i2")])


def anchors(block: Block, length: int = LENGTH, piece: int = PIECE, apart: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """``g, x, row, lo, n``: anchor, hash of the stretch, row, first window in the row and number of windows.

    Anchors in ``apart`` (sorted) are too frequent to meet under one key: each of their windows is a stretch by itself,
    filed under its own hash.
    """
    none = np.zeros(0, np.int64)
    if len(block.data) < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    sums, down = block.sums()
    h = mixed((sums[piece:] - sums[:-piece]) * down[: len(block.data) - piece + 1])
    low, at, reach, width = h, np.arange(len(h), dtype=np.int32), 1, length - piece + 1
    # least of 2, 4, 8 .. neighbours; the leftmost of equal ones
    while reach * 2 <= width:
        take = low[:-reach] <= low[reach:]
        at, low, reach = np.where(take, at[:-reach], at[reach:]), np.minimum(low[:-reach], low[reach:]), reach * 2
    if rest := width - reach:
        at = np.where(low[:-rest] <= low[rest:], at[:-rest], at[rest:])
    p = np.arange(len(at))
    inside = p + length <= np.repeat(block.offsets[1:], np.diff(block.offsets))[: len(at)]
    p, a = p[inside], at[inside]
    if not len(p):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    fresh = np.ones(len(p), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
    if apart is not None and len(apart):
        key = h[a]
        split = apart[np.minimum(np.searchsorted(apart, key), len(apart) - 1)] == key
        fresh |= split
        fresh[1:] |= split[:-1]
    head = np.flatnonzero(fresh)
    lo, n = p[head], np.diff(np.append(head, len(p)))
    x = mixed(slices(sums, down, lo, lo + n + (length - 1)) + (a[head] - lo).astype(np.uint64))
    g = h[a[head]]
    if apart is not None and len(apart):
        g = np.where(split[head], x, g)
    row = np.searchsorted(block.offsets, lo, "right") - 1
    return g, x, row, lo - block.offsets[row], n


def union(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint ranges in order that cover the same places; touching ones are one."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    fresh = np.ones(len(lo), bool)
    fresh[1:] = lo[1:] > hi[:-1]
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(lo) - 1)
    return lo[fresh], hi[last]


def frequent_anchors(docs: DataFrame, local: int = 32, least: int = 2000, share: int = 1000) -> tuple[np.ndarray, int]:
    """Anchors with very many different stretches, and the bytes of all texts; one pass.

    A batch names anchors with ``local`` or more different stretches; those that add up to one stretch in ``share``
    documents (and ``least``) are returned, so their number is at most ``share`` times the mean number of anchors of a
    document. They are dealt with window by window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = [], 0
            for block in blocks(batch.column("text")):
                size += len(block.data)
                g, x, *_ = anchors(block)
                found.append(np.stack([g, x]))
            both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.uint64)
            order = np.lexsort((both[1], both[0]))
            g, x = both[0][order], both[1][order]
            fresh = np.ones(len(g), bool)
            fresh[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
            keys, many = np.unique(g[fresh], return_counts=True)
            keys, many = keys[many >= local], many[many >= local]
            yield pa.record_batch([pa.array(np.append(keys.view(np.int64), 0)), pa.array(np.append(many, batch.num_rows)), pa.array(np.append(np.zeros(len(keys), np.int64), size)), pa.array(np.append(np.zeros(len(keys), np.int32), 1).astype(np.int32))], ["g", "n", "size", "kind"])

    seen = cut(docs.select("text").mapInArrow(run, "g long, n long, size long, kind int").groupBy("kind", "g").agg(F.sum("n").alias("n"), F.sum("size").alias("size")))
    n_docs, size = seen.where("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    often = seen.where("kind = 0").where(F.col("n") >= max(least, n_docs // share)).select("g").toPandas()
    return np.sort(often["g"].to_numpy(np.int64).view(np.uint64)), size


def stretch_rows(docs: DataFrame, apart: np.ndarray, fragments: int) -> DataFrame:
    """Kind 0: ``f, entries``, the stretches of one Arrow batch for one fragment, packed. Kind 1: ``f, r, entries``, byte
    ranges of a text that are repeated already inside the batch, packed as pairs; all of a text go to one fragment.

    Equal texts and equal stretches of a batch are sent on once, so frequent ones do not pile up in a fragment.
    """
    shared = docs.sparkSession.sparkContext.broadcast(apart)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("r").to_numpy(zero_copy_only=False)
            once, times = np.unique(names, return_index=True, return_counts=True)[1:]
            text = batch.column("text").take(pa.array(np.sort(once)))
            names_once = names[np.sort(once)]
            twice = set(names[once[times > 1]].tolist())
            found, whole_r, whole_size = [], [], []
            for block in blocks(text):
                g, x, row, lo, n = anchors(block, apart=shared.value)
                e = np.empty(len(g), ENTRY)
                e["g"], e["x"], e["r"], e["lo"], e["n"] = g, x, names_once[block.first + row], lo, n
                found.append(e)
                for k in range(block.rows):
                    size = int(block.offsets[k + 1] - block.offsets[k])
                    if size >= LENGTH and int(names_once[block.first + k]) in twice:
                        whole_r.append(int(names_once[block.first + k]))
                        whole_size.append(size)
            if not found:
                continue
            e = np.concatenate(found)
            e = e[np.lexsort((e["x"], e["g"]))]
            head = np.ones(len(e), bool)
            head[1:] = (e["g"][1:] != e["g"][:-1]) | (e["x"][1:] != e["x"][:-1])
            group = np.cumsum(head) - 1
            many = np.bincount(group, minlength=1)[group] > 1 if len(e) else head
            kept, again = e[head], e[many]
            f = (kept["g"] % np.uint64(fragments)).astype(np.int32)
            order = np.argsort(f, kind="stable")
            kept, f = kept[order], f[order]
            keys, at = np.unique(f, return_index=True)
            ends = np.append(at, len(kept))[1:].tolist()
            packed = [kept[a:b].tobytes() for a, b in zip(at.tolist(), ends, strict=True)]
            r = np.concatenate([again["r"], np.array(whole_r, np.int64)])
            lo = np.concatenate([again["lo"].astype(np.int64), np.zeros(len(whole_r), np.int64)])
            hi = np.concatenate([again["lo"].astype(np.int64) + again["n"] + (LENGTH - 1), np.array(whole_size, np.int64)])
            order = np.argsort(r, kind="stable")
            r, lo, hi = r[order], lo[order], hi[order]
            texts, start = np.unique(r, return_index=True)
            ranges = [np.stack(union(lo[a:b], hi[a:b]), axis=1).astype("<i4").tobytes() for a, b in zip(start.tolist(), np.append(start, len(r))[1:].tolist(), strict=True)]
            none = len(ranges)
            yield pa.RecordBatch.from_arrays([
                pa.array([0] * len(packed) + [1] * none, pa.int32()),
                pa.array(np.concatenate([keys, texts % fragments]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(len(packed), np.int64), texts])),
                pa.array(packed + ranges, pa.binary()),
            ], ["kind", "f", "r", "entries"])

    return docs.select("r", "text").mapInArrow(run, "kind int, f int, r long, entries binary")


def met(rows: DataFrame) -> DataFrame:
    """Kind 1: ``r, lo, hi``, byte ranges of stretches that are equal. Kind 0: ``g, r, lo, n``, one stretch of each sort
    under an anchor that has several sorts."""

    def run(table: pa.Table) -> pa.Table:
        packs, kinds, names = table.column("entries").to_pylist(), table.column("kind").to_numpy(), table.column("r").to_numpy()
        e = np.frombuffer(b"".join(p for p, k in zip(packs, kinds, strict=True) if not k), ENTRY)
        early = [np.frombuffer(p, "<i4").reshape(-1, 2) for p, k in zip(packs, kinds, strict=True) if k]
        ranges = np.empty(sum(map(len, early)), [("r", "<i8"), ("lo", "<i4"), ("hi", "<i4")])
        if early:
            ranges["r"] = np.repeat(names[kinds == 1], list(map(len, early)))
            ranges["lo"], ranges["hi"] = np.concatenate(early).T
        e = e[np.lexsort((e["x"], e["g"]))]
        new_g = np.ones(len(e), bool)
        new_g[1:] = e["g"][1:] != e["g"][:-1]
        new_x = new_g.copy()
        new_x[1:] |= e["x"][1:] != e["x"][:-1]
        g, x = np.cumsum(new_g) - 1, np.cumsum(new_x) - 1
        equal = e[np.bincount(x)[x] > 1]
        late = np.empty(len(equal), ranges.dtype)
        late["r"], late["lo"], late["hi"] = equal["r"], equal["lo"], equal["lo"] + equal["n"] + np.int32(LENGTH - 1)
        equal = np.unique(np.concatenate([ranges, late]))
        sorts = np.bincount(g[new_x])
        other = e[(sorts[g] > 1) & new_x]
        a, b = len(other), len(equal)
        return pa.table({
            "kind": np.concatenate([np.zeros(a, np.int32), np.ones(b, np.int32)]),
            "g": np.concatenate([other["g"].astype(np.uint64).view(np.int64), np.zeros(b, np.int64)]),
            "r": np.concatenate([other["r"], equal["r"]]),
            "lo": np.concatenate([other["lo"], equal["lo"]]),
            "hi": np.concatenate([other["n"].astype(np.int32), equal["hi"]]),
        })

    return rows.groupBy("f").applyInArrow(run, "kind int, g long, r long, lo int, hi int")


def cut_out(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``g, n, before, bytes`` for the places (``r, least, places``) of one row per text."""
    at = F.struct("g", "lo", F.col("hi").alias("n"))
    wanted = places.groupBy(F.col("r").alias("of"), "least").agg(F.collect_list(at).alias("places"))
    held = docs.join(wanted, (docs["r"] == wanted["of"]) & docs["doc_id"].eqNullSafe(wanted["least"])).select("r", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                g, n, before, r, lo, out = [], [], [], [], [], []
                for name, text, spots in zip(part.column("r").to_pylist(), part.column("text").cast(pa.large_binary()).to_pylist(), part.column("places").to_pylist(), strict=True):
                    for s in spots:
                        g.append(s["g"])
                        n.append(s["n"])
                        r.append(name)
                        lo.append(s["lo"])
                        before.append(text[s["lo"] - 1] if s["lo"] else -1)
                        out.append(text[s["lo"] : s["lo"] + s["n"] + LENGTH - 1])
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(n, pa.int32()), pa.array(before, pa.int32()), pa.array(r, pa.int64()), pa.array(lo, pa.int32()), pa.array(out, pa.binary())], ["g", "n", "before", "r", "lo", "bytes"])

    return held.mapInArrow(run, "g long, n int, before int, r long, lo int, bytes binary")


def repeat_groups(stretches: DataFrame, fragments: int, merged: bool = False) -> DataFrame:
    """``repeat_id, r, lo, hi``: maximal repeats of the stretches that meet in a block, each with all its occurrences there.

    Maximal repeats nest, so their occurrences can be many more than the stretches; with ``merged`` the block gives the
    disjoint byte ranges that they cover in each text instead, and repeat_id is 0.
    """

    def run(table: pa.Table) -> pa.Table:
        texts = table.column("bytes").to_pylist()
        col = lambda c: table.column(c).to_numpy().astype(np.int64)
        # an anchor's stretches are compared among themselves; blocks of some anchors keep the arrays small
        g, n, before, r, lo = col("g"), col("n"), col("before"), col("r"), col("lo")
        order = np.argsort(g, kind="stable")
        sizes = np.cumsum([len(texts[i]) for i in order])
        out, start = [], 0
        ends = np.append(np.flatnonzero(g[order][1:] != g[order][:-1]) + 1, len(order))
        while start < len(order):
            base = sizes[start - 1] if start else 0
            stop = int(ends[min(max(np.searchsorted(sizes[ends - 1], base + (4 << 20), "right") - 1, np.searchsorted(ends, start, "right")), len(ends) - 1)])
            own = order[start:stop]
            group, text, at, length = maximal_repeats([texts[i] for i in own], before[own], n[own], LENGTH)
            where = own[text]
            if merged and len(group):
                # all texts on one line, far apart, so that one union serves them all
                named, of = np.unique(r[where], return_inverse=True)
                first, last = union((of << 32) + lo[where] + at, (of << 32) + lo[where] + at + length)
                out.append((np.zeros(len(first), np.int64), named[first >> 32], first & 0xFFFFFFFF, last & 0xFFFFFFFF))
                start = stop
                continue
            name = mixed(group.astype(np.uint64) + g[own[0]].astype(np.uint64)).view(np.int64) if len(group) else group
            out.append((name, r[where], lo[where] + at, lo[where] + at + length))
            start = stop
        name, r, lo, hi = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"repeat_id": name, "r": r, "lo": lo.astype(np.int32), "hi": hi.astype(np.int32)})

    return stretches.withColumn("f", F.pmod("g", F.lit(fragments))).groupBy("f").applyInArrow(run, "repeat_id long, r long, lo int, hi int")


def suffix_dedup(docs: DataFrame, text: str = "text", entry_bytes: int = 16 << 20, block_bytes: int = 4 << 20) -> DataFrame:
    """All rows and columns of ``docs`` with ``kept`` (binary, the bytes left), ``n_bytes``, ``n_removed`` and ``n_spans``.

    Texts are UTF-8 bytes, nulls are empty; matches do not cross rows and may overlap, also inside one row. Repeated
    rows are copies of each other, so from 200 bytes on nothing is left of them. Null ids are like any id. Columns of
    the added names are replaced, others kept, whatever their names; an empty table gives no rows. Long texts are cut
    into stretches like any other. A text is named by a 64-bit hash, a stretch by two.
    """
    own = docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = own.select("doc_id", F.xxhash64(whole).alias("r"), whole.alias("text"))
    apart, size = frequent_anchors(base)
    fragments = max(64, int(size * 0.017 * ENTRY.itemsize) // entry_bytes)
    both = cut(met(stretch_rows(base, apart, fragments)))
    least = base.groupBy("r").agg(F.min("doc_id").alias("least"))
    other = both.where("kind = 0").select("g", "r", "lo", "hi").join(least, "r")
    stretches = cut_out(base, other)
    n_other = both.where("kind = 0").count()
    found = cut(repeat_groups(stretches, max(64, n_other * 280 // block_bytes), merged=True).select("r", "lo", "hi"))
    every = both.where("kind = 1").select("r", "lo", "hi").unionByName(found)
    # written, so that the join has a shuffle on either side and a text of many copies can be split
    covered = cut(every.groupBy("r").agg(F.collect_set(F.struct("lo", "hi")).alias("pairs")))
    others = [c for c in own.columns if c != text]
    rest = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)), F.lit(0).alias("none"))
    row = own.select(rest.alias("rest"), F.col(f"`{text}`").cast("string").alias("text"), F.xxhash64(whole).alias("r"))
    joined = row.join(covered, "r", "left").select("rest", "text", "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, gone, spans = [], [], [], []
            for t, pairs in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                t = t or b""
                total.append(len(t))
                every = np.array([(p["lo"], p["hi"]) for p in pairs or ()], np.int64).reshape(-1, 2)
                lo, hi = union(every[:, 0], every[:, 1]) if len(every) else (every[:, 0], every[:, 1])
                edges = [0, *np.stack([lo, hi], axis=1).ravel().tolist(), len(t)]
                kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                gone.append(int((hi - lo).sum()))
                spans.append(len(lo))
            made = [pa.array(kept, pa.binary()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), batch.column("text"), *made], ["rest", "text", "kept", "n_bytes", "n_removed", "n_spans"])

    kinds = f"rest {row.schema['rest'].dataType.simpleString()}, text string, kept binary, n_bytes long, n_removed long, n_spans long"
    done = joined.mapInArrow(run, kinds)
    back = [F.col("text").cast(own.schema[text].dataType).alias(text) if c == text else F.col("rest").getField(f"c{others.index(c)}").alias(c) for c in own.columns]
    return done.select(*back, "kept", "n_bytes", "n_removed", "n_spans")
