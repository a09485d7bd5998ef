"""Language identification, words first: a known word counts by its log frequency in each language, an unseen one by the
longest known character n-gram from each of its letters on, shorter ones where longer are not known."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from factweave.functions.storage import cut
from factweave.llm.textkit import Block, blocks, slices

GRAMS = 4
_BREAK = np.ones(256, dtype=bool)
_BREAK[97:123] = _BREAK[128:] = False
#: the letters of Unicode category L are among these, and some numbers, which str.isalpha tells apart
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


class Words:
    """The distinct words of a block, and of some of them the character n-grams."""

    def __init__(self, block: Block):
        self.block = block
        self.starts, self.ends, self.first = block.words(_BREAK[block.data])
        self.sums, self.down = block.sums()
        self.keys, self.at, self.of = np.unique(slices(self.sums, self.down, self.starts, self.ends), return_index=True, return_inverse=True)

    def grams(self, which: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For each letter of the distinct words ``which``: its word (place in ``which``), and the hashes of the n-grams
        that start there, longest first; 0 where the word is too short."""
        letters = np.append(np.flatnonzero((self.block.data & 0xC0) != 0x80), len(self.block.data))
        a, b = np.searchsorted(letters, self.starts[self.at[which]]), np.searchsorted(letters, self.ends[self.at[which]])
        size = b - a
        word = np.repeat(np.arange(len(which)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + a[word]
        out = []
        for n in range(GRAMS, 0, -1):
            far = np.minimum(place + n, b[word])
            out.append(np.where(far == place + n, slices(self.sums, self.down, letters[place], letters[far]) ^ np.uint64(n << 56), np.uint64(0)))
        return word, out


def lowered(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def training_rows(docs: DataFrame, held_out, at_most: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, text`` of about ``at_most`` documents (the documented bound of the fit) with a language, a text and an id outside the held-out fold; by a hash of the id, so alike in every run."""
    usable = docs.select("doc_id", F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = usable.select("doc_id").count()
    return usable.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) < round(1_000_000 * min(1.0, at_most / max(n, 1)))).select("lang", "text")


def counts(rows: DataFrame) -> DataFrame:
    """``lang, kind, key, n``: words (kind 0) by occurrence and n-grams (kind n) by distinct word, summed per batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch.column("lang").to_pylist()
            for lang in sorted(set(said)):
                texts = lowered(batch.column("text").filter(pa.array([x == lang for x in said])))
                for block in blocks(texts, 1 << 20):
                    w = Words(block)
                    kinds, keys, n = [np.zeros(len(w.keys), np.int32)], [w.keys], [np.bincount(w.of, minlength=len(w.keys))]
                    for k, grams in enumerate(w.grams(np.arange(len(w.keys)))[1]):
                        found, many = np.unique(grams[grams != 0], return_counts=True)
                        kinds.append(np.full(len(found), GRAMS - k, np.int32))
                        keys.append(found)
                        n.append(many)
                    kind = np.concatenate(kinds)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kind), pa.string()), pa.array(kind), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(n).astype(np.int64))], ["lang", "kind", "key", "n"])

    return rows.mapInArrow(run, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


class Model:
    """Languages in order, their log shares, and for words and n-grams the sorted keys with a row of log frequencies each."""

    def __init__(self, langs: list[str], prior: np.ndarray, tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.langs, self.prior, self.tables = langs, prior, tables

    def known(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have, rows = self.tables.get(kind, (keys[:0], np.zeros((0, len(self.langs)))))
        if not len(have):
            return np.zeros(len(keys), bool), np.zeros((len(keys), len(self.langs)))
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        hit = have[at] == keys
        return hit, np.where(hit[:, None], rows[at], 0.0)

    def evidence(self, w: Words) -> np.ndarray:
        """A row for each distinct word of the block."""
        hit, rows = self.known(0, w.keys)
        unseen = np.flatnonzero(~hit)
        if len(unseen):
            word, grams = w.grams(unseen)
            best, open_ = np.zeros((len(word), len(self.langs))), np.ones(len(word), bool)
            for k, keys in enumerate(grams):
                at = np.flatnonzero(open_ & (keys != 0))
                got, values = self.known(GRAMS - k, keys[at])
                best[at[got]] = values[got]
                open_[at[got]] = False
            size = np.bincount(word, minlength=len(unseen))
            for j in range(len(self.langs)):
                rows[unseen, j] = np.bincount(word, weights=best[:, j], minlength=len(unseen)) / np.maximum(size, 1)
        return rows


def fit(docs: DataFrame, held_out, text: str = "text", lang: str = "lang", at_most: int = 12_000, keep: int = 40_000) -> Model:
    """Fit on about ``at_most`` documents; of words and of the n-grams of each length the ``keep`` most frequent stay, which bounds the model."""
    rows = cut(training_rows(docs, held_out, at_most, text, lang))
    langs = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(langs, key=lambda x: x.encode())
    if not names:
        return Model([], np.zeros(0), {})
    table = cut(counts(rows).groupBy("kind", "key").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")))
    tables = {}
    for kind in range(GRAMS + 1):
        top = table.where((F.col("kind") == kind) & (F.col("all") >= 2)).orderBy(F.desc("all"), "key").limit(keep)
        got = top.select("key", *(F.coalesce(F.try_element_at("by", F.lit(x)), F.lit(0)).alias(f"l{i}") for i, x in enumerate(names))).toPandas()
        n = got[[f"l{i}" for i in range(len(names))]].to_numpy(float)
        p = np.log(n + 0.5) - np.log(n.sum(axis=0, keepdims=True) + 0.5 * max(len(n), 1))
        keys = got["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        tables[kind] = keys[order], (p - p.mean(axis=1, keepdims=True))[order]
    share = np.array([langs[x] for x in names], float)
    return Model(names, np.log(share / share.sum()), tables)


def language_id(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``, the share of the best language among all.

    Whole texts are read. A null text, or one without a letter, is ``und`` with score 0; so is any text when nothing
    could be learnt. Equal languages: the first by code point. Repeated rows are judged alike; columns of the added
    names are replaced; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = lowered(batch.column(text))
            pred, score = [], []
            for block in blocks(texts):
                w = Words(block)
                rows = m.evidence(w)
                total = np.zeros((len(w.of) + 1, len(m.langs)))
                np.cumsum(rows[w.of], axis=0, out=total[1:])
                sums = total[w.first[1:]] - total[w.first[:-1]] + m.prior
                sums = np.exp(sums - sums.max(axis=1, keepdims=True)) if len(m.langs) else sums
                ascii_letters = np.concatenate(([0], np.cumsum((block.data >= 97) & (block.data <= 122))))
                has = ascii_letters[block.offsets[1:]] > ascii_letters[block.offsets[:-1]]
                for r in range(block.rows):
                    if not len(m.langs) or not (has[r] or has_letter(texts[block.first + r].as_py())):
                        pred.append("und")
                        score.append(0.0)
                    else:
                        k = int(sums[r].argmax())
                        pred.append(m.langs[k])
                        score.append(float(sums[r, k] / sums[r].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInArrow(run, f"{columns}, lang_pred string, score double")
