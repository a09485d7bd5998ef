"""Messages and the atoms taken from them: splitting, connectives, chunks."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from factweave.functions.text import split_causal, split_incoherent, split_structural


def split_rows(df: DataFrame, text: str = "content") -> DataFrame:
    """One row per part, with its place."""
    return df.select("*", F.posexplode(split_incoherent(text)).alias("part", "part_text"))


def held_words(texts: list[str | None], words: list[str]) -> np.ndarray:
    """How many of the words, repeats counted, each text holds; every distinct word is looked for once in all texts in a row."""
    texts = [t or "" for t in texts]
    hits, every = np.zeros(len(texts), np.int64), "\0".join(texts)
    starts = list(accumulate((len(t) + 1 for t in texts), initial=0))
    for word, n in Counter(words).items():
        if "\0" in word:
            hits += n * np.array([word in t for t in texts], np.int64)
            continue
        at = every.find(word)
        while at >= 0:
            k = bisect_right(starts, at) - 1
            hits[k] += n
            at = every.find(word, starts[k + 1])
    return hits


def _best_atoms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each clause the atom with most of its words, the last of equal ones."""
    for batch in batches:
        place = batch.column("nth").type.value_type
        best = {side: [] for side in ("cause", "effect")}
        for i in range(batch.num_rows):
            nth, low = batch.column("nth")[i].as_py(), batch.column("low")[i].as_py()
            for side, found in best.items():
                hits = held_words(low, batch.column(side)[i].as_py() or [])
                found.append(dict(zip(("hits", "nth"), max(zip(hits.tolist(), nth, strict=True)), strict=True)))
        kind = pa.struct([("hits", pa.int64()), ("nth", place)])
        yield pa.RecordBatch.from_arrays([batch.column("message_id"), *(pa.array(found, kind) for found in best.values())], ["message_id", *best])


def pick_cause_effect(atoms: DataFrame, clauses: DataFrame) -> DataFrame:
    """``message_id, cause_atom, effect_atom``: for each clause the atom that holds most of its words of over three bytes.

    Of equal atoms the last wins; a message whose clauses meet in one atom is left out. ``atoms`` has message_id, nth and
    text; ``clauses`` has message_id, cause and effect.
    """
    words = lambda c: F.filter(F.split(F.lower(F.btrim(c)), r"\s+"), lambda w: F.octet_length(w) > 3)
    own = atoms.groupBy("message_id").agg(F.collect_list(F.struct("nth", F.lower("text").alias("low"))).alias("atoms")).select("message_id", F.col("atoms.nth").alias("nth"), F.col("atoms.low").alias("low"))
    rows = own.join(clauses.select("message_id", words("cause").alias("cause"), words("effect").alias("effect")), "message_id")
    kind, nth = (df.schema[c].dataType.simpleString() for df, c in ((rows, "message_id"), (atoms, "nth")))
    best = "struct<hits: long, nth: {}>".format(nth)
    scored = rows.select("message_id", "nth", "low", "cause", "effect").mapInArrow(_best_atoms, f"message_id {kind}, cause {best}, effect {best}")
    both = scored.groupBy("message_id").agg(F.max("cause")["nth"].alias("cause_atom"), F.max("effect")["nth"].alias("effect_atom"))
    return both.where("cause_atom <> effect_atom")


def backstop_edges(messages: DataFrame, atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """``message_id, src_atom, dst_atom, edge_type, strength`` that connectives call for.

    A causal one gives BECAUSE at 55, effect to cause, where the message has two atoms or more and no relation yet; a
    structural one gives its edge at 60 in any case. What ``edges`` holds already is skipped.
    """
    several = atoms.groupBy("message_id").agg(F.count("*").alias("n")).where("n >= 2").select("message_id")
    able = messages.join(several, "message_id", "left_semi")
    causal = able.join(edges, "message_id", "left_anti").select("message_id", split_causal("text").alias("s")).where("s is not null").select("message_id", "s.*")
    because = pick_cause_effect(atoms, causal).select("message_id", F.col("effect_atom").alias("src_atom"), F.col("cause_atom").alias("dst_atom"), F.lit("BECAUSE").alias("edge_type"), F.lit(55).alias("strength"))
    structural = able.select("message_id", split_structural("text").alias("s")).where("s is not null").select("message_id", "s.*")
    ends = pick_cause_effect(atoms, structural.select("message_id", F.col("from_text").alias("cause"), F.col("to_text").alias("effect")))
    typed = ends.join(structural.select("message_id", "edge_type"), "message_id").select("message_id", F.col("cause_atom").alias("src_atom"), F.col("effect_atom").alias("dst_atom"), "edge_type", F.lit(60).alias("strength"))
    return because.unionByName(typed).join(edges, ["message_id", "src_atom", "dst_atom", "edge_type"], "left_anti")


def split_text(text: str, size: int) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the last blank where there is one; joined they give the text."""
    out, at = [], 0
    while len(text) - at > size:
        end = text.rfind(" ", at + 1, at + size) + 1 or at + size
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def chunk_text(df: DataFrame, key: str, text: str, threshold: int = 500, size: int = 512) -> DataFrame:
    """``key, chunk_id, position, chunk``; texts of up to ``threshold`` characters stay whole."""

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [t] if len(t) <= threshold else split_text(t, size))

    long_or_not = df.select(key, F.posexplode(pieces(text)).alias("position", "chunk"))
    return long_or_not.select(key, F.concat_ws("_", key, F.lit("chunk"), "position").alias("chunk_id"), "position", "chunk")


def reconstruct(chunks: DataFrame, key: str, separator: str = "") -> DataFrame:
    """The chunks of each key in order, joined."""
    parts = F.array_sort(F.collect_list(F.struct("position", "chunk")))
    return chunks.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["chunk"]), separator).alias("text"))


def concept_links(df: DataFrame) -> DataFrame:
    """``memory_id, concept, confidence``: one INSTANCE_OF row for each mapped concept, in whole percent."""
    return df.select("memory_id", F.explode("concepts").alias("c")).select("memory_id", "c.concept", F.floor(100 * F.col("c.score") + 1e-9).cast("int").alias("confidence"))
