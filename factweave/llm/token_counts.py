"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links. Each link knows how many pieces are popped when it is followed, so the
greedy longest-match length of a word comes from one walk over its bytes, and no piece is built.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factweave.llm.textkit import blocks, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class Automaton:
    """States of the trie over byte pieces; state 0 is the start. Every byte must be a piece by itself."""

    def __init__(self, pieces: list[bytes]):
        child: dict[int, int] = {}
        parent, last, whole = [0], [0], [False]
        for piece in pieces:
            at = 0
            for c in piece:
                key = at << 8 | c
                at = child.get(key, 0)
                if not at:
                    at = child[key] = len(parent)
                    parent.append(key >> 8)
                    last.append(c)
                    whole.append(False)
            whole[at] = True
        if any(not whole[child.get(c, 0)] for c in range(256)):
            raise ValueError("every single byte must be in the vocabulary")
        link, popped = [0] * len(parent), [0] * len(parent)
        depth = [0] * len(parent)
        for v in range(1, len(parent)):
            depth[v] = depth[parent[v]] + 1  # a child is numbered after its parent
        for v in sorted(range(1, len(parent)), key=depth.__getitem__):
            if whole[v]:
                popped[v] = 1
                continue
            # pieces popped so far by the parent, then by its links, until the last byte can follow
            at, n = link[parent[v]], popped[parent[v]]
            while (key := at << 8 | last[v]) not in child:
                n += popped[at]
                at = link[at]
            link[v], popped[v] = child[key], n
        order = sorted(child)
        self.edges = np.array(order, np.int64)
        self.to = np.array([child[k] for k in order], np.int32)
        self.link, self.popped = np.array(link, np.int32), np.array(popped, np.int32)

    def lengths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of pieces of the byte ranges, each read with a space in front; all of them walk in step."""
        state = np.full(len(starts), self.to[np.searchsorted(self.edges, 32)], np.int64)
        count = np.zeros(len(starts), np.int64)
        order = np.argsort(starts - ends, kind="stable")  # longest first
        size = (ends - starts)[order]
        live = len(order)
        for k in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size[:live], -k, "left"))
            own = order[:live]
            self._step(own, data[starts[own] + k].astype(np.int64), state, count)
        while len(rest := np.flatnonzero(state)):
            count[rest] += self.popped[state[rest]]
            state[rest] = self.link[state[rest]]
        return count

    def _step(self, own: np.ndarray, byte: np.ndarray, state: np.ndarray, count: np.ndarray) -> None:
        while len(own):
            key = state[own] << 8 | byte
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            found = self.edges[at] == key
            state[own[found]] = self.to[at[found]]
            own, byte = own[~found], byte[~found]
            count[own] += self.popped[state[own]]
            state[own] = self.link[state[own]]


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a rank file: a base64 piece and its rank on each line. Read by the driver; tasks get the automaton."""
    return [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line.strip()]


def token_counts(docs: DataFrame, pieces: list[bytes] | None = None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``n_words`` and ``n_tokens``: words between white space, each cut greedily from its
    left, together with one space in front, into the longest pieces.

    Null and empty texts have no word. Words of any length are walked whole. Repeated rows count alike; columns of the
    added names are replaced; an empty table gives no rows. The automaton is as large as the vocabulary.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(read_vocabulary() if pieces is None else pieces))
    own = docs.drop("n_words", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, tokens = [], []
            for block in blocks(batch.column(text)):
                starts, ends, first = block.words()
                _, at, of = np.unique(slices(*block.sums(), starts, ends), return_index=True, return_inverse=True)
                sums = np.concatenate(([0], np.cumsum(shared.value.lengths(block.data, starts[at], ends[at])[of])))
                words.append(np.diff(first))
                tokens.append(sums[first[1:]] - sums[first[:-1]])
            made = [pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64()) for x in (words, tokens)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "n_words", "n_tokens"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInArrow(run, f"{columns}, n_words long, n_tokens long")
