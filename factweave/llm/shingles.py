"""Sets of five-word shingles, as sorted 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np

from factweave.llm.textkit import Block, sequences, slices

WORDS = 5


def shingle_sets(block: Block) -> list[np.ndarray]:
    """For each row its distinct shingles in ascending order; a shorter text is one shingle, one without words has none.

    A-Z count as a-z, words are what stands between white space.
    """
    low = block.lowered()
    starts, ends, first = low.words()
    words = slices(*low.sums(), starts, ends)
    runs = sequences(words, WORDS) if len(words) >= WORDS else words[:0]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(runs[a : b - WORDS + 1]))
        else:
            out.append(sequences(words[a:b], b - a) if b > a else words[:0])
    return out


def set_print(hashes: np.ndarray) -> int:
    """A signed 64-bit name for a set; equal sets share it."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)
