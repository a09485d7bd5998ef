"""Words and their hashes over Arrow batches, with NumPy; used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (two rounds of xor-shift and multiply)."""
    x = (x ^ (x >> U64(31))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(29))) * U64(0xA24BAED4963EE407)
    return x ^ (x >> U64(32))


with np.errstate(over="ignore"):
    #: a value for each byte, and the odd base of the polynomial with its inverse modulo 2**64
    BYTE = mixed(np.arange(1, 257, dtype=U64) * U64(0x9FB21C651E98DF25))
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        out = np.full(size, base, dtype=U64)
        out[0] = 1
        return np.cumprod(out, dtype=U64)

    return of(BASE), of(INVERSE)


def powers(least: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, ``least`` of them or more."""
    return _powers(max(1 << 19, 1 << (least - 1).bit_length()) + 1)


class Block:
    """Some rows of a text column as bytes: ``data``, with row ``r`` at ``offsets[r]:offsets[r + 1]``."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets, self.rows = first, data, offsets, len(offsets) - 1

    def lowered(self) -> Block:
        """A-Z to a-z."""
        big = (self.data >= 65) & (self.data <= 90)
        return Block(self.first, self.data + (big.astype(np.uint8) << 5), self.offsets)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Running polynomial sums, one more than bytes, and the inverse powers that place a slice at zero."""
        up, down = powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=U64)
        np.cumsum(BYTE[self.data] * up[: len(self.data)], out=sums[1:])
        return sums, down

    def words(self, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and for each row its first word (one more than rows).

        ``breaks`` marks bytes between words; by default space and \\x09-\\x0D. No word crosses rows.
        """
        if breaks is None:
            breaks = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        inside = ~breaks
        start, end = inside.copy(), inside.copy()
        start[1:] &= breaks[:-1]
        end[:-1] &= breaks[1:]
        edges = self.offsets[:-1][self.offsets[:-1] < len(self.data)]
        start[edges] = inside[edges]
        edges = edges[edges > 0]
        end[edges - 1] = inside[edges - 1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def slices(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges."""
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def sequences(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of ``n`` neighbours."""
    out = np.zeros(max(0, len(hashes) - n + 1), dtype=U64)
    for k in range(n):
        out = out * U64(BASE) + hashes[k : len(hashes) - n + 1 + k]
    return mixed(out)


def hash_words(words: list[str]) -> np.ndarray:
    """The same hashes for words given as strings."""
    raw = [w.encode() for w in words]
    offsets = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in raw], out=offsets[1:])
    block = Block(0, np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    return slices(*block.sums(), offsets[:-1], offsets[1:])


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 19) -> Iterator[Block]:
    """The column in pieces of about ``limit`` bytes, a longer text alone in its own; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        own = offsets[at : to + 1]
        yield Block(at, data[own[0] : own[-1]], own - own[0])
        at = to
