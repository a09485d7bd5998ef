"""Repeats inside one block of texts: a sparse suffix array with common prefixes, scanned as an interval tree."""

from __future__ import annotations

import numpy as np


def _word(data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; bytes beyond the end are zero. ``data`` has 8 bytes to spare."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | np.where(at + k < ends, data[np.minimum(at + k, len(data) - 1)], 0).astype(np.uint64)
    return out


def _ranked(data: np.ndarray, at: np.ndarray, ends: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes by group, then by bytes: eight at a time, only those still tied go on."""
    order = np.argsort(group, kind="stable")
    label = group[order].astype(np.int64)
    depth, active = 0, np.arange(len(order))
    while len(active):
        own = order[active]
        key = _word(data, at[own] + depth, ends[own])
        goes_on = at[own] + depth + 8 < ends[own]
        step = np.lexsort((goes_on, key, label[active]))
        own, key, old, goes_on = own[step], key[step], label[active][step], goes_on[step]
        order[active] = own
        fresh = np.ones(len(own), bool)
        fresh[1:] = (old[1:] != old[:-1]) | (key[1:] != key[:-1]) | (goes_on[1:] != goes_on[:-1])
        head = np.flatnonzero(fresh)
        # a label is the first place of its group in the order, so it keeps the groups in line
        label[active] = active[head[np.cumsum(fresh) - 1]]
        size = np.diff(np.append(head, len(own)))
        depth += 8
        # those that end here stand in front of the longer ones
        active = active[np.repeat(size > 1, size) & goes_on]
    return order


def _common(data: np.ndarray, a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Length of the common prefix of pairs of suffixes, compared eight bytes at a time."""
    most = np.minimum(a_end - a, b_end - b)
    length = np.zeros(len(a), np.int64)
    active = np.flatnonzero(most > 0)
    while len(active):
        x, y = (_word(data, at[active] + length[active], end[active]) for at, end in ((a, a_end), (b, b_end)))
        differ = x ^ y
        # leading zero bytes of what differs; a byte beyond the end may look like a zero byte of the other text
        same = np.full(len(active), 8)
        for k in range(7, -1, -1):
            same[(differ >> np.uint64(8 * (7 - k)) & np.uint64(255)) != 0] = k
        length[active] = np.minimum(length[active] + same, most[active])
        active = active[(same == 8) & (length[active] < most[active])]
    return length


def maximal_repeats(texts: list[bytes], befores: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats of ``least`` bytes or more that start at one of the first ``counts[i]`` places of text ``i``.

    ``befores[i]`` is the byte before text ``i`` (-1 for none known). Returns group, text, start and length of every
    occurrence. Suffixes are sorted, neighbours' common prefixes make intervals, and a stack finds each interval's
    borders; it is a group if what stands before its suffixes differs, or is not known for one of them.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=begin[1:])
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    none = np.zeros(0, np.int64)
    counts = np.minimum(counts, np.maximum(lengths - least + 1, 0))
    if not counts.sum():
        return none, none, none, none
    text = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + begin[text]
    ends = begin[text + 1]
    order = _ranked(data, at, ends, np.zeros(len(at), np.int64))
    text, at, ends = text[order], at[order], ends[order]
    lcp = np.zeros(len(at) + 1, np.int64)
    lcp[1:-1] = _common(data, at[:-1], at[1:], ends[:-1], ends[1:])
    # intervals of shorter prefixes are of no use
    lcp[lcp < least] = 0
    before = np.where(at > begin[text], data[np.maximum(at - 1, 0)].astype(np.int64), -2)
    edge = before == -2
    before[edge] = befores[text[edge]]
    # a text's first place: what stands before it may go on in another block's text, so it counts as unknown
    differs = np.zeros(len(at) + 1, np.int64)
    np.cumsum((before[1:] != before[:-1]) | edge[1:] | edge[:-1], out=differs[1:-1]) if len(at) > 1 else None
    differs[-1] = differs[-2]
    spans: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate(lcp[1:].tolist(), 1):
        left = i - 1
        while stack and stack[-1][0] > depth:
            length, left = stack.pop()
            spans.append((left, i, length))
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))
    lb, rb, length = (np.array(x, np.int64) for x in zip(*spans, strict=True)) if spans else (none, none, none)
    diverse = differs[rb - 1] > differs[lb]
    lb, rb, length = lb[diverse], rb[diverse], length[diverse]
    size = rb - lb
    group = np.repeat(np.arange(len(size)), size)
    member = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lb, size)
    return group, text[member], at[member] - begin[text[member]], np.repeat(length, size)
