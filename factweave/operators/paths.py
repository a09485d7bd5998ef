"""Longest simple paths in small nets, with a budget of steps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def longest_path(adjacency: dict[str, list[tuple[str, float]]], starts: list[str], budget: int, join: Callable[[float, float], float], first: float) -> tuple[list[str], float]:
    """The longest simple path from any start, ties by the joined weight; neighbours are tried in their order.

    The walk keeps its own stack, so a long path does not meet Python's recursion limit.
    """
    best, best_key = starts[:1], (1, first)
    for start in starts:
        path, on_path, weights = [start], {start}, [first]
        todo = [iter(adjacency.get(start, ()))]
        while todo:
            step = next(todo[-1], None)
            if step is None:
                todo.pop()
                on_path.discard(path.pop())
                weights.pop()
                continue
            budget -= 1
            if budget < 0:
                return best, best_key[1]
            node, weight = step
            if node in on_path:
                continue
            path.append(node)
            on_path.add(node)
            weights.append(join(weights[-1], weight))
            if (len(path), weights[-1]) > best_key:
                best, best_key = path.copy(), (len(path), weights[-1])
            todo.append(iter(adjacency.get(node, ())))
    return best, best_key[1]


def longest_route(start: int, near: Callable[[int], tuple[list[int], list[float], bool] | None], budget: int) -> tuple[list[int], list[float]] | None:
    """``longest_path`` from one start, ties by the weakest link, with the weights of its links, over lists that may be cut short.

    ``near`` gives a node's neighbours in their order, their weights and whether these are all; or None for a node whose
    list is not there. A walk that needs more than is there gives None; one that doesn't goes as it would over whole lists.
    """
    best, weights, length, low, ahead = [start], [], 1, float("inf"), False
    path, on_path, links, lows, at = [start], {start}, [], [low], [0]
    while path and budget > 0:
        own = near(path[-1])
        if own is None:
            return None
        ends, values, whole = own
        k, n = at[-1], len(ends)
        while k < n and budget > 0 and ends[k] in on_path:
            k += 1
            budget -= 1
        if budget <= 0:
            break
        if k < n:
            budget -= 1
            at[-1] = k + 1
            path.append(ends[k])
            on_path.add(ends[k])
            links.append(values[k])
            lows.append(min(lows[-1], values[k]))
            at.append(0)
            if (len(path), lows[-1]) > (length, low):
                length, low, ahead = len(path), lows[-1], True
        elif whole:
            if ahead:  # the best one is where the walk stands, until it turns back
                best, weights, ahead = path.copy(), links.copy(), False
            on_path.discard(path.pop())
            lows.pop()
            at.pop()
            if links:
                links.pop()
        else:
            return None
    return (path, links) if ahead else (best, weights)


def longest_in_net(inner: np.ndarray, first: np.ndarray, ends: np.ndarray, weights: np.ndarray, budget: int) -> tuple[list[int], float]:
    """``longest_path`` from all nodes of a net, ties by the product of weights, for nets whose most nodes have no way on.

    Only the nodes of ``inner`` (ascending) have edges: of node x those to ``ends[first[x]:first[x + 1]]``, ascending. Edges
    to other nodes stand between those to inner ones as runs, whose best is found at once; each edge is a step.
    """
    known, items = set(inner.tolist()), {}
    for x in inner.tolist():
        low, high = int(first[x]), int(first[x + 1])
        own = ends[low:high]
        places = np.concatenate([np.arange(*r) for r in zip(np.searchsorted(own, inner), np.searchsorted(own, inner, "right"), strict=True)]) + low
        row, at = [], low
        for k in [*places.tolist(), high]:
            if k > at:
                row.append((None, at, k, float(weights[at:k].max())))
            if k < high:
                row.append((int(ends[k]), k, k + 1, float(weights[k])))
            at = k + 1
        items[x] = row
    smallest = min(min(known), *(int(ends[first[x]]) for x in known))
    best, length, most = [smallest], 1, 1.0
    for start in inner.tolist():
        path, on_path, joined = [start], {start}, [1.0]
        todo = [iter(items[start])]
        while todo:
            step = next(todo[-1], None)
            if step is None:
                todo.pop()
                on_path.discard(path.pop())
                joined.pop()
                continue
            node, low, high, weight = step
            if budget <= 0:
                return best, most
            if node is None:
                here, at = joined[-1], len(path) + 1
                if at > length or at == length and here * weight > most:
                    values = here * weights[low : min(high, low + budget)]
                    k = int(values.argmax())
                    if at > length or values[k] > most:
                        best, length, most = [*path, int(ends[low + k])], at, float(values[k])
                budget -= high - low
                if budget < 0:
                    return best, most
                continue
            budget -= 1
            if node in on_path:
                continue
            path.append(node)
            on_path.add(node)
            joined.append(joined[-1] * weight)
            if (len(path), joined[-1]) > (length, most):
                best, length, most = path.copy(), len(path), joined[-1]
            todo.append(iter(items[node]))
    return best, most
