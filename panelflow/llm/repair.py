"""Re-Pair: a straight-line grammar of a sequence of integers.

The pair of neighbouring symbols that occurs most often (without overlaps)
becomes a rule, until no pair occurs twice.  Occurrences are listed when a pair
first appears and checked when its turn comes, so the count in the heap is an
upper bound that is mended on the way out.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np


class Grammar(NamedTuple):
    """Rule ``k`` makes symbol ``terminals + k`` from a pair; ``sequence`` derives the input."""

    terminals: int
    rules: list[tuple[int, int]]
    sequence: list[int]
    #: Where each symbol of ``sequence`` begins in the input.
    starts: list[int]


def _first_pairs(ids: np.ndarray, terminals: int) -> dict[tuple[int, int], list[int]]:
    """Places of the pairs that occur twice or more."""
    keys = ids[:-1] * terminals + ids[1:]
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    edges = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1], [True])))
    big = np.flatnonzero(np.diff(edges) > 1)
    places = order.tolist()
    return {
        divmod(key, terminals): places[a:b]
        for key, a, b in zip(sorted_keys[edges[big]].tolist(), edges[big].tolist(), edges[big + 1].tolist())
    }


def compress(ids: np.ndarray, terminals: int) -> Grammar:
    """Grammar of ``ids`` (below ``terminals``)."""
    n = len(ids)
    rules: list[tuple[int, int]] = []
    if n < 2:
        return Grammar(terminals, rules, ids.tolist(), list(range(n)))
    symbols = ids.tolist()
    symbols.append(-1)  # a symbol behind the end that matches nothing
    after, before = list(range(1, n + 2)), list(range(-1, n))
    places = _first_pairs(ids, terminals)
    heap = [(-len(p), pair) for pair, p in places.items()]
    heapq.heapify(heap)
    while heap:
        expected, pair = heapq.heappop(heap)
        left, right = pair
        held = found = [p for p in places[pair] if symbols[p] == left and symbols[after[p]] == right]
        if left == right:
            found, last = [], -1
            for p in held:
                if p != last:
                    found.append(p)
                    last = after[p]
        if len(found) < 2:
            del places[pair]
            continue
        if len(found) < -expected:
            places[pair] = held  # an occurrence that overlaps now may stand alone later
            if heap and -len(found) > heap[0][0]:
                heapq.heappush(heap, (-len(found), pair))
                continue
        del places[pair]
        new = terminals + len(rules)
        rules.append(pair)
        fresh: dict[tuple[int, int], list[int]] = {}
        for p in found:
            q = after[p]
            r = after[q]
            symbols[p], symbols[q] = new, -2
            after[p] = r
            before[r] = p
            if p:
                o = before[p]
                fresh.setdefault((symbols[o], new), []).append(o)
            if r < n:
                fresh.setdefault((new, symbols[r]), []).append(p)
        for made, where in fresh.items():
            if len(where) > 1:
                places[made] = where
                heapq.heappush(heap, (-len(where), made))
    sequence, starts, p = [], [], 0
    while p < n:
        sequence.append(symbols[p])
        starts.append(p)
        p = after[p]
    return Grammar(terminals, rules, sequence, starts)
