"""Byte-pair merging with a heap over a doubly linked list of symbols, and a bounded table of results."""

from __future__ import annotations

import heapq
from collections.abc import Callable

SHIFT = 32
MASK = (1 << SHIFT) - 1


def merge_spans(piece, ranks: dict, pairs: list | None = None) -> tuple[list[int], int]:
    """Merge the symbols of ``piece`` (str or bytes) by ``ranks`` (substring -> rank) and return (ends, symbols left).

    ``ends[i]`` is the end of the symbol that begins at ``i``, or 0 if none begins there. The heap holds
    (rank, start) of adjacent pairs as one integer; the pair of lowest rank, leftmost among equals, merges first.
    ``pairs``, if given, has the ranks of two bytes as a list of lists.
    ``now[i]`` is the rank of the pair that begins at ``i`` at present: an entry with another rank is stale.
    """
    get, pop, push = ranks.get, heapq.heappop, heapq.heappush
    n = left = len(piece)
    ends = list(range(1, n + 1))
    if pairs is None:
        now = [get(piece[i : i + 2], -1) for i in range(n - 1)]
    else:
        now = [pairs[a][b] for a, b in zip(piece, piece[1:])]
    now.append(-1)
    heap = [r << SHIFT | i for i, r in enumerate(now) if r >= 0]
    if not heap:
        return ends, left
    heapq.heapify(heap)
    before = list(range(-1, n))
    while heap:
        top = pop(heap)
        i = top & MASK
        if now[i] != top >> SHIFT:
            continue
        j = ends[i]
        k = ends[j]
        ends[i], ends[j] = k, 0
        now[i] = now[j] = -1
        before[k] = i
        left -= 1
        if k < n:
            r = get(piece[i : ends[k]], -1)
            if r >= 0:
                now[i] = r
                push(heap, r << SHIFT | i)
        if i:
            p = before[i]
            now[p] = r = get(piece[p:k], -1)
            if r >= 0:
                push(heap, r << SHIFT | p)
    return ends, left


class Kept:
    """Results by key in two generations: when the young one is full it becomes the old one, and keys in use move on."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def fill(self, keys, make: Callable[[list], dict]) -> dict:
        """A dict that holds all of ``keys``; ``make`` gives those that are in neither generation."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        lacking = []
        for k in set(keys).difference(young):
            v = old.get(k)
            if v is None:
                lacking.append(k)
            else:
                young[k] = v
        if lacking:
            young.update(make(lacking))
        return young


class Made(dict):
    """Values made when they are first asked for; two generations as in ``Kept``."""

    def __init__(self, most: int, make: Callable):
        self.most, self.make, self.old = most, make, {}

    def __missing__(self, key):
        v = self.old.get(key)
        if v is None:
            v = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = v
        return v
