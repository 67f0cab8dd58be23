"""Double-array tries over whole numbers, walked by many positions at once.

A state is a place in two arrays: the child of state ``s`` under symbol ``c`` is ``base[s] + c`` if ``check`` says so
there. Following a symbol is one gather for all positions together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: The root. State 0 is dead: nothing leads out of it.
ROOT = 1


@dataclass
class DoubleArray:
    """``item`` is the number of the node at a state, as given to ``build``."""

    base: np.ndarray
    check: np.ndarray
    item: np.ndarray

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """States after one symbol each, 0 where there is no such child; ``symbols`` may be 0, which no node has."""
        to = self.base.take(states) + symbols
        return np.where(self.check.take(to) == states, to, 0)

    @property
    def nbytes(self) -> int:
        return self.base.nbytes + self.check.nbytes + self.item.nbytes


def build(parent: np.ndarray, symbol: np.ndarray) -> DoubleArray:
    """The trie whose node ``i + 1`` is the child of node ``parent[i]`` (smaller, 0 is the root) under ``symbol[i] >= 1``.

    Nodes with many children are placed first and only children into what is free then. A search for room goes on where
    the last one for a node of that size ended, so the arrays are gone through once per size class.
    """
    n, top = len(parent) + 1, int(symbol.max(initial=0))
    order = np.lexsort((symbol, parent))
    parents, first, sizes = np.unique(parent[order], return_index=True, return_counts=True)
    room = _Room(top, 4 * n + 4 * top + 1024)
    slot, base = np.zeros(n, np.int64), np.zeros(n, np.int64)
    slot[0] = ROOT
    for k in np.argsort(-sizes, kind="stable"):
        if sizes[k] == 1:
            break
        rows = order[first[k] : first[k] + sizes[k]]
        base[parents[k]] = room.place(symbol[rows])
        slot[rows + 1] = base[parents[k]] + symbol[rows]
    alone = sizes == 1
    rows = order[first[alone]]
    places = room.single(len(rows))
    slot[rows + 1] = places
    base[parents[alone]] = places - symbol[rows]
    size = max(int(slot.max()), int(base.max())) + top + 1
    out = DoubleArray(np.zeros(size, np.int32), np.full(size, -1, np.int32), np.zeros(size, np.int32))
    out.base[slot] = base
    out.item[slot] = np.arange(n)
    out.check[slot[1:]] = slot[parent]
    return out


class _Room:
    """Free places; those up to the largest symbol stay free, so that no base is negative and leaves lead nowhere."""

    WINDOW = 1024

    def __init__(self, top: int, size: int) -> None:
        self.low = max(top, ROOT) + 1
        self.used = np.zeros(self.low + size, bool)
        self.used[: self.low] = True
        self.seen: dict[int, int] = {}

    def _grow(self, need: int) -> None:
        if need > len(self.used):
            self.used = np.concatenate((self.used, np.zeros(max(need - len(self.used), len(self.used)), bool)))

    def place(self, symbols: np.ndarray) -> int:
        kind = int(len(symbols)).bit_length()
        at, ahead = self.seen.get(kind, self.low), symbols - symbols[0]
        while True:
            self._grow(at + self.WINDOW + int(ahead[-1]) + 1)
            free = np.flatnonzero(~self.used[at : at + self.WINDOW]) + at
            for off in ahead[1:]:
                if not len(free):
                    break
                free = free[~self.used[free + off]]
            if len(free):
                self.used[free[0] + ahead] = True
                self.seen[kind] = int(free[0])
                return int(free[0] - symbols[0])
            at += self.WINDOW

    def single(self, n: int) -> np.ndarray:
        free = np.flatnonzero(~self.used[self.low :])[:n] + self.low
        if len(free) < n:
            free = np.concatenate((free, len(self.used) + np.arange(n - len(free))))
        return free
