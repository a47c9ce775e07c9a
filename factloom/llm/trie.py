"""A double-array trie over bytes, walked for many strings at once."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class DoubleArray:
    """States are places in the arrays; state 0 is the root. From s, byte c leads to base[s] + c if check there is s.

    value[s] is the id of the piece that ends in s, or -1.
    """

    def __init__(self, pieces: Iterable[tuple[bytes, int]]):
        keys = sorted(pieces)
        size = 1 << 16
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        free = 1  # no place below it is free
        self.order = [0]  # states, parents first
        todo = [(0, 0, len(keys), 0)]
        for state, lo, hi, depth in todo:
            while lo < hi and len(keys[lo][0]) == depth:
                value[state] = keys[lo][1]
                lo += 1
            if lo == hi:
                continue
            children, at = [], lo
            while at < hi:
                c, end = keys[at][0][depth], at
                while end < hi and keys[end][0][depth] == c:
                    end += 1
                children.append((c, at, end))
                at = end
            codes = np.array([c for c, _, _ in children])
            slot = free
            while True:
                if slot + 512 > size:
                    size *= 2
                    base, value = np.resize(base, size), np.concatenate([value, np.full(size - len(value), -1, np.int32)])
                    check = np.concatenate([check, np.full(size - len(check), -1, np.int32)])
                if check[slot] < 0 and slot > codes[0] and (len(codes) == 1 or (check[slot - codes[0] + codes] < 0).all()):
                    break
                slot += 1
            start = slot - int(codes[0])
            base[state] = start
            check[start + codes] = state
            for c, a, b in children:
                self.order.append(start + c)
                todo.append((start + c, a, b, depth + 1))
            while check[free] >= 0:
                free += 1
            if len(codes) > 1 and slot - free > 4096:
                free = slot - 4096  # a few free places behind are given up, so that the search stays short
        used = int(np.flatnonzero(check >= 0)[-1]) + 257
        self.base, self.check, self.value = base[:used].copy(), np.full(used, -1, np.int32), value[:used].copy()
        n = min(used, len(check))
        self.check[:n] = check[:n]

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none."""
        to = self.base[states] + codes
        return np.where((self.check[to] == states) & (to > 0), to, -1)

    def after(self, state: int, code: int) -> int:
        to = int(self.base[state]) + code
        return to if to > 0 and self.check[to] == state else -1
