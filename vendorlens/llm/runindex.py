"""Run-length index of a block of byte strings: a run-compressed Burrows-Wheeler transform that keeps, at
the ends of its runs only, a suffix position and the length of its match with the neighbour; matching
statistics stream from these samples.

Two suffixes that stand next to each other inside a run of the transform are preceded by the same byte, so
the match that starts one byte earlier is one byte longer and stands next to each other too. Only matches
at run boundaries carry news; every other one is one shorter than the match of the position before it.
"""
from __future__ import annotations

import numpy as np


class RunIndex:
    def __init__(self, strings: list[np.ndarray]):
        """``strings``: byte arrays, fewer than 60,000. Each ends in a symbol of its own."""
        sizes = np.array([len(s) for s in strings])
        self.starts = np.r_[0, np.cumsum(sizes + 1)]
        text = np.zeros(int(self.starts[-1]) + 1, np.uint64)
        for i, s in enumerate(strings):
            text[self.starts[i]:self.starts[i] + len(s)] = s
            text[self.starts[i] + len(s)] = 256 + i
        text[-1] = 256 + len(strings)
        self.n = len(text)
        self._levels, order = self._sort(text)
        before = text[order - 1]
        heads = np.flatnonzero(before[1:] != before[:-1]) + 1  # rows that start a run, with the row above it
        self.runs = len(heads) + 1
        self.head_at, self.tail_at = order[heads], order[heads - 1]
        self.match = self._common(self.head_at, self.tail_at)

    def _sort(self, text):
        """Suffix order by prefix doubling; keeps the names of all substrings of 1, 2, 4, 8, ... symbols."""
        def shifted(a, h):
            out = np.zeros_like(a)
            out[:-h] = a[h:]
            return out

        pair = text << np.uint64(16) | shifted(text, 1)
        quad = pair << np.uint64(32) | shifted(pair, 2)
        levels, h = [(1, text), (2, pair), (4, quad)], 4
        key = quad
        while True:
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            name = np.empty(self.n, np.uint64)
            name[order] = np.cumsum(np.r_[1, ranked[1:] != ranked[:-1]]).astype(np.uint64)
            if int(name[order[-1]]) == self.n or h >= self.n:
                return levels, order
            if h > 4:
                levels.append((h, name))
            key = name << np.uint64(32) | shifted(name, h)
            h *= 2

    def _common(self, a, b):
        """Lengths of the common prefixes of suffixes a and b."""
        a, b = a.copy(), b.copy()
        total = np.zeros(len(a), np.int64)
        for h, name in reversed(self._levels):
            same = (a < self.n) & (b < self.n)
            same[same] = name[a[same]] == name[b[same]]
            step = np.where(same, h, 0)
            total += step
            a += step
            b += step
        return total

    def matching_statistics(self) -> np.ndarray:
        """For every position the length of the longest match that also starts elsewhere."""
        reach = np.zeros(self.n, np.int64)
        np.maximum.at(reach, self.head_at, self.match + self.head_at)
        np.maximum.at(reach, self.tail_at, self.match + self.tail_at)
        return np.maximum(np.maximum.accumulate(reach) - np.arange(self.n), 0)

    def longest(self, i: int, stats: np.ndarray) -> np.ndarray:
        """The matching statistics of string i."""
        return stats[self.starts[i]:self.starts[i + 1] - 1]
