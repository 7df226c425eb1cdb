"""Exact integer inner products of many vectors by Kronecker packing.

Components are biased to be non-negative. The same component of several candidates goes into separated fields of
one wide integer, each field wide enough for a whole inner product, so that one multiplication with an anchor's
component multiplies all of them, and the sum over the components holds a score in every field. Removing the
bias leaves the exact scores.

The wide integers are as wide as a double holds exactly (53 bits) where that takes two fields or more: the matrix
product of packed candidates and anchors then is exact in any order of its additions. Wider fields go into
integers of ``WIDE`` candidates each, without limit on their width.
"""
from __future__ import annotations

import math

import numpy as np

EXACT_BITS = 53
WIDE = 64


def largest_component(dim: int) -> int:
    """Components up to this size keep every score of ``dim`` components within 64 bits."""
    return math.isqrt(((1 << 63) - 1) // max(dim, 1))


def field_bits(dim: int, low: int, high: int) -> int:
    """Bits that hold an inner product of ``dim`` biased components of low..high."""
    return max(1, (dim * (high - low) ** 2).bit_length())


class Packed:
    """Candidates (rows of an int64 array with values of low..high), packed once for any number of anchors."""

    def __init__(self, rows: np.ndarray, low: int, high: int):
        self.n, self.dim = rows.shape
        self.low, self.bits = low, field_bits(self.dim, low, high)
        biased = rows - low
        self.sums = biased.sum(axis=1)
        self.fields = EXACT_BITS // self.bits
        if self.fields >= 2:
            groups = -(-self.n // self.fields)
            grid = np.zeros((groups * self.fields, self.dim), np.int64)
            grid[:self.n] = biased
            shifts = (np.arange(self.fields) * self.bits)[None, :, None]
            self.words = (grid.reshape(groups, self.fields, self.dim) << shifts).sum(axis=1).astype(np.float64)
            return
        self.bytes = max(8, -(-self.bits // 8))
        self.wide = []
        for at in range(0, self.n, WIDE):
            part = biased[at:at + WIDE]
            cells = np.zeros((self.dim, len(part), self.bytes), np.uint8)
            cells[:, :, :8] = np.ascontiguousarray(part.T).astype("<u8").view(np.uint8).reshape(self.dim, len(part), 8)
            self.wide.append([int.from_bytes(c.tobytes(), "little") for c in cells])

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """The inner products (anchor, candidate); anchors lie within low..high as well."""
        biased = anchors - self.low
        if self.fields >= 2:
            sums = (biased.astype(np.float64) @ self.words.T).astype(np.int64)
            out = np.empty((len(anchors), sums.shape[1], self.fields), np.int64)
            mask = (1 << self.bits) - 1
            for f in range(self.fields):
                np.bitwise_and(sums >> (f * self.bits), mask, out=out[:, :, f])
            out = out.reshape(len(anchors), -1)[:, :self.n]
        else:
            out = np.empty((len(anchors), self.n), np.int64)
            for row, anchor in enumerate(biased.tolist()):
                at = 0
                for wide in self.wide:
                    total = sum(a * w for a, w in zip(anchor, wide))
                    held = min(WIDE, self.n - at)
                    raw = np.frombuffer(total.to_bytes(held * self.bytes, "little"), np.uint8).reshape(held, self.bytes)
                    out[row, at:at + held] = np.ascontiguousarray(raw[:, :8]).view("<i8")[:, 0]  # scores fit in 64 bits
                    at += held
        with np.errstate(over="ignore"):  # modulo 2**64, where the parts may not fit but the score does
            return out + np.int64(self.low) * (self.sums[None, :] + biased.sum(axis=1)[:, None]) + np.int64(self.dim) * np.int64(self.low) ** 2
