"""Word shingle sets as sorted arrays of 64-bit hashes, and their cells for the Jaccard join."""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from vendorlens.llm.textarrays import SPACE_WORD, byte_chunks, mix64, word_hashes

U64 = np.uint64
SEEDS = 4
RING_BITS = 6


def shingle_sets(texts, k: int):
    """Yield (number of rows, distinct shingle hashes, row of each), ordered by row and hash. A text of fewer
    than ``k`` words has its whole word sequence as one shingle; a text without words has none."""
    for _, data, bounds in byte_chunks(texts):
        w, doc = word_hashes(data, bounds, SPACE_WORD)
        n = len(bounds) - 1
        size = np.minimum(np.bincount(doc, minlength=n), k)[doc] if len(doc) else doc
        last = np.searchsorted(doc, np.arange(n), "right")[doc] if len(doc) else doc
        at = np.flatnonzero(np.arange(len(w)) + size <= last)
        h = np.zeros(len(at), U64)
        for j in range(k):
            inside = j < size[at]
            h[inside] = mix64(h[inside] * U64(0x9E3779B97F4A7C15) + w[at[inside] + j] + U64(j + 1))
        row = doc[at]
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield n, h[first], row[first]


@dataclass(frozen=True)
class Ring:
    """Set sizes lo..hi; sets from ``near`` on also enter this ring; ``differ`` bounds the symmetric
    difference of a linked pair in the ring, ``parts`` exceeds it by 1 + ``slack``."""

    number: int
    near: int
    lo: int
    hi: int
    differ: int
    parts: int
    slack: int


def rings(num: int, den: int, most: int) -> list[Ring]:
    out, lo = [], 1
    while lo <= most:
        hi = max(lo, math.ceil(lo * math.sqrt(2)) - 1)
        near = -(-lo * num // den)
        differ = 2 * hi * (den - num) // (den + num)
        parts = differ + 1
        slack = math.ceil(2 * parts * math.exp(-near / parts)) if differ else 0
        out.append(Ring(len(out), near, lo, hi, differ, parts + slack, slack))
        lo = hi + 1
    return out


def cells(h: np.ndarray, row: np.ndarray, n: int, num: int, den: int):
    """(cell, row) of every set, and (row, ring, need): two sets that link share at least ``need`` cells of some
    ring that both are in. The low ``RING_BITS`` bits of a cell are its ring.

    A ring deals the shingles to parts by hash; linked sets differ in fewer shingles than there are parts, so
    some part is equal in both, and the cell is that part's content. Empty parts say nothing: a set with more
    empty parts than the ring's slack is dealt once more by another seed (if both sets of a pair have too many,
    both are dealt again); after ``SEEDS`` seeds its empty parts count as cells. A set with few empty parts shares
    all others but those that its differences can spoil; that is its need."""
    size = np.bincount(row, minlength=n)
    found_cell, found_row, needs = [], [], []
    for ring in rings(num, den, int(size.max(initial=0))):
        member = (size >= ring.near) & (size <= ring.hi)
        for seed in range(SEEDS):
            if not member.any():
                break
            used = member[row]
            r, x = row[used], mix64(h[used] + U64(seed * 0x51ED2701 + ring.number))
            key = r * ring.parts + ((x >> U64(32)) % U64(ring.parts)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            key, x = key[order], mix64(x[order] + U64(1))
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            total = np.add.reduceat(x, start)
            at = key[start]
            found_row.append(at // ring.parts)
            found_cell.append(_tagged(mix64(total + mix64(((at % ring.parts) * SEEDS + seed + 1).astype(U64))), ring))
            filled = np.bincount(at // ring.parts, minlength=n)
            again = member & (ring.parts - filled > ring.slack)
            if seed == 0:
                who = np.flatnonzero(member)
                spoilt = np.minimum(ring.differ, size[who] * (den - num) // num)
                needs.append((who, np.full(len(who), ring.number), np.where(again[who], 1, filled[who] - spoilt)))
            if seed == SEEDS - 1 and again.any():
                full = np.zeros((int(again.sum()), ring.parts), bool)
                index = np.cumsum(again) - 1
                mine = again[at // ring.parts]
                full[index[(at // ring.parts)[mine]], (at % ring.parts)[mine]] = True
                who, part = np.nonzero(~full)
                found_row.append(np.flatnonzero(again)[who])
                found_cell.append(_tagged(mix64((part + 1).astype(U64) * U64(0xD6E8FEB86659FD93)), ring))
            member = again
    if not found_cell:
        none = np.empty(0, np.int64)
        return np.empty(0, U64), none, (none, none, none)
    return np.concatenate(found_cell), np.concatenate(found_row), tuple(np.concatenate(c) for c in zip(*needs))


def _tagged(cell: np.ndarray, ring: Ring) -> np.ndarray:
    return cell & ~U64((1 << RING_BITS) - 1) | U64(ring.number)
