"""Near copies by circulant MinHash, banding and exact verification.

1. A document's set of word shingles is placed in a universe of 2**32 cells by one permutation of their hashes
   (sigma). All coordinates of its signature come from one more permutation (pi), shifted around the universe:
   coordinate k is the least pi(sigma(shingle) + k mod 2**32). No further permutations are drawn.
2. Equal sets are one class, which stands under its least id. ``bands`` bands of ``rows`` coordinates give a class its
   cells; the numbers follow from the similarity asked for, so that a linked pair shares no cell with a probability
   below ``MISS`` (``banding``). Shared cells take pivots and form regions.
3. In each region links are confirmed on full sets: members against the pivot, and those beyond its radius against
   each other where their differences allow a link (``jaccard.region_links``). Pairs within a pivot's radius are
   never listed, so a group of n near copies costs n comparisons.
4. The links' connected components are the groups.

Nothing is capped: a hot cell, pivot or class meets only in sums or in joins that Spark splits. Tables are broadcast
only below ``SMALL_BYTES``, as measured.

Defined results: null, empty and blank texts have no shingles and link with nothing; a text of fewer than ``k`` words
has its word sequence as its only shingle; repeated rows get a result each; rows that share an id are one document,
whose links are those of all of them; a row without id has its count, links with nothing and is kept.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorlens.llm.components import components
from vendorlens.llm.jaccard import deal_shared, region_links
from vendorlens.llm.shingles import shingle_sets
from vendorlens.llm.tables import release, small, stored
from vendorlens.llm.textarrays import mix64, per_text

MISS = 1e-7  # chance that two sets of just the asked similarity share no cell
STRANGE = 1e-3  # chance that two sets of a fifth of it share one
U32, U64 = np.uint32, np.uint64
SLICE = 1024  # shingles whose coordinates are computed at a time


def banding(num: int, den: int) -> tuple[int, int]:
    """(bands, rows): the fewest rows a band that keep below ``STRANGE``, and the bands that keep below ``MISS``."""
    s, rows = num / den, 0
    while True:
        rows += 1
        bands = max(1, math.ceil(math.log(MISS) / math.log1p(-min(s ** rows, 1 - 1e-12))))
        if bands * (s / 5) ** rows < STRANGE:
            return bands, rows


def _pi(x: np.ndarray, t: np.ndarray) -> None:
    """The second permutation, in place: xor-shifts and odd multipliers, each a bijection of 2**32 values."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None)):
        np.right_shift(x, U32(shift), out=t)
        np.bitwise_xor(x, t, out=x)
        if factor:
            np.multiply(x, U32(factor), out=x)


def signatures(h: np.ndarray, row: np.ndarray, n: int, coordinates: int) -> np.ndarray:
    """The circulant MinHash (n, coordinates) of the sets given as hashes ordered by row; all ones where empty."""
    place = (mix64(h + U64(0x6A09E667F3BCC909)) >> U64(32)).astype(U32)
    shifts = np.arange(coordinates, dtype=U32)
    out = np.full((n, coordinates), 0xFFFFFFFF, U32)
    x, t = np.empty((SLICE, coordinates), U32), np.empty((SLICE, coordinates), U32)
    for at in range(0, len(place), SLICE):
        mine, rows = place[at:at + SLICE], row[at:at + SLICE]
        a, b = x[:len(mine)], t[:len(mine)]
        np.add(mine[:, None], shifts[None, :], out=a)
        _pi(a, b)
        start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        least = np.minimum.reduceat(a, start, axis=0)
        out[rows[start]] = np.minimum(out[rows[start]], least)
    return out


def _cells(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit cell per set and band."""
    by = signature.reshape(len(signature), bands, rows).astype(U64)
    cell = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=U64)), by.shape[:2]).copy()
    for j in range(rows):
        cell = mix64(cell * U64(0x9E3779B97F4A7C15) + by[:, :, j] + U64(1))
    return cell


def _names(h: np.ndarray, cut: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit name of each set, whatever the order of its members."""
    total = np.r_[np.zeros(1, U64), np.cumsum(mix64(h ^ U64(seed)), dtype=U64)]
    return mix64(total[cut[1:]] - total[cut[:-1]] + mix64(np.diff(cut).astype(U64))).view(np.int64)


def _signed(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, ``n`` (shingles), ``c1`` and ``c2`` (128 bits that name the set) and ``cells`` (none without shingles)."""
    def make():
        def fn(texts):
            ns, c1, c2, cells = [], [], [], []
            for n, h, row in shingle_sets(texts, k):
                cut = np.searchsorted(row, np.arange(n + 1))
                size = np.diff(cut)
                ns.append(size)
                c1.append(_names(h, cut, 0x243F6A8885A308D3))
                c2.append(_names(h, cut, 0x13198A2E03707344))
                full = size > 0
                flat = _cells(signatures(h, row, n, bands * rows)[full], bands, rows).reshape(-1).view(np.int64)
                ends = np.r_[0, np.cumsum(np.where(full, bands, 0))].astype(np.int32)
                cells.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            return [pa.array(np.concatenate(ns).astype(np.int64)), pa.array(np.concatenate(c1)), pa.array(np.concatenate(c2)),
                    pa.concat_arrays(cells)]
        return fn
    long = T.LongType()
    out = per_text(docs, ["doc_id"], [("n", long), ("c1", long), ("c2", long), ("cells", T.ArrayType(long))], make)
    return out.select(F.col("doc.doc_id").cast("long").alias("doc_id"), "n", "c1", "c2", "cells")


def _sets(docs: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """(cls, set as packed sorted hashes) of the classes ``known`` (rep, c1, c2), from the rows that name them."""
    def make():
        def fn(texts):
            c1, c2, sets = [], [], []
            for n, h, row in shingle_sets(texts, k):
                cut = np.searchsorted(row, np.arange(n + 1))
                c1.append(_names(h, cut, 0x243F6A8885A308D3))
                c2.append(_names(h, cut, 0x13198A2E03707344))
                sets += [h[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            return [pa.array(np.concatenate(c1)), pa.array(np.concatenate(c2)), pa.array(sets, pa.binary())]
        return fn
    wanted = small(known.select(F.col("rep").alias("doc_id"), F.col("c1").alias("w1"), F.col("c2").alias("w2")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id")
    out = per_text(rows, ["doc_id", "w1", "w2"], [("c1", T.LongType()), ("c2", T.LongType()), ("set", T.BinaryType())], make)
    return out.where("c1 = doc.w1 and c2 = doc.w2").select(F.col("doc.doc_id").alias("cls"), "set").distinct()


def _regions(classes: DataFrame) -> DataFrame:
    """(pivot, cls): the members of shared cells with the cell's pivot, the member that shares most (ties: least id)."""
    rows = classes.select(F.col("rep").alias("cls"), "cells")
    shared = stored(rows.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("size")).where("size > 1"))
    dealt, held = deal_shared(rows, shared)
    members = stored(dealt)
    if held:
        held.destroy()
    score = members.groupBy("cls").agg(F.sum("size").alias("score"))
    best = members.join(score, "cls").groupBy("cell").agg(F.max(F.struct("score", -F.col("cls")))["col2"].alias("least"))
    found = stored(members.select("cell", "cls").join(best, "cell").select((-F.col("least")).alias("pivot"), "cls")
                   .where("pivot <> cls").distinct())
    release(shared, members)
    return found


def near_copies(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``n_shingles``, ``component_id`` (the least id reachable by links of Jaccard
    similarity >= num / den, itself included) and ``kept`` (it is that id, or has none)."""
    bands, rows = banding(num, den)
    signed = stored(_signed(docs, k, bands, rows))
    named = signed.where("n > 0 and doc_id is not null")
    classes = stored(named.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.first("cells").alias("cells")))
    slim = stored(signed.select("doc_id", "n", "c1", "c2"))
    release(signed)
    regions = _regions(classes)
    touched = regions.select("cls").unionByName(regions.select(F.col("pivot").alias("cls"))).distinct()
    known = stored(classes.select("rep", "c1", "c2").join(touched.withColumnRenamed("cls", "rep"), "rep"))
    sets = stored(_sets(docs, known, k))
    links, read = region_links(regions, sets, num, den)
    named = stored(slim.where("n > 0 and doc_id is not null").join(small(classes.select("c1", "c2", "rep")), ["c1", "c2"]).select("doc_id", "n", "rep"))
    several = named.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where("b < last")
    one_id = named.join(several, "doc_id").select(F.col("rep").alias("a"), "b")
    found = stored(components(links.unionByName(one_id)).where("node <> root"))
    release(classes, regions, known, sets, *read)
    out = named.join(small(found.select(F.col("node").alias("rep"), "root")), "rep", "left").select("doc_id", "n", F.coalesce("root", "rep").alias("root"))
    alone = slim.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("root"))
    return out.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"),
                                         F.col("doc_id").eqNullSafe(F.col("root")).alias("kept"))
