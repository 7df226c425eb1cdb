"""Hard negatives: rows of another label whose score with an anchor is a little below that of a positive.

Every anchor is scored against all rows, exactly, by packed products (``kronecker``); there is no index that could
miss a row. Anchors are taken in blocks of about ``BLOCK`` distinct rows, which bounds what is broadcast; each block
is held against the rows in their partitions. Two passes a block: the positives (best rows of the same label), then
for each positive the best rows of other labels within its band. A task keeps the best few per anchor and positive,
and Spark merges those. Nothing of the size of anchors x rows is ever written.

Defined results: rows with a null id, label or vector, with a null, NaN or infinite component, or with one so large
that scores of its length could pass 64 bits, take no part; a shorter vector counts as ending in zeros; rows equal in
id, label and vector count once; an anchor's other rows are those with another id; an anchor without positives, or a
positive without negatives, has no result; a negative score has an empty band. Columns beyond id, label and vector
are not read.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendorlens.llm.kronecker import Packed, largest_component
from vendorlens.llm.tables import release, stored
from vendorlens.session import ensure_checkpoint_dir

BLOCK = 8192
TILE = 256  # anchors scored at a time
ROWS = 4096  # rows packed at a time
NOTHING = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Band:
    """``positives`` a anchor, ``negatives`` a positive; a negative's score lies between num / den of its
    positive's and its positive's."""

    positives: int = 5
    negatives: int = 5
    num: int = 80
    den: int = 100


def quantised(rows: DataFrame, key: str, label: Column, vector: str, scale: int = 256) -> DataFrame:
    """(id, label, v): rows that can take part, components as floor(scale * x) of x as double."""
    x = F.col(vector)
    usable = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    small = F.coalesce(F.forall(x, lambda c: F.abs(c.cast("double") * float(scale)) < float(1 << 31)), F.lit(False))
    out = rows.where(F.col(key).isNotNull() & label.isNotNull() & x.isNotNull() & usable & small).select(
        F.col(key).cast("long").alias("id"), label.cast("long").alias("label"),
        F.transform(x, lambda c: F.floor(c.cast("double") * float(scale)).cast("long")).alias("v"))
    limit = F.lit((1 << 63) - 1)
    widest = F.array_max(F.transform("v", F.abs))
    return out.where(widest.isNull() | (widest * widest <= F.floor(limit / F.greatest(F.size("v"), F.lit(1)))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The lists of a column as rows of ``dim`` values, shorter ones filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(column), dim), np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


class _Best:
    """The ``most`` best (score, id) of each slot: higher scores first, then smaller ids; equal pairs once."""

    def __init__(self, slots: int, most: int):
        self.slot, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.most = most
        self.last_score, self.last_id = np.full(slots, NOTHING), np.full(slots, np.iinfo(np.int64).max)

    def add(self, slot: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        good = (score > self.last_score[slot]) | ((score == self.last_score[slot]) & (key < self.last_id[slot]))
        if not good.any():
            return
        slot, score, key = (np.concatenate(p) for p in ((self.slot, slot[good]), (self.score, score[good]), (self.id, key[good])))
        order = np.lexsort((key, ~score, slot))
        slot, score, key = slot[order], score[order], key[order]
        new = np.ones(len(slot), bool)
        new[1:] = (slot[1:] != slot[:-1]) | (score[1:] != score[:-1]) | (key[1:] != key[:-1])
        slot, score, key = slot[new], score[new], key[new]
        first = np.searchsorted(slot, slot)
        rank = np.arange(len(slot)) - first
        keep = rank < self.most
        full = rank == self.most - 1
        self.last_score[slot[full]], self.last_id[slot[full]] = score[full], key[full]
        self.slot, self.score, self.id = slot[keep], score[keep], key[keep]


def _scored(rows: DataFrame, shared, slots: int, most: int, limits: tuple[int, int, int],
            hits: Callable) -> DataFrame:
    """(slot, score, id): the best of each slot over all ``rows``; ``shared`` is the broadcast block of anchors. ``hits(block, anchors, scores, ids, labels)``
    yields (slot, score, id) arrays of a tile."""
    dim, low, high = limits

    def run(batches):
        b, best = shared.value, _Best(slots, most)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
                packed = Packed(_matrix(part.column("v"), dim), low, high)
                for first in range(0, len(b["id"]), TILE):
                    anchors = slice(first, first + TILE)
                    for found in hits(b, anchors, packed.scores(b["v"][anchors]), ids, labels):
                        best.add(*found)
        yield pa.RecordBatch.from_pydict({"slot": best.slot, "score": best.score, "id": best.id})
    return rows.mapInArrow(run, "slot long, score long, id long")


def _merged(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc("id"))
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _positives(b, anchors, scores, ids, labels):
    same = (b["label"][anchors, None] == labels[None, :]) & (b["id"][anchors, None] != ids[None, :])
    a, c = np.nonzero(same)
    yield a + anchors.start, scores[a, c], ids[c]


def _negatives(b, anchors, scores, ids, labels):
    low, high = b["low"][anchors], b["high"][anchors]
    inside = (scores >= low.min(axis=1)[:, None]) & (scores <= high.max(axis=1)[:, None])
    inside &= b["label"][anchors, None] != labels[None, :]
    a, c = np.nonzero(inside)
    score, key = scores[a, c], ids[c]
    for p in range(low.shape[1]):
        good = (score >= low[a, p]) & (score <= high[a, p])
        yield (a[good] + anchors.start) * low.shape[1] + p, score[good], key[good]


def mine(rows: DataFrame, is_anchor: Column, band: Band = Band(), block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (id, label, v), as
    ``quantised`` makes them; ``is_anchor`` is a condition on ``id``."""
    spark, table = rows.sparkSession, stored(rows)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = table
    dim, low, high = rows.agg(F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    dim, low, high = dim or 0, min(low or 0, 0), max(high or 0, 0)
    if max(-low, high) > largest_component(dim):  # a shorter vector may hold larger components than the longest allows
        rows = rows.where(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0)) <= largest_component(dim))
        low, high = max(low, -largest_component(dim)), min(high, largest_component(dim))
    anchors = rows.where(is_anchor).distinct()
    blocks = -(-anchors.count() // block)
    anchors = stored(anchors.withColumn("block", F.pmod(F.xxhash64("id", "label", "v"), F.lit(max(blocks, 1)))))
    path = f"{ensure_checkpoint_dir(spark)}/negatives-{anchors.stored_at.rpartition('-')[2]}"
    spark.createDataFrame([], schema).write.parquet(path)
    limits = (dim, low, high)
    for n in range(blocks):
        part = anchors.where(F.col("block") == n).select("id", "label", "v").toArrow()
        if part.num_rows:
            _add_block(rows, part, limits, band, path)
    release(anchors, table)
    return spark.read.schema(schema).parquet(path)


def _add_block(rows: DataFrame, part: pa.Table, limits: tuple[int, int, int], band: Band, path: str) -> None:
    """Append the result of one block of anchors to ``path``."""
    spark, n = rows.sparkSession, part.num_rows
    b = {"id": part.column("id").to_numpy(), "label": part.column("label").to_numpy(), "v": _matrix(part.column("v"), limits[0])}
    shared = spark.sparkContext.broadcast(b)
    best = _merged(_scored(rows, shared, n, band.positives, limits, _positives), band.positives).toArrow()
    shared.destroy()
    slot, rank = best.column("slot").to_numpy(), best.column("rank").to_numpy() - 1
    score, key = best.column("score").to_numpy(), best.column("id").to_numpy()
    b["low"], b["high"] = np.zeros((n, band.positives), np.int64), np.full((n, band.positives), -1, np.int64)
    least = [-(-band.num * s // band.den) for s in score.tolist()]  # whole numbers of any size
    keep = np.array([m <= s for m, s in zip(least, score.tolist())], bool)  # else the band is empty
    b["low"][slot[keep], rank[keep]] = np.array(least, object)[keep].astype(np.int64)
    b["high"][slot[keep], rank[keep]] = score[keep]
    names = pa.table({"slot": slot * band.positives + rank, "anchor_id": b["id"][slot], "positive_id": key, "positive_score": score})
    shared = spark.sparkContext.broadcast(b)
    found = _merged(_scored(rows, shared, n * band.positives, band.negatives, limits, _negatives), band.negatives)
    told = F.broadcast(spark.createDataFrame(names))  # at most block x positives rows
    found.join(told, "slot").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                                    "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    shared.destroy()
