"""Removal of long byte strings that occur more than once in the corpus, with a run-length index.

A string of ``LENGTH`` bytes counts if it starts at two places at least, in one text or in two. One index
over the corpus would have to be built in one place, so equal strings are first brought together:

1. Every window of ``LENGTH`` bytes names an anchor, the k-gram in it with the least hash (the last one if
   tied). Equal windows have equal anchors at equal offsets. Consecutive windows with one anchor form a
   segment: about one in 137 bytes. Only (anchor, segment hash, text, place) is shuffled.
2. A segment that occurs twice is a repeat with all its windows; such copies collapse to one.
3. Where one anchor stands in different segments, a repeat may begin or end inside them. One copy of each
   such segment goes, with its bytes, to the block of its anchor, where a run-length index streams matching
   statistics (``runindex.py``): a window repeats where the match is at least ``LENGTH`` long. Blocks hold
   whole anchors, about ``BLOCK`` bytes each.
4. An anchor with more than ``HOT`` different segments (a passage in very many contexts) is not put into one
   block: its windows are counted by hash over the cluster, in sums that combine before the shuffle.

Hashes of windows and segments have 64 bits besides the anchor's 64. Texts are keyed by a 64-bit hash of id
and text.

``shared_passages`` does the same with words instead of bytes, for passages that stand in two texts but may be too
short to be removed. Its segments are short lists of words, so windows are counted by hash instead of indexed; a
segment that stands in two texts counts once, with the least and the greatest key of its texts.

Defined results: a null text is empty; texts shorter than ``LENGTH`` keep everything; rows that repeat a
text, with or without the id, are repeats of each other; each row gets a result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorlens.llm.runindex import RunIndex
from vendorlens.llm.tables import release, stored
from vendorlens.llm.textarrays import BYTE_VALUE, POWERS, POWERS2, SPACE_WORD, byte_chunks, mix64, word_hashes

LENGTH = 400
GRAM = 128
BLOCK = 1 << 18
HOT = 1000
PIECE = 1 << 20
PASSAGE = 51
WORD_GRAM = 16
BROADCAST_ROWS = 500_000
U64 = np.uint64
_LOW = U64((1 << 24) - 1)


def _totals(data: np.ndarray, powers):
    values = BYTE_VALUE[data] if data.dtype == np.uint8 else data
    up, down = powers.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[:len(values)], out=total[1:])
    return total, down


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(v)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(U64).max, U64)
    padded[:n] = v
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def segments(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Segments of the texts in a piece of bytes or word hashes: (text number, first window, windows, anchor hash,
    segment hash)."""
    n = len(data)
    if n < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, U64, U64))
    total, down = _totals(data, POWERS)
    h = mix64((total[gram:] - total[:-gram]) * down[:n - gram + 1])
    least = _least((h & ~_LOW) | (_LOW - np.arange(len(h), dtype=U64)), length - gram + 1)
    anchor = (_LOW - (least & _LOW)).astype(np.int64)  # place of the anchor of window s
    edge = np.zeros(n + 1, np.int64)
    long_ = bounds[1:] - bounds[:-1] >= length
    np.add.at(edge, bounds[:-1][long_], 1)
    np.add.at(edge, bounds[1:][long_] - length + 1, -1)
    valid = np.cumsum(edge)[:len(anchor)] > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    # the last length - 1 places of a text start no window, so runs of two texts never touch
    last = valid.copy()
    last[:-1] &= ~valid[1:] | new[1:]
    first, end = np.flatnonzero(new), np.flatnonzero(last) + 1
    total2, down2 = _totals(data, POWERS2)
    seg = mix64((total2[end - 1 + length] - total2[first]) * down2[first] + (end - first).astype(U64))
    doc = np.searchsorted(bounds, first, "right") - 1
    return doc, first - bounds[doc], end - first, h[anchor[first]], seg


def word_chunks(texts):
    """Like ``byte_chunks``, with a hash a word instead of bytes."""
    for row, data, bounds in byte_chunks(texts):
        hashes, doc = word_hashes(data, bounds, SPACE_WORD)
        yield row, hashes, np.searchsorted(doc, np.arange(len(bounds)))


def _pieces(chunks, length: int):
    """The chunks, with the first row and the offset in the text; a very long text comes in pieces
    that overlap by ``length`` - 1."""
    for row, data, bounds in chunks:
        if len(data) <= PIECE:
            yield row, 0, data, bounds
            continue
        for lo in range(0, len(data), PIECE):
            part = data[lo:lo + PIECE + length - 1]
            yield row, lo, part, np.array([0, len(part)])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"), "doc_id", "text")


def _all_segments(docs: DataFrame, length: int, gram: int, chunks=byte_chunks) -> DataFrame:
    names = ["key", "anchor", "seg", "start", "windows"]

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for row, offset, data, bounds in _pieces(chunks(batch.column(1)), length):
                doc, first, windows, anchor, seg = segments(data, bounds, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(keys[row + doc]), pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64)),
                                                  pa.array(first + offset), pa.array(windows)], names)
    return docs.select("key", "text").mapInArrow(run, "key long, anchor long, seg long, start long, windows long")


def _small(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Broadcast ``df`` if it, or the table of which its rows are lists, has few rows."""
    rows = df if counted is None else counted
    return F.broadcast(df) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _with_texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(key, text, places) of the texts that have places; rows that repeat id and text come once."""
    lists = places.groupBy("key").agg(F.collect_list(F.struct(*[c for c in places.columns if c != "key"])).alias("places"))
    return docs.join(_small(lists, places), "key").select("key", "text", "places").dropDuplicates(["key"])


def _cut(rows: DataFrame, length: int) -> DataFrame:
    """(anchor, key, start, bytes) of each place."""
    names = ["anchor", "key", "start", "bytes"]

    def run(batches):
        for batch in batches:
            keys, places = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for row, data, bounds in byte_chunks(batch.column(1)):
                out = [], [], [], []
                for i in range(len(bounds) - 1):
                    text = data[bounds[i]:bounds[i + 1]]
                    for p in places[row + i]:
                        for c, v in zip(out, (p["anchor"], keys[row + i], p["start"],
                                              text[p["start"]:p["start"] + p["windows"] + length - 1].tobytes())):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names)
    return rows.mapInArrow(run, "anchor long, key long, start long, bytes binary")


def _indexed(cut: DataFrame, length: int, block: int) -> DataFrame:
    """(key, start, windows): runs of windows that repeat, found by the run-length index of each block."""
    names = ["key", "start", "windows"]

    def solve(rows):
        index = RunIndex([np.frombuffer(b, np.uint8) for _, _, b in rows])
        stats = index.matching_statistics()
        out = [], [], []
        for i, (key, start, _) in enumerate(rows):
            hit = np.r_[False, index.longest(i, stats) >= length, False]
            edge = np.flatnonzero(hit[1:] != hit[:-1])
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                for c, v in zip(out, (key, start + a, b - a)):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    def run(batches):
        held, size, group, last = [], 0, [], None
        for batch in batches:
            for anchor, key, start, data in zip(*(c.to_pylist() for c in batch.columns)):
                if anchor != last:
                    held, group, last = held + group, [], anchor
                    if size > block:
                        yield solve(held)
                        held, size = [], 0
                group.append((key, start, data))
                size += len(data)
        if held or group:
            yield solve(held + group)
    return cut.repartition("anchor").sortWithinPartitions("anchor", "key", "start").mapInArrow(run, "key long, start long, windows long")


def _counted(rows: DataFrame, length: int) -> DataFrame:
    """The same for hot anchors: windows counted by hash."""
    names = ["anchor", "window", "key", "start"]

    def run(batches):
        for batch in batches:
            for anchor, key, start, raw in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.frombuffer(raw, np.uint8)
                total, down = _totals(data, POWERS2)
                n = len(data) - length + 1
                h = mix64((total[length:] - total[:n]) * down[:n])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, anchor)), pa.array(h.view(np.int64)), pa.array(np.full(n, key)),
                                                  pa.array(np.arange(start, start + n))], names)
    windows = rows.mapInArrow(run, "anchor long, window long, key long, start long")
    twice = windows.groupBy("anchor", "window").agg(F.count("*").alias("c")).where("c > 1").select("anchor", "window")
    return windows.join(twice, ["anchor", "window"]).select("key", "start", F.lit(1).cast("long").alias("windows"))


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, hot: int = HOT):
    """(key, start, windows): runs of window starts that repeat, for ``docs`` (key, text), which may overlap;
    and the stored tables that this reads."""
    every = stored(_all_segments(docs, length, gram))
    anchors = stored(every.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"))
    some = stored(every.join(_small(anchors), "anchor"))
    release(every, anchors)
    kinds = stored(some.groupBy("anchor", "seg").agg(F.count("*").alias("c"), F.min(F.struct("key", "start", "windows")).alias("one")))
    whole = some.join(kinds.where("c > 1").select("anchor", "seg"), ["anchor", "seg"]).select("key", "start", "windows")
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    parts = stored(kinds.join(mixed, "anchor").select("anchor", "one.key", "one.start", "one.windows", "kinds"))
    cut = _cut(_with_texts(docs, parts), length)
    if parts.where(F.col("kinds") > hot).isEmpty():
        return whole.unionByName(_indexed(cut, length, block)), (some, kinds, parts)
    cut = stored(cut)
    heated = _small(parts.where(F.col("kinds") > hot).select("anchor").distinct())
    runs = whole.unionByName(_indexed(cut.join(heated, "anchor", "left_anti"), length, block)).unionByName(
        _counted(cut.join(heated, "anchor", "left_semi"), length))
    return runs, (some, kinds, parts, cut)


def _passage_windows(rows: DataFrame, length: int) -> DataFrame:
    """(anchor, seg, lo, hi, offset, window hash) of the windows of each place."""
    names = ["anchor", "seg", "lo", "hi", "offset", "window"]

    def run(batches):
        for batch in batches:
            places = batch.column(2).to_pylist()
            for row, data, bounds in word_chunks(batch.column(1)):
                total, down = _totals(data, POWERS2)
                out = []
                for i in range(len(bounds) - 1):
                    for p in places[row + i]:
                        at = np.arange(p["windows"]) + (bounds[i] + p["start"])
                        h = mix64((total[at + length] - total[at]) * down[at])
                        out.append([np.full(len(at), p[c]) for c in names[:4]] + [np.arange(len(at)), h.view(np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def shared_passages(docs: DataFrame, length: int = PASSAGE, gram: int = WORD_GRAM) -> DataFrame:
    """(key, words): how many words of a text of ``docs`` (key, text) lie in passages of ``length`` words that also
    stand in a text with another key. Words are as for shingles: lower-cased (A-Z), between white space."""
    every = stored(_all_segments(docs, length, gram, word_chunks))
    ends = F.min("key").alias("lo"), F.max("key").alias("hi")
    anchors = stored(every.groupBy("anchor").agg(*ends).where("lo < hi").select("anchor"))
    some = stored(every.join(_small(anchors), "anchor"))
    release(every, anchors)
    kinds = stored(some.groupBy("anchor", "seg").agg(*ends, F.min(F.struct("key", "start", "windows")).alias("one")))
    whole = some.join(kinds.where("lo < hi").select("anchor", "seg"), ["anchor", "seg"]).select("key", "start", "windows")
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    parts = stored(kinds.join(mixed, "anchor").select("anchor", "seg", "lo", "hi", "one.key", "one.start", "one.windows"))
    windows = stored(_passage_windows(_with_texts(docs, parts), length))
    twice = windows.groupBy("anchor", "window").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("anchor", "window")
    inside = windows.where("lo = hi").join(twice, ["anchor", "window"]).select("anchor", "seg", "offset")
    single = some.join(inside, ["anchor", "seg"]).select("key", (F.col("start") + F.col("offset")).alias("start"), F.lit(1).cast("long").alias("windows"))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = stored(spans(whole.unionByName(single), length).select("key", covered.alias("words")))
    release(some, kinds, parts, windows)
    return out


def spans(runs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, spans): the maximal runs [start, end) that the windows cover."""
    order = Window.partitionBy("key").orderBy("start", "end")
    each = runs.select("key", "start", (F.col("start") + F.col("windows") - 1 + length).alias("end")).groupBy("key", "start").agg(F.max("end").alias("end"))
    each = each.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    each = each.withColumn("run", F.count_if(F.col("reach").isNull() | (F.col("start") > F.col("reach"))).over(order))
    merged = each.groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, hot: int = HOT, passage: int = 0) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): struct ``doc`` with doc_id, ``n_bytes``, ``spans`` (the removed byte
    runs, maximal), ``n_removed``, ``kept`` (the remaining bytes) and, if ``passage`` is given, ``shared_words``: the
    words in passages of so many words that also stand in a row with another id or text (``shared_passages``)."""
    keyed = _keyed(docs)
    runs, read = repeated_windows(keyed, length, gram, block, hot)
    found = stored(spans(runs, length))
    release(*read)
    if passage:
        found = stored(found.join(shared_passages(keyed, passage), "key", "full").withColumnRenamed("words", "shared_words"))
    more = found.columns[2:]
    rows = keyed.join(_small(found, found.select(F.explode_outer("spans"))), "key", "left").select("doc_id", "text", "spans", *more)

    def run(batches):
        for batch in batches:
            doc = batch.column(0)
            for row, data, bounds in byte_chunks(doc.field("text")):
                n, cut, kept = [], [], []
                part = doc.slice(row, len(bounds) - 1)
                held = part.field("spans").to_pylist()
                for i in range(len(bounds) - 1):
                    text, at, parts = data[bounds[i]:bounds[i + 1]], 0, []
                    for s in held[i] or []:
                        parts.append(text[at:s["start"]].tobytes())
                        at = s["end"]
                    parts.append(text[at:].tobytes())
                    n.append(len(text))
                    kept.append(b"".join(parts))
                    cut.append(len(text) - len(kept[-1]))
                inner = pa.StructArray.from_arrays([part.field("doc_id")], ["doc_id"])
                yield pa.RecordBatch.from_arrays([inner, pa.array(n, pa.int64()), pa.array(cut, pa.int64()), part.field("spans"), pa.array(kept, pa.binary()),
                                                  *map(part.field, more)], ["doc", "n_bytes", "n_removed", "spans", "kept", *more])

    out = T.StructType([T.StructField("doc", T.StructType([rows.schema["doc_id"]])), T.StructField("n_bytes", T.LongType()),
                        T.StructField("n_removed", T.LongType()), rows.schema["spans"], T.StructField("kept", T.BinaryType()),
                        *(rows.schema[c] for c in more)])
    return rows.select(F.struct("doc_id", "text", "spans", *more).alias("doc")).mapInArrow(run, out)
