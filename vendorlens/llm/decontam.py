"""Benchmark decontamination with a generalised suffix automaton over the test items' words.

The items' words (lower-cased A-Z, ``ALNUM_WORD``) build one automaton per shard of about
``shard_words`` words. One shard is broadcast at a time: a benchmark of one shard is held against the documents in
one pass; a larger one in a pass per shard, with the hits stored between and merged by text, and each shard given up
before the next one is collected. Items longer than ``PIECE_WORDS`` enter in pieces that overlap by a window less
one word, so no item is larger than a shard. Document words stream through the automaton, which tracks the longest match ending
at each word: a match of ``window`` words means that a window of some item ends there. An item shorter
than a window is one window as a whole. Only stretches whose every word pair occurs in the items can
hold a window, so all other words are passed over with array operations.

``cut_windows`` takes the hit runs out of the texts. Taking one out brings the words on both sides together,
so a text is searched again until no run beyond the limits is left.

Defined results: a null or empty text has no words and is never contaminated; repeated rows are judged
each for itself; items without words or without id are ignored; rows that share an item id are one item.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorlens.llm.tables import release, small, stored
from vendorlens.llm.textarrays import ALNUM_WORD, LOWER, byte_chunks, mix64, per_text, span_hashes, word_hashes, words

WINDOW = 13
SHARD_WORDS = 200_000
PIECE_WORDS = 50_000


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def add(self, sequence) -> None:
        last = 0
        for t in sequence:
            last = self._extend(last, t)

    def _copy(self, p: int, q: int, t) -> int:
        """Split state q: a copy of it ends the strings that reach it from p by t."""
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = c
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, t) -> int:
        q = self.next[last].get(t)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, q, t)
        cur = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][t]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._copy(p, q, t)
        return cur

    def matches(self, sequence):
        """For each word, the length of the longest match that ends there."""
        state, n, out = 0, 0, []
        for t in sequence:
            while state and t not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if t in self.next[state]:
                state = self.next[state][t]
                n += 1
            out.append(n)
        return out


class Shard:
    """The automaton of some items, their windows, and sorted arrays that tell where to look."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.window, self.automaton, owners = window, Automaton(), {}
        pairs, singles, shortest = [np.empty(0, np.uint64)], [], window
        for item, seq in items:
            size = min(window, len(seq))
            if len(seq) == 1:
                singles.append(int(seq[0]))
            else:
                pairs.append(pair_keys(seq))
                shortest = min(shortest, size)
            toks = seq.tolist()
            self.automaton.add(toks)
            for i in range(len(toks) - size + 1):
                owners.setdefault(tuple(toks[i:i + size]), set()).add(item)
        self.owners = {k: sorted(v) for k, v in owners.items()}
        self.sizes = sorted({len(k) for k in owners if 1 < len(k) < window})
        self.pairs = np.unique(np.concatenate(pairs))
        self.singles = np.unique(np.array(singles, np.uint64))
        self.shortest = shortest

    def find(self, w: np.ndarray, doc: np.ndarray):
        """Yield (first word, end, items) of each window occurrence in the words of a piece."""
        if len(self.singles):
            for i in np.flatnonzero(np.isin(w, self.singles)).tolist():
                yield i, i + 1, self.owners[(int(w[i]),)]
        if len(w) < 2 or not len(self.pairs):
            return
        keys = pair_keys(w)
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        known = np.r_[False, (self.pairs[at] == keys) & (doc[1:] == doc[:-1]), False]
        edges = np.flatnonzero(known[1:] != known[:-1])
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if hi - lo + 1 < self.shortest:
                continue
            toks = w[lo:hi + 1].tolist()
            for i, n in enumerate(self.automaton.matches(toks)):
                for size in self.sizes:
                    if n >= size and (items := self.owners.get(tuple(toks[i + 1 - size:i + 1]))):
                        yield lo + i + 1 - size, lo + i + 1, items
                if n >= self.window:
                    yield lo + i + 1 - self.window, lo + i + 1, self.owners[tuple(toks[i + 1 - self.window:i + 1])]


def pair_keys(w: np.ndarray) -> np.ndarray:
    return mix64(w[:-1] * np.uint64(3) + mix64(w[1:]))


def item_words(benchmark: DataFrame, window: int, piece: int = PIECE_WORDS) -> DataFrame:
    """(item_id, w): the word hashes of every item, of those beyond ``piece`` words in overlapping pieces."""
    def make():
        def fn(texts):
            out = []
            for _, data, bounds in byte_chunks(texts):
                w, doc = word_hashes(data, bounds, ALNUM_WORD)
                cut = np.searchsorted(doc, np.arange(len(bounds))).tolist()
                for a, b in zip(cut, cut[1:]):
                    out.append([w[i:min(b, i + piece + window - 1)].tobytes() for i in range(a, b, piece)
                                if i == a or b - i >= window])
            return [pa.array(out, pa.list_(pa.binary()))]
        return fn

    rows = per_text(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null"),
                    ["item_id"], [("pieces", T.ArrayType(T.BinaryType()))], make)
    return rows.select("doc.item_id", F.explode("pieces").alias("w"))


def shards(benchmark: DataFrame, window: int, shard_words: int) -> tuple[int, DataFrame]:
    """How many shards the benchmark takes, and its pieces (item_id, w) with the number of their ``shard``."""
    pieces = stored(item_words(benchmark, window, min(PIECE_WORDS, shard_words)))
    total = pieces.agg(F.sum(F.octet_length("w"))).first()[0] or 0
    n = max(1, -(-total // (8 * shard_words)))
    return n, pieces.withColumn("shard", F.pmod(F.xxhash64("item_id", "w"), F.lit(n)))


def _shard(pieces: DataFrame, number: int, window: int) -> Shard:
    """One shard, of about ``shard_words`` words."""
    held = pieces.where(F.col("shard") == number).select("item_id", "w").orderBy("item_id", "w").toArrow()
    return Shard([(i, np.frombuffer(w, np.uint64)) for i, w in zip(held.column("item_id").to_pylist(), held.column("w").to_pylist())], window)


def _marked(held, data: np.ndarray, bounds: np.ndarray):
    """Per text of a piece the number of its first word (and of all), per word its start and end in the piece and
    whether a window covers it, and the items found by text."""
    low = LOWER[data]
    starts, ends, doc = words(low, bounds, ALNUM_WORD)
    w = span_hashes(low, starts, ends)
    marks = np.zeros(len(w) + 1, np.int32)
    found: dict[int, set] = {}
    for lo, hi, owners in held.value.find(w, doc):
        marks[lo] += 1
        marks[hi] -= 1
        found.setdefault(int(doc[lo]), set()).update(owners)
    return np.searchsorted(doc, np.arange(len(bounds))), starts, ends, np.cumsum(marks[:-1]) > 0, found


def _runs(inside: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of covered words."""
    part = np.r_[False, inside, False]
    edges = np.flatnonzero(part[1:] != part[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_RUN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_KEY = "__text_key"


def _found(docs: DataFrame, keep: list[str], held) -> DataFrame:
    """``find_windows`` against one shard."""
    def make():
        def fn(texts):
            n_words, n_hit, hits, items = [], [], [], []
            for _, data, bounds in byte_chunks(texts):
                cut, _, _, inside, found = _marked(held, data, bounds)
                n_words += np.diff(cut).tolist()
                for d, (a, b) in enumerate(zip(cut.tolist(), cut[1:].tolist())):
                    if d not in found:
                        n_hit.append(0)
                        hits.append([])
                        items.append([])
                        continue
                    n_hit.append(int(inside[a:b].sum()))
                    hits.append([{"start": x, "end": y} for x, y in _runs(inside[a:b])])
                    items.append(sorted(found[d]))
            return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(hits, pa.list_(_RUN)),
                    pa.array(items, pa.list_(pa.string()))]
        return fn
    return per_text(docs, keep, [("n_words", T.LongType()), ("n_hit", T.LongType()), ("hits", _RUNS), ("items", T.ArrayType(T.StringType()))], make)


def _union(runs: list[dict]) -> list[dict]:
    """The maximal runs that some runs cover together."""
    out: list[dict] = []
    for r in sorted(runs, key=lambda r: r["start"]):
        if out and r["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], r["end"])
        else:
            out.append(dict(r))
    return out


def _in_rounds(keyed: DataFrame, n: int, pieces: DataFrame, window: int) -> DataFrame:
    """(key, n_words, n_hit, hits, items) of the distinct texts of ``keyed`` (``_KEY``, text) that hold a window, from
    a pass per shard."""
    parts = []
    for i in range(n):
        held = keyed.sparkSession.sparkContext.broadcast(_shard(pieces, i, window))
        hit = _found(keyed, [_KEY], held).where("n_hit > 0").select(F.col(f"doc.{_KEY}").alias("key"), "n_words", "hits", "items")
        parts.append(stored(hit.dropDuplicates(["key"])))
        held.destroy()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # at most a row a shard
    by = every.groupBy("key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"),
                                  F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def merge(batches):
        for batch in batches:
            runs = [_union(r) for r in batch.column("hits").to_pylist()]
            hit = [sum(r["end"] - r["start"] for r in rs) for rs in runs]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_words"), pa.array(hit, pa.int64()),
                                              pa.array(runs, pa.list_(_RUN)), batch.column("items")], ["key", "n_words", "n_hit", "hits", "items"])
    out = stored(by.mapInArrow(merge, "key string, n_words long, n_hit long, hits array<struct<start:long,end:long>>, items array<string>"))
    release(*parts)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of their text: what a text holds does not depend on its row."""
    return docs.withColumn(_KEY, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def _counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Struct ``doc`` (kept columns and key) and ``n_words`` of every row."""
    def make():
        def fn(texts):
            out = [np.bincount(words(LOWER[data], bounds, ALNUM_WORD)[2], minlength=len(bounds) - 1) for _, data, bounds in byte_chunks(texts)]
            return [pa.array(np.concatenate(out).astype(np.int64))]
        return fn
    return per_text(docs, [*keep, _KEY], [("n_words", T.LongType())], make)


def find_windows(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, keep: list[str],
                 window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per row of ``docs``: struct ``doc`` with the kept columns, ``n_words``, ``n_hit`` (words inside an
    occurrence of a window), ``hits`` (the maximal hit runs as word positions [start, end)) and ``items``
    (the ids of items with occurring windows, sorted as strings)."""
    n, pieces = shards(benchmark, window, shard_words)
    if n == 1:
        return _found(docs, keep, spark.sparkContext.broadcast(_shard(pieces, 0, window)))
    rows = _keyed(docs)
    found = _in_rounds(rows.select(_KEY, "text"), n, pieces, window).drop("n_words")
    out = _counted(rows, keep).join(small(found), F.col(f"doc.{_KEY}") == F.col("key"), "left")
    return out.select(F.struct(*[F.col(f"doc.`{c}`") for c in keep]).alias("doc"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("hits", F.array().cast(_RUNS)).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _without(text: np.ndarray, over: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    left = np.ones(len(text), bool)
    for a, b in over:
        left[starts[a]:ends[b - 1]] = False
    return text[left]


def _cut_in_rounds(keyed: DataFrame, n: int, pieces: DataFrame, window: int, max_words: int, max_share: float) -> DataFrame:
    """(key, n_hit, n_cut, cut_text) of the distinct texts that hold a window. Texts that were cut are searched again,
    all shards over, until none is cut any more."""
    def cut(batches):
        for batch in batches:
            gone, texts = [], []
            for text, runs, words_ in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), batch.column("whole").to_pylist()):
                data = np.frombuffer(text.encode(), np.uint8)
                over = [(r["start"], r["end"]) for r in runs if r["end"] - r["start"] > max_words or r["end"] - r["start"] > max_share * words_]
                starts, ends, _ = words(LOWER[data], np.array([0, len(data)]), ALNUM_WORD)
                gone.append(sum(b - a for a, b in over))
                texts.append(_without(data, over, starts, ends).tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("whole"), pa.array(gone, pa.int64()), pa.array(texts, pa.string())],
                                             ["key", "whole", "gone", "text"])
    first = _in_rounds(keyed, n, pieces, window)
    state = stored(keyed.select(F.col(_KEY).alias("key"), "text").join(small(first.select("key", F.col("n_words").alias("whole"))), "key")
                   .dropDuplicates(["key"]).select("key", "whole", F.lit(0).cast("long").alias("n_cut"), "text"))
    done, found = None, first
    while True:
        rows = state.join(small(found.select("key", "hits")), "key")
        new = rows.select("key", "whole", "text", "hits").mapInArrow(cut, "key string, whole long, gone long, text string")
        new = stored(new.join(small(state.select("key", "n_cut")), "key").withColumn("n_cut", F.col("n_cut") + F.col("gone")))
        again = new.where("gone > 0").select("key", "whole", "n_cut", "text")
        ended = state.join(small(again.select("key")), "key", "left_anti")
        done = ended if done is None else done.unionByName(ended)
        state = stored(again)
        if state.isEmpty():
            break
        found = _in_rounds(state.select(F.col("key").alias(_KEY), "text"), n, pieces, window)
    out = done.select("key", "n_cut", F.when(F.col("n_cut") > 0, F.col("text")).alias("cut_text"))
    return out.join(small(first.select("key", "n_hit")), "key")


def cut_windows(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, keep: list[str], max_words: int = 0,
                max_share: float = 1.0, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per row of ``docs``: struct ``doc`` with the kept columns, ``n_words`` and ``n_hit`` as in ``find_windows``,
    ``n_cut`` (words taken out) and ``cut_text`` (null where nothing was cut): the text without the hit runs of
    more than ``max_words`` words or more than the share ``max_share`` of the text's words."""
    n, pieces = shards(benchmark, window, shard_words)
    if n > 1:
        rows = _keyed(docs)
        found = stored(_cut_in_rounds(rows.select(_KEY, "text"), n, pieces, window, max_words, max_share))
        out = _counted(rows, keep).join(small(found), F.col(f"doc.{_KEY}") == F.col("key"), "left")
        return out.select(F.struct(*[F.col(f"doc.`{c}`") for c in keep]).alias("doc"), "n_words",
                          *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_hit", "n_cut")], "cut_text")
    held = spark.sparkContext.broadcast(_shard(pieces, 0, window))

    def cut_out(text: np.ndarray, n: int) -> tuple[int, bytes]:
        """How many words went, and what is left of a text of ``n`` words."""
        gone = 0
        while True:
            _, starts, ends, inside, _ = _marked(held, text, np.array([0, len(text)]))
            over = [(a, b) for a, b in _runs(inside) if b - a > max_words or b - a > max_share * n]
            if not over:
                return gone, text.tobytes()
            gone += sum(b - a for a, b in over)
            text = _without(text, over, starts, ends)

    def make():
        def fn(texts):
            n_words, n_hit, n_cut, out = [], [], [], []
            for _, data, bounds in byte_chunks(texts):
                cut, _, _, inside, found = _marked(held, data, bounds)
                n_words += np.diff(cut).tolist()
                for d, (a, b) in enumerate(zip(cut.tolist(), cut[1:].tolist())):
                    gone, text = cut_out(data[bounds[d]:bounds[d + 1]], b - a) if d in found else (0, b"")
                    n_hit.append(int(inside[a:b].sum()) if d in found else 0)
                    n_cut.append(gone)
                    # word bytes include all beyond ASCII, so no character is cut in two
                    out.append(text.decode("utf-8", "replace") if gone else None)
            return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_cut, pa.int64()), pa.array(out, pa.string())]
        return fn

    return per_text(docs, keep, [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_cut", T.LongType()),
                                 ("cut_text", T.StringType())], make)


def is_contaminated(n_hit, n_words, per: int = 20):
    """The coverage limit: at least one word in ``per`` is hit."""
    return (n_hit > 0) & (n_hit * per >= n_words)
