"""Language identification with interpolated Kneser-Ney character models, one per language.

Text is lower-cased; every run of non-letters becomes one space; four spaces stand before a text.
Spark counts the 4-grams of all labelled training texts; lower orders use continuation counts (in how
many different left contexts a gram occurs), absolute discounting interpolates the orders. Probabilities and
back-offs are Spark aggregations too; their sorted rows make up the models, so scoring is a binary search
per distinct gram; unseen grams back off. A text gets the language with the least
cross-entropy per character. ``accepted`` says whether that entropy lies within the ``quantile`` of
the training texts of that language (calibrated rejection).

No gram is left out. ``max_grams`` bounds the rows of a shard of the models: driver and workers hold one
shard at a time, and more grams give more shards, which every group of pieces is held against in turn.

Defined results: null texts and texts without letters get ``und`` and score 0; rows without language
never train; without training rows everything is ``und``. Ties go to the first language by name.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorlens.llm.tables import stored
from vendorlens.llm.textarrays import byte_chunks, per_text
from vendorlens.session import materialize

ORDER = 4
MAX_GRAMS = 2_000_000
FLUSH_GRAMS = 1_000_000
GROUP_GRAMS = 4_000_000
DISCOUNT = 0.75
U64 = np.uint64
HASH = U64(0x9E3779B97F4A7C15)
_SYMBOL = np.array([c if chr(c).isalpha() else 32 for c in range(0x10000)], np.uint64)
_SYMBOL[0xD800:0xE000] = 32
OTHER_LETTER = U64(0xFFFE)  # letters outside the basic plane


def grams(texts):
    """Yield (first row, packed 4-grams, row number of each, letters per row) for pieces of a batch."""
    for first, data, bounds in byte_chunks(texts, fold=pc.utf8_lower):
        code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        at = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][bounds]
        sym = _SYMBOL[np.minimum(code, 0xFFFF)]
        far = np.flatnonzero(code > 0xFFFF)
        if len(far):
            sym[far] = [OTHER_LETTER if chr(c).isalpha() else U64(32) for c in code[far]]
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(at))
        letter = sym != 32
        letters = np.bincount(row[letter], minlength=len(bounds) - 1)
        keep = letter.copy()
        keep[1:] |= letter[:-1] & (row[1:] == row[:-1])
        sym, row = sym[keep], row[keep]
        out = np.full(len(sym) + 4 * (len(bounds) - 1), 32, np.uint64)
        where = np.arange(len(sym)) + 4 * (row + 1)
        out[where] = sym
        packed = out.copy()
        for k in (1, 2, 3):
            packed[k:] |= out[:-k] << U64(16 * k)
        yield first, packed[where], row, letters


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each 4-gram occurs in the texts of each language."""
    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def merged(parts):
            keys = np.concatenate([k for k, _ in parts])
            keys, at = np.unique(keys, return_inverse=True)
            return keys, np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)

        def rows(parts, lang):
            keys, n = merged(parts)
            for lo in range(0, len(keys), 100_000):
                k = keys[lo:lo + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n[lo:lo + 100_000])], ["lang", "gram", "n"])

        for batch in batches:
            langs = batch.column(0)
            for lang in pc.unique(langs).to_pylist():
                for _, g, _, _ in grams(batch.column(1).filter(pc.equal(langs, lang))):
                    held.setdefault(lang, []).append(np.unique(g, return_counts=True))
                    size += len(held[lang][-1][0])
                if size > FLUSH_GRAMS:
                    held = {x: [merged(p)] for x, p in held.items()}
                    size = sum(len(p[0][0]) for p in held.values())
                    if size > FLUSH_GRAMS // 2:
                        for x, p in held.items():
                            yield from rows(p, x)
                        held, size = {}, 0
        for x, p in held.items():
            yield from rows(p, x)

    part = docs.select(F.col("lang").cast("string").alias("lang"), "text").where("lang is not null and text is not null")
    return (part.mapInArrow(run, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


class Model:
    """The same models built from arrays in one place: sorted hash arrays per order with log probabilities in every language, and back-off weights."""

    def __init__(self, languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.languages = languages
        self.keys, self.logp, self.back = {}, {}, {}
        size = max(1, len(languages))
        mask = [U64((1 << (16 * k)) - 1) for k in range(ORDER + 1)]
        alphabet = len(np.unique(gram & mask[1])) + 1
        self.floor = np.full(size, -np.log(alphabet), np.float32)
        # per language and order: distinct grams with their (continuation) counts
        counts = {}
        for x in range(len(languages)):
            g, c = gram[lang == x], n[lang == x].astype(np.float64)
            by = np.argsort(g)
            counts[x, ORDER] = g[by], c[by]
            for k in range(ORDER - 1, 0, -1):
                counts[x, k] = tuple(np.unique(counts[x, k + 1][0] & mask[k], return_counts=True))
        lower = None
        for k in range(1, ORDER + 1):
            union = np.unique(np.concatenate([counts[x, k][0] for x in range(len(languages))] or [np.empty(0, U64)]))
            contexts = np.unique(union >> U64(16))
            p = np.zeros((len(union), size))
            back = np.ones((len(contexts), size))
            below = np.full((len(union), size), 1.0 / alphabet) if lower is None else lower[1][np.searchsorted(lower[0], union & mask[k - 1])]
            ctx = np.searchsorted(contexts, union >> U64(16))
            for x in range(len(languages)):
                g, c = counts[x, k]
                at = np.searchsorted(union, g)
                total = np.bincount(ctx[at], c, len(contexts))
                kinds = np.bincount(ctx[at], minlength=len(contexts))
                seen = total > 0
                back[seen, x] = DISCOUNT * kinds[seen] / total[seen]
                p[at, x] = (c - DISCOUNT) / total[ctx[at]]
            p += back[ctx] * below
            lower = union, p
            for name, keys, values in (("p", union, p), ("b", contexts, back)):
                h = keys * HASH
                by = np.argsort(h)
                self.keys[name, k] = h[by]
                (self.logp if name == "p" else self.back)[k] = np.log(values[by]).astype(np.float32)

    def score(self, packed: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of each gram's last character after the others, in every language."""
        if order == 0:
            return np.broadcast_to(self.floor, (len(packed), len(self.floor)))
        grams_ = packed & U64((1 << (16 * order)) - 1)
        out = np.empty((len(packed), len(self.floor)), np.float32)
        at, hit = self._find("p", order, grams_)
        out[hit] = self.logp[order][at[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            part = self.score(grams_[miss], order - 1).copy()
            at, hit = self._find("b", order, grams_[miss] >> U64(16))
            part[hit] += self.back[order][at[hit]]
            out[miss] = part
        return out

    def _find(self, name: str, order: int, keys: np.ndarray):
        held = self.keys[name, order]
        if not len(held):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        h = keys * HASH
        at = np.minimum(np.searchsorted(held, h), len(held) - 1)
        return at, held[at] == h


def model_rows(counts: DataFrame) -> tuple[list[str], int, DataFrame]:
    """The languages, the size of the alphabet and (part, gram, lang, value): for order k, part 2k - 1 holds the log
    probability of every gram of every language, part 2k the log back-off of every context. ``lang`` is the number
    of the language. Nothing is left out."""
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        low = F.col("gram").bitwiseAND(F.lit((1 << (16 * k)) - 1))
        levels[k] = levels[k + 1].groupBy("lang", low.alias("gram")).agg(F.count("*").alias("n"))
    levels[1] = stored(levels[1])
    languages = sorted(r.lang for r in levels[1].select("lang").distinct().collect())  # one row per language
    alphabet = levels[1].select("gram").distinct().count() + 1
    # a context has at most as many rows as the alphabet
    context = Window.partitionBy("lang", "context")
    below, parts = None, []
    for k in range(1, ORDER + 1):
        total, kinds = F.sum("n").over(context), F.count("*").over(context)
        rows = levels[k].withColumn("context", F.shiftrightunsigned("gram", 16)).select(
            "lang", "gram", "context", ((F.col("n") - DISCOUNT) / total).alias("own"), (DISCOUNT * kinds / total).alias("back"))
        backs = rows.groupBy("lang", F.col("context").alias("gram")).agg(F.max("back").alias("p"))
        if below is None:
            rows = rows.withColumn("lower", F.lit(1.0 / alphabet))
        else:
            low = F.col("gram").bitwiseAND(F.lit((1 << (16 * (k - 1))) - 1))
            rows = rows.withColumn("low", low).join(below.select("lang", F.col("gram").alias("low"), F.col("p").alias("lower")), ["lang", "low"])
        below = stored(rows.select("lang", "gram", (F.col("own") + F.col("back") * F.col("lower")).alias("p")))
        parts += [(2 * k - 1, below), (2 * k, backs)]
    numbers = F.broadcast(counts.sparkSession.createDataFrame(list(enumerate(languages)), "number int, lang string"))
    rows = reduce(DataFrame.unionByName, [x.select(F.lit(t).alias("part"), "lang", "gram", F.log("p").cast("float").alias("value")) for t, x in parts])
    return languages, alphabet, rows.join(numbers, "lang").select("part", "gram", F.col("number").alias("lang"), "value")


class Shard:
    """Sorted arrays of some of the model's rows."""

    def __init__(self, rows: pa.Table):
        part, gram = rows.column("part").to_numpy(), rows.column("gram").to_numpy().view(np.uint64)
        lang, value = rows.column("lang").to_numpy(), rows.column("value").to_numpy()
        by = np.lexsort((gram, part))
        self.starts = np.searchsorted(part[by], np.arange(1, 2 * ORDER + 2))
        self.gram, self.lang, self.value = gram[by], lang[by], value[by]

    def fill(self, part: int, keys: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
        """Set out[at] for the sorted keys of a part that are here, in the languages that know them."""
        held = slice(self.starts[part - 1], self.starts[part])
        lo, hi = np.searchsorted(self.gram[held], keys), np.searchsorted(self.gram[held], keys, "right")
        n = hi - lo
        row = np.repeat(np.arange(len(keys)), n)
        where = held.start + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]
        out[at[row], self.lang[where]] = self.value[where]


class ShardedModel:
    """All grams of all languages in broadcast shards, of which a worker holds one at a time."""

    def __init__(self, languages: list[str], alphabet: int, held: list):
        self.languages, self.held = languages, held
        self.floor = np.full(max(1, len(languages)), -np.log(alphabet), np.float32)

    def score(self, kinds: np.ndarray) -> np.ndarray:
        """Log probability of each gram's last character after the others, in every language; ``kinds`` ascend."""
        parts = {}
        for k in range(1, ORDER + 1):
            low = kinds & U64((1 << (16 * k)) - 1)
            for part, keys in ((2 * k - 1, low), (2 * k, low >> U64(16))):
                keys, at = np.unique(keys, return_inverse=True)
                parts[part] = keys, at, np.full((len(keys), len(self.floor)), np.nan if part % 2 else 0, np.float32)
        for i, b in enumerate(self.held):
            shard = b.value
            for part, (keys, _, out) in parts.items():
                here = np.flatnonzero(keys.view(np.int64) % len(self.held) == i)
                shard.fill(part, keys[here], here, out)
            del shard
            if len(self.held) > 1 and getattr(b, "_path", None):
                vars(b).pop("_value", None)  # the next use reads the executor's file again
        score = np.broadcast_to(self.floor, (len(kinds), len(self.floor)))
        for k in range(1, ORDER + 1):
            (_, at, p), (_, ctx, back) = parts[2 * k - 1], parts[2 * k]
            known = p[at]
            score = np.where(np.isnan(known), score + back[ctx], known)
        return score


def train(spark: SparkSession, docs: DataFrame, max_grams: int = MAX_GRAMS) -> ShardedModel:
    """Fit the models on ``docs`` (lang, text), in shards of about ``max_grams`` rows."""
    counts = stored(count_grams(docs))
    languages, alphabet, rows = model_rows(counts)
    rows = stored(rows)
    n = -(-rows.count() // max_grams) | 1  # odd, so that every character of a gram has a say in its shard
    shard = F.pmod(F.col("gram"), F.lit(n))
    if n > 1:
        # sorted, so that reading one shard skips the others
        rows = stored(rows.withColumn("shard", shard.cast("int")).repartition(n, "shard").sortWithinPartitions("shard"))
    held = []
    for i in range(n):
        part = rows.where(F.col("shard") == i) if n > 1 else rows
        held.append(spark.sparkContext.broadcast(Shard(part.select("part", "gram", "lang", "value").toArrow())))
        vars(held[-1]).pop("_value", None)  # the driver keeps none of them
    return ShardedModel(languages, alphabet, held)


def entropies(docs: DataFrame, model: ShardedModel, keep: list[str], sharpness: int = 24) -> DataFrame:
    """Struct ``doc`` with the kept columns, ``lang_pred``, ``score`` (posterior of the prediction with
    each text weighed as ``sharpness`` characters at most) and ``entropy`` (nats per character)."""
    m: ShardedModel = model

    def make():
        def pieces(texts):
            """Pieces scored together: several of them if every scoring reads all shards."""
            group, size = [], 0
            for _, packed, row, letters in grams(texts):
                kinds, at = np.unique(packed, return_inverse=True)
                group.append((kinds, at.astype(np.int32), row.astype(np.int32), letters))
                size += len(packed)
                if len(m.held) == 1 or size > GROUP_GRAMS:
                    yield group
                    group, size = [], 0
            if group:
                yield group

        def fn(texts):
            pred, score, ent = [], [], []
            for group in pieces(texts):
                every = group[0][0] if len(group) == 1 else np.unique(np.concatenate([k for k, *_ in group]))
                every_score = m.score(every)
                for kinds, at, row, letters in group:
                    n = np.bincount(row, minlength=len(letters))
                    has = (letters > 0) & bool(m.languages)
                    sums = np.zeros((len(letters), len(m.floor)))
                    if has.any():
                        table = every_score[np.searchsorted(every, kinds)]
                        for x in range(table.shape[1]):
                            sums[:, x] = np.bincount(row, table[:, x][at], len(letters))
                    h = -sums / np.maximum(n, 1)[:, None]
                    best = h.argmin(1)
                    low = h[np.arange(len(h)), best]
                    odds = np.exp(-(h - low[:, None]) * np.minimum(n, sharpness)[:, None])
                    pred += [m.languages[b] if ok else "und" for b, ok in zip(best, has)]
                    score.append(np.where(has, 1 / odds.sum(1), 0.0))
                    ent.append(np.where(has, low, np.nan))
            return [pa.array(pred, pa.string()), pa.array(np.concatenate(score)),
                    pa.array(np.concatenate(ent), from_pandas=True)]
        return fn

    return per_text(docs, keep, [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("entropy", T.DoubleType())], make)


def identify(spark: SparkSession, docs: DataFrame, training, keep: list[str], max_grams: int = MAX_GRAMS,
             quantile: float = 0.999) -> DataFrame:
    """``entropies`` of every row plus ``accepted``; ``training`` is the condition for rows to learn from."""
    marked = docs.withColumn("_training", F.coalesce(training & F.col("lang").isNotNull(), F.lit(False)))
    model = train(spark, marked.where("_training"), max_grams)
    scored = materialize(entropies(marked, model, [*keep, *(c for c in ("lang", "_training") if c not in keep)]))
    limits = (scored.where(F.col("doc._training") & (F.col("doc.lang") == F.col("lang_pred")))
              .groupBy(F.col("lang_pred").alias("limit_lang"))
              .agg(F.percentile_approx("entropy", quantile, 10_000).alias("entropy_limit")))
    # the limits have one row per language
    out = scored.join(F.broadcast(limits), F.col("lang_pred") == F.col("limit_lang"), "left")
    return out.select(F.struct(*[F.col(f"doc.`{c}`") for c in keep]).alias("doc"), "lang_pred", "score", "entropy",
                      F.coalesce(F.col("entropy") <= F.col("entropy_limit"), F.lit(False)).alias("accepted"))
