"""Hashed presence features and a cumulative-link (ordinal) regression on them.

A text's features are its distinct words (lower-cased A-Z, letters and digits) and punctuation runs,
hashed into 2**BITS slots; presence counts, not frequency, so a long text is judged like a short one.
Fitting uses a bounded sample of labelled rows (``max_rows``, taken in hash order, so it does not
depend on partitioning) and proximal gradient steps with an L1 penalty, then a refit on the support. Slots in fewer
than 5 of the sample's texts, or whose presence goes with the grade by less than ``least_z`` standard errors, are
screened out first: with all slots the penalty keeps twice as many weights and catches fewer held-out rows.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorlens.llm.textarrays import ALNUM_WORD, MARK_WORD, byte_chunks, id_text, per_text, word_hashes

BITS = 24
MAX_ROWS = 12_000


def slots(texts):
    """Yield (number of rows, distinct slots, row of each) for pieces of a batch, ordered by row."""
    for _, data, bounds in byte_chunks(texts):
        w, doc = word_hashes(data, bounds, ALNUM_WORD)
        m, mdoc = word_hashes(data, bounds, MARK_WORD)
        key = np.unique(np.r_[doc, mdoc].astype(np.uint64) << np.uint64(BITS) | np.r_[w, m] >> np.uint64(64 - BITS))
        yield len(bounds) - 1, (key & np.uint64((1 << BITS) - 1)).astype(np.uint32), (key >> np.uint64(BITS)).astype(np.int64)


def word_slot(word: str) -> int:
    """The slot of one word."""
    data = np.frombuffer(word.encode(), np.uint8)
    w, _ = word_hashes(data, np.array([0, len(data)]), ALNUM_WORD)
    return int(w[0] >> np.uint64(64 - BITS))


def slot_lists(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Struct ``doc`` with the kept columns and ``slots``, the distinct slots as packed 32-bit numbers."""
    def make():
        def fn(texts):
            out = []
            for n, slot, row in slots(texts):
                cut = np.searchsorted(row, np.arange(n + 1))
                out += [slot[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            return [pa.array(out, pa.binary())]
        return fn
    return per_text(docs, keep, [("slots", T.BinaryType())], make)


def labelled_sample(docs: DataFrame, labels: DataFrame, grade, allowed, max_rows: int = MAX_ROWS):
    """Slots and grades of at most ``max_rows`` labelled rows of ``docs``, in hash order; repeated label rows count once
    (the largest grade), null grades not at all. The sample's ids, ``max_rows`` at most, are broadcast; rows that
    share an id count singly."""
    rows = (labels.where(allowed).select("doc_id", grade.cast("int").alias("grade")).where("doc_id is not null and grade is not null")
            .groupBy("doc_id").agg(F.max("grade").alias("grade"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    texts = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").orderBy(
        F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(max_rows)
    got = slot_lists(texts, ["doc_id", "grade"]).select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.grade").alias("grade"), "slots").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("slots", "ascending")])
    return [np.frombuffer(b, np.uint32) for b in got.column("slots").to_pylist()], got.column("grade").to_numpy().astype(np.int64)


@dataclass
class Ordinal:
    """P(grade > k) = sigmoid(x.w - thresholds[k]), thresholds ascending."""

    slots: np.ndarray       # sorted slots with a weight
    weights: np.ndarray
    thresholds: np.ndarray

    def linear(self, n: int, slot: np.ndarray, row: np.ndarray) -> np.ndarray:
        if not len(self.slots) or not len(slot):
            return np.zeros(n)
        at = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
        return np.bincount(row, np.where(self.slots[at] == slot, self.weights[at], 0.0), n)

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return _sigmoid(z[:, None] - self.thresholds[None, :])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _select(lists, y, always, least_z: float):
    """Slots whose presence goes with the grade (z score of the grade sum), however many, plus those always wanted."""
    slot = np.concatenate(lists) if lists else np.empty(0, np.uint32)
    kinds, at = np.unique(slot, return_inverse=True)
    g = np.repeat(y.astype(float), [len(x) for x in lists])
    n = np.bincount(at, minlength=len(kinds))
    z = (np.bincount(at, g, len(kinds)) - n * y.mean()) / np.sqrt(np.maximum(n * y.var(), 1e-9))
    good = np.flatnonzero((np.abs(z) >= least_z) & (n >= 5))
    return np.union1d(kinds[good], np.array(sorted(always), np.uint32)).astype(np.uint32)


class _Csr:
    def __init__(self, lists, chosen):
        rows, cols = [], []
        for i, x in enumerate(lists):
            at = np.searchsorted(chosen, x)
            ok = at < len(chosen)
            ok[ok] = chosen[at[ok]] == x[ok]
            cols.append(at[ok])
            rows.append(np.full(int(ok.sum()), i))
        self.shape = len(lists), len(chosen)
        self.row = np.concatenate(rows) if rows else np.empty(0, np.int64)
        self.col = np.concatenate(cols) if cols else np.empty(0, np.int64)

    def dot(self, w):
        return np.bincount(self.row, w[self.col], self.shape[0])

    def tdot(self, r):
        return np.bincount(self.col, r[self.row], self.shape[1])


def fit_ordinal(lists: list[np.ndarray], y: np.ndarray, grades: int, swapped: list[tuple[int, np.ndarray]] = (),
                always: set[int] = frozenset(), swap_penalty: float = 1.0, l1: float = 1e-3, l2: float = 1e-4,
                least_z: float = 4.5, steps: int = 400) -> Ordinal:
    """Fit weights and thresholds. ``swapped``: (row, slots of the same text with identity terms swapped);
    the squared change of the linear score under a swap is penalised with ``swap_penalty``."""
    if not len(y):
        return Ordinal(np.empty(0, np.uint32), np.empty(0), np.arange(grades - 1, dtype=float))
    chosen = _select(lists, y, always, least_z)
    X = _Csr(lists, chosen)
    S = _Csr([s for _, s in swapped], chosen)
    base = np.array([i for i, _ in swapped], np.int64)
    most = max((len(np.setxor1d(lists[i], s)) for i, s in swapped), default=0)
    n, m = len(y), max(1, len(swapped))
    above = (y[:, None] > np.arange(grades - 1)[None, :]).astype(float)
    share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    theta0 = -np.log(share / (1 - share))

    def descend(w, theta, active, l1_, steps_):
        v = np.random.default_rng(0).random(len(w)) * active
        for _ in range(20):  # largest curvature, by power iteration
            v = X.tdot(X.dot(v)) / n + active * 1e-12
            norm = np.linalg.norm(v)
            v = v * active / max(norm, 1e-12)
        bound = 0.25 * (grades - 1) * (norm + 2) + 2 * swap_penalty * most + l2
        wk, tk, t = w.copy(), theta.copy(), 1.0
        for _ in range(steps_):
            z = X.dot(wk)
            gap = _sigmoid(z[:, None] - tk[None, :]) - above
            gw = X.tdot(gap.sum(1)) / n + l2 * wk
            if len(swapped):
                change = z[base] - S.dot(wk)
                back = np.bincount(base, change, n)
                gw += 2 * swap_penalty * (X.tdot(back) - S.tdot(change)) / m
            new = wk - gw * active / bound
            new = np.sign(new) * np.maximum(np.abs(new) - l1_ / bound, 0)
            nt = np.maximum.accumulate(tk + gap.mean(0) / bound * 4)
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            wk, tk = new + (t - 1) / t2 * (new - w), nt + (t - 1) / t2 * (nt - theta)
            w, theta, t = new, nt, t2
        return w, theta

    w, theta = descend(np.zeros(len(chosen)), theta0, np.ones(len(chosen)), l1, steps)
    active = (w != 0).astype(float)
    w, theta = descend(w, theta, active, 0.0, steps)
    used = np.flatnonzero(active)
    return Ordinal(chosen[used], w[used], np.maximum.accumulate(theta))
