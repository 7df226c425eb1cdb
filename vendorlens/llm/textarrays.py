"""Texts of an Arrow batch as one byte array with document bounds, and vectorised word hashing.

Everything here works on whole texts in pieces of about ``CHUNK`` bytes (a longer text is a piece of
its own), so memory follows the piece, not the batch. Null texts count as empty.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 1 << 19
ROWS = 500  # rows of a batch that are converted at a time
BASE = 0x9E3779B97F4A7C15
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUE = mix64(np.arange(1, 257, dtype=U64) * U64(BASE))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE_WORD = np.ones(256, bool)      # [^\x20\x09-\x0D]
SPACE_WORD[[32, *range(9, 14)]] = False
ALNUM_WORD = np.zeros(256, bool)     # [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
MARK_WORD = SPACE_WORD & ~ALNUM_WORD  # runs of punctuation
MARK_WORD[65:91] = False


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, U64), np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + 1)
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                a = np.full(size, b, U64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=U64))
        return self.up, self.down


POWERS = _Powers(BASE)
POWERS2 = _Powers(0xD6E8FEB86659FD93)


def byte_chunks(column, limit: int = CHUNK, fold: Callable | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, bounds): text i of the piece is bytes[bounds[i]:bounds[i + 1]].
    ``fold`` is applied to the texts first."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for first in range(0, len(column), ROWS):
        part = column.slice(first, ROWS)
        if fold:
            part = fold(part)
        if pa.types.is_string(part.type):
            part = part.cast(pa.binary())
        arr = pc.fill_null(part.cast(pa.large_binary()), b"")
        n = len(arr)
        offsets = np.frombuffer(arr.buffers()[1], np.int64, n + 1, arr.offset * 8)
        raw = arr.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
            yield first + lo, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
            lo = hi


def words(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray):
    """Starts, ends and document numbers of the maximal runs of word bytes; none crosses documents."""
    if not len(data):
        z = np.empty(0, np.int64)
        return z, z, z
    ok = is_word[data]
    full = bounds[1:] > bounds[:-1]
    before = np.empty_like(ok)
    before[1:] = ok[:-1]
    before[bounds[:-1][full]] = False
    after = np.empty_like(ok)
    after[:-1] = ok[1:]
    after[bounds[1:][full] - 1] = False
    starts = np.flatnonzero(ok & ~before)
    ends = np.flatnonzero(ok & ~after) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers = POWERS) -> np.ndarray:
    """64-bit hashes of data[starts:ends], equal for equal bytes wherever they stand."""
    up, down = powers.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUE[data] * up[:len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def word_hashes(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray):
    """Hashes and document numbers of the lower-cased (A-Z) words of a piece."""
    low = LOWER[data]
    starts, ends, doc = words(low, bounds, is_word)
    return span_hashes(low, starts, ends), doc


def per_text(docs: DataFrame, keep: list[str], fields: list[tuple[str, T.DataType]],
             make: Callable[[], Callable[[pa.Array], list]], text: str = "text") -> DataFrame:
    """Run ``make()(texts)`` over Arrow batches; return struct ``doc`` (the kept columns) and ``fields``.

    The kept columns travel inside a struct, so result names cannot clash with them."""
    schema = docs.schema
    kept = T.StructType([schema[c] for c in keep])
    out = T.StructType([T.StructField("doc", kept, True), *(T.StructField(n, t, True) for n, t in fields)])
    names = [n for n, _ in fields]
    cols = list(dict.fromkeys([*keep, text]))

    def run(batches):
        fn = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = batch.column(0)
            results = fn(pc.struct_field(doc, text))
            inner = pa.StructArray.from_arrays([pc.struct_field(doc, c) for c in keep], keep)
            yield pa.RecordBatch.from_arrays([inner, *results], ["doc", *names])

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("doc")).mapInArrow(run, out)


def id_text(column: str = "doc_id"):
    """The id as text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(modulus: int, column: str = "doc_id"):
    """crc32 of the id as text modulo ``modulus``."""
    return F.pmod(F.crc32(id_text(column).cast("binary")), F.lit(modulus))
