"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame operations.

A text's parts are the distinct pieces that its line ends and its own content cut: a piece ends after two
bytes of given classes (about every 75 bytes of prose, every 32 of random bytes), wherever it stands, so an
edit changes the pieces that it touches and no others. A stretch without such an end, as texts of few different
characters have, is cut where two bytes recur three bytes later, and by length (``LONGEST`` bytes) only if
that does not occur either. Each part's 64-bit digest falls into one cell of each of three sub-tables; a cell
holds a count, the xor of the digests and the xor of their checks. Sketches of two texts subtract cell by
cell; a cell left with one digest gives it away, and taking it out of its other cells frees more (peeling).
If anything remains, the pair is retried with sketches four times larger; pairs that still fail after
``attempts`` (which only crafted digests do) are compared exactly.

The likeness of two texts is the Jaccard similarity of their part sets, from the number of recovered
differing digests. The ``fingerprint`` is the smallest sketch (``CELLS`` cells) as text.

Cells are summed with rows partitioned by pair, so nothing is shuffled per cell. Work per document follows
its length.

Defined results: a null text counts as empty; an empty text has no parts, two texts without parts have
likeness 1; rows that repeat both doc_id and text count once; texts that share a doc_id follow each other
by hash; null ids come first; the only document is its own successor.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlens.llm.tables import stored
from vendorlens.operators.ordered import running_totals

TABLES = 3
CELLS = 24
GROWTH = 4
ROOM = 4
ROUNDS = 4
LONGEST = 512


def _class(*rests: int) -> str:
    """The bytes with these rests modulo 8, as a class of characters of the first 256."""
    return "[" + "".join(f"\\x{c:02X}" for c in range(256) if c % 8 in rests and c != 10) + "]"


_ANY = rf"[^\x0A]{{1,{LONGEST}}}"
_BYTE = r"[^\x0A]"
_RECUR = rf"{_BYTE}{{32,{LONGEST - 5}}}?({_BYTE})({_BYTE}){_BYTE}\1\2"
PIECES = rf"{_ANY}?(?<={_class(6)}{_class(1, 2)})|{_RECUR}|{_ANY}"


def digests(text):
    """The distinct 64-bit digests of a text's parts."""
    # one character per byte, so that the classes serve every script
    data = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.array_distinct(F.transform(F.regexp_extract_all(data, F.lit(PIECES), 0), lambda x: F.xxhash64(x, F.lit(0))))


def check(digest):
    return F.xxhash64(digest, F.lit(11))


def cell(digest, table: int, cells):
    """The digest's cell in one sub-table."""
    return F.pmod(F.xxhash64(digest, F.lit(table)), cells / TABLES if isinstance(cells, int) else F.floor(cells / TABLES)).cast("long")


def fingerprint(keys, cells: int = CELLS):
    """The sketch of an array of digests as text: count.digests.checks of each cell in hexadecimal."""
    size = cells // TABLES
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))

    def at(i):
        return F.aggregate(keys, zero, lambda acc, k: F.when(
            F.pmod(F.xxhash64(k, F.floor(i / size).cast("int")), F.lit(size)) == i % size,
            F.struct((acc["n"] + 1).alias("n"), acc["k"].bitwiseXOR(k).alias("k"), acc["c"].bitwiseXOR(check(k)).alias("c"))).otherwise(acc),
            lambda acc: F.concat_ws(".", F.hex(acc["n"]), F.hex(acc["k"]), F.hex(acc["c"])))

    return F.lower(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), at), ","))


def _sum_cells(rows: DataFrame) -> DataFrame:
    rows = rows.groupBy("key", "m", "t", "cell").agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
    return rows.where((F.col("n") != 0) | (F.col("k") != 0) | (F.col("c") != 0))


def _row(t, at, n, k, c):
    return F.struct(t.cast("int").alias("t"), at.cast("long").alias("cell"), n.cast("long").alias("n"), k.alias("k"), c.alias("c"))


def _peel(rows: DataFrame, table: int) -> DataFrame:
    """Take the lone digests of one sub-table out of the others; they become rows of table ``TABLES``. A
    digest has one cell in the sub-table, so none is taken out twice."""
    k, n, c = F.col("k"), F.col("n"), F.col("c")
    lone = (F.col("t") == table) & (F.abs(n) == 1) & (c == check(k)) & (F.col("cell") == cell(k, table, F.col("m")))
    freed = F.array(_row(F.lit(TABLES), k, n, k, c),
                    *[_row(F.lit(t), cell(k, t, F.col("m")), -n, k, c) for t in range(TABLES) if t != table])
    same = F.array(_row(F.col("t"), F.col("cell"), n, k, c))
    return _sum_cells(rows.select("key", "m", F.inline(F.when(lone, freed).otherwise(same))))


def _attempt(pairs: DataFrame) -> DataFrame:
    """``pairs`` (key, m, a, b: arrays of digests) with ``left`` (cells that remain) and the recovered
    digests ``only_a`` and ``only_b``."""
    pairs = pairs.repartition("key")
    signed = F.concat(F.transform("a", lambda k: F.struct(k.alias("k"), F.lit(1).alias("n"))),
                      F.transform("b", lambda k: F.struct(k.alias("k"), F.lit(-1).alias("n"))))
    rows = pairs.select("key", "m", F.inline(signed))
    rows = rows.select("key", "m", F.inline(F.array(*[_row(F.lit(t), cell(F.col("k"), t, F.col("m")), F.col("n"), F.col("k"), check(F.col("k")))
                                                      for t in range(TABLES)])))
    rows = reduce(_peel, list(range(TABLES)) * ROUNDS, _sum_cells(rows))
    found = F.col("t") == TABLES
    ends = rows.groupBy("key").agg(F.count_if(~found).alias("left"),
                                   F.collect_list(F.when(found & (F.col("n") > 0), F.col("k"))).alias("only_a"),
                                   F.collect_list(F.when(found & (F.col("n") < 0), F.col("k"))).alias("only_b"))
    none = F.array().cast("array<bigint>")
    return pairs.join(ends, "key", "left").select(
        "key", "m", "a", "b", F.coalesce("left", F.lit(0)).alias("left"),
        F.coalesce("only_a", none).alias("only_a"), F.coalesce("only_b", none).alias("only_b"))


def differences(pairs: DataFrame, attempts: int = 6, lists: bool = True) -> DataFrame:
    """Per pair (key, a, b): ``key``, ``n_a``, ``n_b``, and the digests that only one side has, ``only_a``
    and ``only_b``, recovered from subtracted sketches; without ``lists`` how many they are. Sketches start with
    ``ROOM`` cells or more per digest of both sides, so that texts with nothing in common peel at once; only cells
    that digests fall into are rows, so the room costs no more of them."""
    only = ["only_a", "only_b"] if lists else [F.size(c).cast("long").alias(c) for c in ("only_a", "only_b")]
    sizes = [F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b")]
    wanted = (F.size("a") + F.size("b")) * ROOM
    grown = F.pow(F.lit(float(GROWTH)), F.greatest(F.lit(0.0), F.ceil(F.log(float(GROWTH), F.greatest(wanted / CELLS, F.lit(1.0))))))
    todo = pairs.select("key", "a", "b", (CELLS * grown).cast("long").alias("m"))
    done = []
    for _ in range(attempts):
        over = F.col("left") == 0
        keep = F.when(~over, F.col("a")).alias("a"), F.when(~over, F.col("b")).alias("b")
        result = stored(_attempt(todo).select("key", "m", "left", *sizes, *keep, *only))
        done.append(result.where(over).select("key", "n_a", "n_b", "only_a", "only_b"))
        todo = result.where(~over).select("key", "a", "b", (F.col("m") * GROWTH).alias("m"))
        if todo.isEmpty():
            break
    else:
        rest = todo.select("key", *sizes, F.array_except("a", "b").alias("only_a"), F.array_except("b", "a").alias("only_b"))
        done.append(rest.select("key", "n_a", "n_b", *only))
    return reduce(DataFrame.union, done)


def likeness():
    """Jaccard similarity from set sizes and the numbers of recovered differences."""
    total, differ = F.col("n_a") + F.col("n_b"), F.col("only_a") + F.col("only_b")
    return F.when(total == 0, 1.0).otherwise((total - differ) / (total + differ))


def successions(docs: DataFrame) -> DataFrame:
    """Per document: ``key``, ``before`` (the key of the document of which it is the successor, in ascending
    order, the first following the last) and ``wanted`` (how many characters that one takes of it)."""
    ids = stored(docs.select("key", F.length("text").alias("n")).distinct())
    ranked = stored(running_totals(ids, ["key.id", "key.hash"], row_number="rank"))
    n = ranked.count()
    before = ranked.select((F.col("rank") % max(n, 1) + 1).alias("rank"), F.col("key").alias("before"), F.floor(F.col("n") / 4).cast("int").alias("wanted"))
    return ranked.select("key", "rank").join(before, "rank").select("key", "before", "wanted")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every document with its edited text (the last quarter replaced by the start of its successor) and
    the digests of itself (``a``), the edited text (``e``) and the successor (``s``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # nullif makes the hash nullable, as it is when read back: keys of one type join without a second exchange
    hashed = F.nullif(F.xxhash64(text), F.lit(0).cast("long"))
    docs = docs.select(F.struct(F.col(id_col).alias("id"), hashed.alias("hash")).alias("key"), text.alias("text"))
    base = docs.dropDuplicates(["key"])
    sent = base.join(successions(docs), "key").select(
        F.col("before").alias("key"), F.expr("substring(text, 1, wanted)").alias("start"), digests(F.col("text")).alias("s"))
    both = base.join(sent, "key").withColumn("n", F.length("text"))
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, n - cast(floor(n / 4) as int))"), "start"))
    return both.select("key", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("e"), "s")
