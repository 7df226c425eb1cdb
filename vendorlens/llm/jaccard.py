"""Exact Jaccard join of word-shingle sets in metric space, and the groups that its links form.

1. Equal sets become one class. Rings of set sizes bound the symmetric difference of a linked pair; sets
   near a ring's edge enter the next ring too. Within a ring a set is dealt to more parts than a linked
   pair can differ in, so linked sets coincide in a part: they share a cell (``shingles.cells``).
   Linked sets share many cells, at least those that their differences cannot spoil; a set that shares fewer
   links with nothing and leaves.
2. Each shared cell takes a pivot, the member that shares most. All members of a pivot's cells form its
   region; a set stands in as many regions as it has pivots, so no linked pair is cut.
3. In a region every set is measured against the pivot. Those within the radius are linked to it, hence to
   each other's group. For the others the region is centred on the pivot: the difference of two sets is the
   difference of their differences from the pivot, so a set outside the radius can only link to a set that
   shares one of its first (radius + 1) difference shingles, gained shingles first, with enough differences
   left from there on in both. These pairs, and no others, are compared exactly. Pairs within the radius of one pivot are never emitted.
4. The links' connected components are the groups.

Copies are never expanded. Hot cells, pivots and classes meet only in sums, or in joins whose skewed
partitions Spark splits. Tables are broadcast only below ``tables.SMALL_BYTES``, as measured over their rows.

Defined results: null, empty and blank texts have no shingles and link with nothing; a text of fewer than
``k`` words has its word sequence as its only shingle; repeated rows get a result each; a null doc_id never
names a group (the group's least id that is not null does; a group without any links with nothing and has none).
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorlens.llm.components import components
from vendorlens.llm.shingles import RING_BITS, cells, shingle_sets
from vendorlens.llm.tables import is_small, release, small, stored
from vendorlens.llm.textarrays import mix64, per_text

TRIMS = 2  # rounds of dropping sets that share too few cells
FILTER_BITS = 26  # of the bitmap of shared cells, 8 MB
U64 = np.uint64


def _classes(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """One hash per set, whatever the order of its members."""
    total = np.r_[np.zeros(1, U64), np.cumsum(mix64(h + U64(0x2545F491)), dtype=U64)]
    return mix64(total[cut[1:]] - total[cut[:-1]] + mix64(np.diff(cut).astype(U64)))


def _signatures(docs: DataFrame, k: int, num: int, den: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, ``n`` (shingles), ``cls`` (null without shingles), ``cells`` and ``needs`` (ring, need)."""
    def make():
        def fn(texts):
            ns, classes, lists, needs = [], [], [], []
            for n, h, row in shingle_sets(texts, k):
                cut = np.searchsorted(row, np.arange(n + 1))
                size = np.diff(cut)
                ns.append(size)
                classes.append(pa.array(_classes(h, cut).view(np.int64), mask=size == 0))
                c, r, (who, ring, need) = cells(h, row, n, num, den)
                lists.append(_lists(r, n, lambda by: pa.array(c[by].view(np.int64))))
                needs.append(_lists(who, n, lambda by: pa.StructArray.from_arrays(
                    [pa.array(ring[by].astype(np.int64)), pa.array(need[by].astype(np.int64))], ["ring", "need"])))
            return [pa.array(np.concatenate(ns).astype(np.int64)), *map(pa.concat_arrays, (classes, lists, needs))]
        return fn
    need = T.StructType([T.StructField("ring", T.LongType()), T.StructField("need", T.LongType())])
    out = per_text(docs, ["doc_id", *keep], [("n", T.LongType()), ("cls", T.LongType()), ("cells", T.ArrayType(T.LongType())),
                                      ("needs", T.ArrayType(need))], make)
    return out.select("doc.doc_id", *[f"doc.{c}" for c in keep], "n", "cls", "cells", "needs")


def _lists(row: np.ndarray, n: int, values) -> pa.ListArray:
    """One list per row of the values that belong to it."""
    by = np.argsort(row, kind="stable")
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[by], np.arange(n + 1)).astype(np.int32)), values(by))


def _sets(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(cls, shingles as packed sorted hashes) of the member classes, from their least documents."""
    def make():
        def fn(texts):
            classes, sets = [], []
            for n, h, row in shingle_sets(texts, k):
                cut = np.searchsorted(row, np.arange(n + 1))
                classes.append(_classes(h, cut).view(np.int64))
                sets += [h[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            return [pa.array(np.concatenate(classes)), pa.array(sets, pa.binary())]
        return fn
    wanted = small(members.select(F.col("rep").alias("doc_id"), F.col("cls").alias("wanted")))
    rows = docs.select("doc_id", "text").join(wanted, "doc_id")
    out = per_text(rows, ["wanted"], [("cls", T.LongType()), ("set", T.BinaryType())], make)
    return out.where("cls = doc.wanted").select("cls", "set").dropDuplicates(["cls"])


def _linked(common: int, a: int, b: int, num: int, den: int) -> bool:
    return den * common >= num * (a + b - common)


def _against_pivot(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Per (pivot, cls) with both sets: whether they link, set size ``n``, size ``nd`` of the difference and
    its first shingles ``probe``: gained ones first, enough that a linked set shares one of them."""
    def run(batches):
        for batch in batches:
            link, n, nd, probe = [], [], [], []
            for x, p in zip(batch.column("x").to_pylist(), batch.column("p").to_pylist()):
                x, p = np.frombuffer(x, U64), np.frombuffer(p, U64)
                kept = np.isin(x, p, assume_unique=True)
                common = int(kept.sum())
                link.append(_linked(common, len(x), len(p), num, den))
                n.append(len(x))
                nd.append(len(x) + len(p) - 2 * common)
                need = len(x) * (den - num) // num + 1
                gained = x[~kept][:need]
                probe.append(gained.view(np.int64))
                if len(gained) < need:
                    probe[-1] = np.r_[gained, np.setdiff1d(p, x, assume_unique=True)[:need - len(gained)]].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("pivot"), batch.column("cls"), pa.array(link), pa.array(n, pa.int64()), pa.array(nd, pa.int64()),
                 pa.array(probe, pa.list_(pa.int64()))], ["pivot", "cls", "link", "n", "nd", "probe"])
    return rows.mapInArrow(run, "pivot long, cls long, link boolean, n long, nd long, probe array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes that link."""
    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                good.append(_linked(int(np.isin(x, y, assume_unique=True).sum()), len(x), len(y), num, den))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("x")), "a").join(
        sets.select(F.col("cls").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long")


def deal_shared(rows: DataFrame, shared: DataFrame):
    """(cls, cell, size): the cells of ``rows`` (cls, cells) that are among ``shared`` (cell, size), and the broadcast
    that reading them needs (or None). A small table of shared cells is broadcast itself. Of a larger one a bitmap of
    fixed size, 2 ** FILTER_BITS bits, goes ahead: cells whose bit is not set are shared by nobody and are not
    shuffled; those that pass by chance fall out in the join."""
    if is_small(shared):
        return rows.select("cls", F.explode("cells").alias("cell")).join(F.broadcast(shared), "cell"), None
    place = F.shiftrightunsigned("cell", RING_BITS).bitwiseAND((1 << FILTER_BITS) - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    words = shared.select(F.shiftright(place, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), U64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(U64)
    held = rows.sparkSession.sparkContext.broadcast(bitmap)

    def passing(batches):
        bits = held.value
        for batch in batches:
            cells = batch.column("cells")
            values = cells.flatten()
            at = (values.to_numpy(zero_copy_only=False).view(U64) >> U64(RING_BITS)) & U64((1 << FILTER_BITS) - 1)
            keep = (bits[at >> U64(6)] >> (at & U64(63))) & U64(1) == U64(1)
            ends = np.r_[0, np.cumsum(keep)][cells.offsets.to_numpy() - cells.offsets[0].as_py()]
            left = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values.filter(pa.array(keep)))
            out = pa.RecordBatch.from_arrays([batch.column("cls"), left], ["cls", "cells"])
            yield out.filter(pa.array(np.diff(ends) > 0))
    likely = rows.select("cls", "cells").where("cells is not null").mapInArrow(passing, "cls long, cells array<long>")
    return likely.select("cls", F.explode("cells").alias("cell")).join(shared, "cell"), held


def _regions(members: DataFrame) -> DataFrame:
    """(pivot, cls): every member of a shared cell with the cell's pivot."""
    score = members.groupBy("cls").agg(F.sum("size").alias("score"))
    scored = members.join(score, "cls")
    pivots = scored.groupBy("cell").agg(F.max(F.struct("score", "cls"))["cls"].alias("pivot"))
    return members.select("cell", "cls").join(pivots, "cell").where("cls <> pivot").select("pivot", "cls").distinct()


def _enough(members: DataFrame, needs: DataFrame) -> DataFrame:
    """The members (cell, cls, ring, size) that share as many cells of a ring as they need to link there, in
    cells that keep two of them."""
    count = members.groupBy("cls", "ring").agg(F.count("*").alias("c"))
    good = count.join(needs, ["cls", "ring"]).where("c >= need").select("cls", "ring")
    left = members.select("cell", "cls", "ring").join(good, ["cls", "ring"])
    again = left.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
    return left.join(again, "cell").select("cell", "cls", "ring", "size")


def _members(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(cell, cls, ring, size) of the classes in shared cells, each class once."""
    copies = signed.join(classes.where("c > 1"), "cls").where("doc_id is null or doc_id <> rep").select("doc_id", "cls").distinct()
    copies = stored(copies)
    same = signed["doc_id"].eqNullSafe(F.col("copy")) & (signed["cls"] == F.col("copied"))
    once = signed.join(small(copies.select(F.col("doc_id").alias("copy"), F.col("cls").alias("copied"))), same, "left_anti")
    once = once.select("cls", "cells")
    shared = stored(once.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("size")).where("size > 1"))
    dealt, held = deal_shared(once, shared)
    members = stored(dealt.distinct().withColumn("ring", F.col("cell").bitwiseAND((1 << RING_BITS) - 1)))
    if held:
        held.destroy()
    release(copies, shared)
    needs = signed.select("cls", F.inline("needs")).distinct()
    for _ in range(TRIMS):
        last, members = members, stored(_enough(members, needs))
        release(last)
    return members


def region_links(regions: DataFrame, sets: DataFrame, num: int, den: int):
    """The links (a, b) that determine the groups, between the sets (cls, set) that meet in a region (pivot, cls),
    and the stored tables that they read."""
    rows = regions.join(sets.select("cls", F.col("set").alias("x")), "cls").join(
        sets.select(F.col("cls").alias("pivot"), F.col("set").alias("p")), "pivot").select("pivot", "cls", "x", "p")
    measured = stored(_against_pivot(rows, num, den))
    near = measured.where("link").select(F.col("pivot").alias("a"), F.col("cls").alias("b"))
    probes = measured.select("pivot", F.posexplode("probe").alias("at", "shingle"), "cls", "n", "nd", "link")
    # cells of the centred region that hold a set outside the radius and another set
    useful = probes.groupBy("pivot", "shingle").agg(F.count("*").alias("c"), F.count_if(~F.col("link")).alias("far")).where("c > 1 and far > 0")
    probes = stored(probes.join(useful.select("pivot", "shingle"), ["pivot", "shingle"]))
    x, y = probes.where("not link").alias("x"), probes.alias("y")
    large, little = F.greatest("x.n", "y.n"), F.least("x.n", "y.n")
    # from their first common difference on, a linked pair has enough differences left to have in common
    left = F.least(F.col("x.nd") - F.col("x.at"), F.col("y.nd") - F.col("y.at"))
    pairs = x.join(y, (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.shingle") == F.col("y.shingle"))
                   & (F.col("y.link") | (F.col("x.cls") < F.col("y.cls"))) & (little * den >= large * num)
                   & (F.abs(F.col("x.nd") - F.col("y.nd")) * (den + num) <= (large + little) * (den - num))
                   & ((F.col("x.nd") + F.col("y.nd") - left * 2) * (den + num) <= (large + little) * (den - num)))
    pairs = pairs.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()
    return near.unionByName(_verified(pairs, sets, num, den)), (measured, probes)


def _links(docs: DataFrame, members: DataFrame, classes: DataFrame, k: int, num: int, den: int):
    """The links (a, b) between classes that determine the groups, and the stored tables that they read."""
    regions = stored(_regions(members))
    known = stored(classes.join(members.select("cls").distinct(), "cls").select("cls", "rep"))
    sets = stored(_sets(docs, known, k))
    links, read = region_links(regions, sets, num, den)
    return links, (regions, known, sets, *read)


def groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``n_shingles``, ``cls`` (the set's class, null without shingles), ``root``
    (the class that names the group) and ``component_id``, the least doc_id reachable by links; sets link at Jaccard
    similarity >= num / den. Columns ``keep`` of ``docs`` stay."""
    signed = stored(_signatures(docs, k, num, den, keep))
    kept = signed.where("cls is not null")
    classes = stored(kept.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")))
    members = _members(kept, classes)
    slim = stored(signed.select("doc_id", *keep, "n", "cls"))
    release(signed)
    kept, signed = slim.where("cls is not null"), slim
    links, read = _links(docs, members, classes, k, num, den)
    found = components(links)
    release(members, *read)
    named = classes.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("cls", "root", "component_id")
    out = kept.select("doc_id", *keep, "n", "cls").join(named, "cls").select(
        "doc_id", *keep, F.col("n").alias("n_shingles"), "cls", "root", "component_id")
    bare = signed.where("cls is null").select("doc_id", *keep, F.col("n").alias("n_shingles"), "cls", F.col("cls").alias("root"),
                                              F.col("doc_id").alias("component_id"))
    return out.unionByName(bare)


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each group: the row with the least doc_id, of different texts under that id the one
    with the least hash, of rows equal in both the least in its other columns. Texts that share an id without being
    near copies are documents of their own; so is each text without shingles; rows without id stay."""
    hashed = docs.withColumn("__text", F.xxhash64("text"))
    rows = stored(groups(hashed.where("doc_id is not null").select("doc_id", "text", "__text"), k, num, den, ("__text",)))
    texts = rows.groupBy("doc_id", "__text").agg(F.count("*").alias("c"), F.first("root").alias("root"))
    first = texts.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "__text", "c")).alias("k")).select("k.*")
    lead = stored(first.unionByName(texts.where("root is null").select("doc_id", "__text", "c")))
    key = ["doc_id", "__text"]
    once = hashed.join(small(lead.where("c = 1").select(*key)), key, "left_semi").select(*docs.columns)
    again = hashed.join(small(lead.where("c > 1").select(*key)), key, "left_semi").groupBy(*key).agg(
        F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")).select("row.*")
    return once.unionByName(again).unionByName(docs.where("doc_id is null"))
