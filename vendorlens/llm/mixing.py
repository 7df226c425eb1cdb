"""Mixing sources to target weights with a time-varying curriculum, in DataFrame operations only.

Targets: sources share ``share`` times all words by weight, none above ``cap`` times its own words; the
excess is shared again by weight until none is above (water filling: the sources with the least cap per
weight are full, the others get one common level times their weight).

Each source's documents stand in a fixed pseudo-random order on a line of words; the mix takes the line
from its start, round again, up to the target. A source's weight schedule over training time, integrated,
is its cumulative demand; its inverse turns a place on the line into a training position in [0, 1), and
the documents are range-sorted by position.

A source may hold any share of the rows: running sums go over (source, hash bin of the id), 4096 bins a source, and the
bins' sums are pre-aggregated. Rows that share one id, or have none, share a bin.

Defined results: a null text has no words; a document without words takes nothing and has no position;
a null source is the last source; repeated rows are separate documents; the order hashes the id, ties by
size. Sources are few (one row each is ranked in one task); documents are not.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendorlens.llm.textarrays import id_text

WEIGHTS = (3, 1, 2)
#: Per source, repeating: the weight over training time as (time, factor) points, joined linearly.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)))
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: int) -> DataFrame:
    """(source, source_size) with ``number`` (from 0, by code point, null last), ``weight``, ``target``."""
    whole = Window.partitionBy()
    ranked = sizes.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")))
    most = F.col("source_size") * cap
    ranked = ranked.withColumn("ratio", most.cast("double") / F.col("weight"))
    before = Window.orderBy("ratio", "number").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "number").rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole)
    ranked = ranked.withColumn("level", (F.lit(share) * total - F.coalesce(F.sum(most).over(before), F.lit(0))) / F.sum("weight").over(after))
    # the first source that the common level does not fill sets the level
    ranked = ranked.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")),
                                                 F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "number"))).over(whole))
    return ranked.select("source", "source_size", "number", "weight",
                         F.coalesce(F.least(F.col("level") * F.col("weight"), most.cast("double")), F.lit(0.0)).alias("target"))


def invert(demand, number, schedules=SCHEDULES):
    """The time by which a source has used the fraction ``demand`` of its target: the inverse of its
    integrated schedule. Within a piece from weight a to b, the demand is a quadratic in time."""
    out = F.lit(None).cast("double")
    for n, points in enumerate(schedules):
        areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(points, points[1:])]
        whole, done, time = sum(areas), 0.0, F.lit(1.0)
        pieces = []
        for ((t0, a), (t1, b)), area in zip(zip(points, points[1:]), areas):
            left = (demand * whole - done)
            slope = (b - a) / (t1 - t0)
            at = F.lit(t0) + left * 2 / (F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + left * 2 * slope, F.lit(0.0))))
            pieces.append((demand * whole < done + area, at))
            done += area
        for test, at in reversed(pieces):
            time = F.when(test, at).otherwise(time)
        out = F.when(number % len(schedules) == n, time).otherwise(out)
    return out


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, cap: int = 2, schedules=SCHEDULES,
        carry: Sequence[str] = ()) -> DataFrame:
    """One row per document (doc_id, source, size, source_size, target, taken, position, position_2), sorted
    by ``position``: when its first words come. ``position_2`` is its place in the second round, if any.
    ``cap`` of at most 2 rounds; ``carry`` names further columns to keep, in front; one that is named like a result
    comes as ``doc_<name>``."""
    if cap > 2:
        raise ValueError("the mix goes round the documents twice at most")
    carried = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None)
    sized = docs.select(carried.alias("__doc"), "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
                        F.md5(id_text().cast("binary")).alias("order"))
    sized = sized.withColumn("bin", F.substring("order", 1, 3))
    bins = sized.select("source", "bin", "size").groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    goals = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, cap)
    line = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("bin_start", F.coalesce(F.sum("bin_size").over(line), F.lit(0)))
    # one row per source; the joined table has at most 4096 per source
    bins = bins.alias("b").join(goals.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select(
        F.col("b.source").alias("s"), F.col("b.bin").alias("k"), "bin_start", "source_size", "number", "target")
    rows = sized.join(bins, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("k")))
    within = Window.partitionBy("s", "bin").orderBy("order", "doc_id", "size")
    start = F.col("bin_start") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = rows.withColumn("start", start).withColumn("goal", F.floor("target"))

    def part(offset):
        return F.greatest(F.lit(0), F.least(F.col("goal") - F.col("start") - offset, F.col("size")))

    def when_due(taken, offset):
        due = invert((F.col("start") + offset + taken / 2) / F.col("goal"), F.col("number"), schedules)
        return F.round(F.when(taken > 0, due), 9)

    rows = rows.withColumn("first", part(F.lit(0))).withColumn("again", part(F.col("source_size")))
    taken_names = ("size", "source_size", "target", "taken", "position", "position_2")
    kept = [F.col(f"__doc.`{c}`").alias(f"doc_{c}" if c in taken_names else c) for c in carry]
    return rows.select(*kept, "doc_id", "source", "size", "source_size", "target", (F.col("first") + F.col("again")).alias("taken"),
                       when_due(F.col("first"), F.lit(0)).alias("position"),
                       when_due(F.col("again"), F.col("source_size")).alias("position_2")).orderBy(F.asc_nulls_last("position"), "doc_id")
