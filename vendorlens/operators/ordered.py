"""Ordered operators that must not collapse into one task.

``Window.orderBy(...)`` without ``partitionBy`` plans ``Exchange SinglePartition``: every row of a
supplier-sized (or bigger) table would pass through one task. ``running_totals`` computes the same
ROWS-frame results with a range partition:

1. range-partition on (segment, order keys) — the order must be total, so even a value shared by
   a third of the rows is split across tasks — and tag each row with its partition id;
2. checkpoint to the session's reliable checkpoint folder, which pins the partition assignment
   (a retried task after an executor loss reads the same rows) and cuts the lineage;
3. aggregate per (partition id, segment): at most partitions + segments rows;
4. prefix those totals with a window per segment, broadcast the ones of segments that began in an earlier
   partition (at most one per partition), and add them to an in-partition running window.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendorlens.session import ensure_checkpoint_dir

_PID = "__rt_pid"


def _as_sort(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def running_totals(df: DataFrame, order_by: Sequence, sums: dict[str, Column] | None = None,
                   row_number: str | None = None, segment_by: Sequence[str] = (),
                   partitions: int | None = None, following: dict[str, Column] | None = None) -> DataFrame:
    """Append exact running sums (ROWS frame, unbounded preceding to current row) and an optional
    1-based row number, ordered by ``order_by`` within each ``segment_by`` group (global when empty).

    ``order_by`` must make the order total (append a unique key); ``sums`` maps output names to
    Column expressions of ``df`` to be accumulated. ``following`` maps output names to expressions whose value
    in the segment's next row is appended, NULL in its last row; where a segment goes on in a later partition,
    that partition's first row is handed to the last row before it.
    """
    sums = dict(sums or {})
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [_as_sort(c) for c in order_by]
    seg = list(segment_by)

    vals = {f"__rt_v{i}": expr for i, expr in enumerate(sums.values())}
    ahead = {f"__rt_f{i}": expr for i, expr in enumerate((following or {}).values())}
    staged = df.select("*", *[e.alias(k) for k, e in (vals | ahead).items()])
    # Plain reliable checkpoint: the staged rows are usually cheap to recompute relative to their
    # size (e.g. a weight-sweep fan-out), so they are not held in memory while being written.
    ranged = (staged.repartitionByRange(n, *[F.col(s) for s in seg], *order_cols)
              .withColumn(_PID, F.spark_partition_id())
              .checkpoint(eager=True))

    part = ranged.groupBy(_PID, *seg).agg(
        F.count(F.lit(1)).alias("__rt_n"), *[F.sum(k).alias(k + "_t") for k in vals])
    before = Window.partitionBy(*seg).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.select(
        _PID, *seg,
        F.coalesce(F.sum("__rt_n").over(before), F.lit(0)).alias("__rt_n_off"),
        *[F.sum(k + "_t").over(before).alias(k + "_off") for k in vals])

    local = (Window.partitionBy(_PID, *seg).orderBy(*order_cols)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a segment has an offset only where it began in an earlier partition: at most one segment per partition
    offsets = offsets.where("__rt_n_off > 0").withColumnsRenamed({c: f"__rt_k{i}" for i, c in enumerate([_PID, *seg])})
    same = [ranged[c].eqNullSafe(offsets[f"__rt_k{i}"]) for i, c in enumerate([_PID, *seg])]
    out = ranged.join(F.broadcast(offsets), same, "left")
    exprs = []
    if row_number:
        exprs.append((F.coalesce("__rt_n_off", F.lit(0)) + F.row_number().over(local)).alias(row_number))
    for (name, _), k in zip(sums.items(), vals):
        exprs.append((F.coalesce(F.col(k + "_off"), F.lit(0)) + F.sum(k).over(local)).alias(name))
    if ahead:
        order = Window.partitionBy(_PID, *seg).orderBy(*order_cols)
        first = ranged.withColumn("__rt_r", F.row_number().over(order)).where("__rt_r = 1")
        later = Window.partitionBy(*seg).orderBy(_PID)
        # a segment goes on in a later partition at most once per partition
        border = first.select(_PID, *seg, F.lead(F.struct(*ahead)).over(later).alias("__rt_border")).where(
            "__rt_border is not null").withColumnsRenamed({c: f"__rt_b{i}" for i, c in enumerate([_PID, *seg])})
        out = out.join(F.broadcast(border), [out[c].eqNullSafe(border[f"__rt_b{i}"]) for i, c in enumerate([_PID, *seg])], "left")
        inside = F.lead(F.lit(True)).over(order)
        exprs += [F.when(inside, F.lead(k).over(order)).otherwise(F.col(f"__rt_border.{k}")).alias(name)
                  for name, k in zip(following, ahead)]
    keep = [c for c in df.columns]
    return out.select(*keep, *exprs)


def join_common(df: DataFrame, lookup: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """``df`` left-joined with ``lookup`` on ``keys``, of which ``lookup`` has each combination once, with the
    number of its rows in ``df`` as ``count``. Combinations with more than a task's even share of the rows are
    broadcast (there are fewer of them than tasks), the others shuffled, and rows with a NULL key go past both:
    no task gets all rows of a common value."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = lookup.select(F.sum(count)).scalar()
    values = [c for c in lookup.columns if c not in keys]
    heavy = F.broadcast(lookup.where(F.col(count) * tasks > total))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    common = df.join(heavy, list(keys))
    rare = df.where(known).join(heavy.select(*keys), list(keys), "left_anti").join(
        lookup.where(F.col(count) * tasks <= total), list(keys), "left")
    null = df.where(~known).select("*", *[F.lit(None).cast(lookup.schema[c].dataType).alias(c) for c in values])
    out = [*df.columns, *values]
    return common.select(*out).unionByName(rare.select(*out)).unionByName(null.select(*out))


def quantiles_of(acc: DataFrame, probs: dict[str, float], segment_by: Sequence[str], value: str = "value",
                 count: str = "c", cum: str = "cum") -> DataFrame:
    """Exact linearly interpolated quantiles, one column per entry of ``probs``, of every segment of ``acc``: one
    row per distinct ``value`` with its ``count`` and running count ``cum``. No group is held in one buffer: the
    two rows next to each position are picked by their running counts. One row per segment is broadcast, so
    there must be few segments (categories, tiers, features)."""
    keys = {c: f"__q_k{i}" for i, c in enumerate(segment_by)}
    totals = acc.groupBy(*segment_by).agg(F.max(cum).alias("__q_n")).withColumnsRenamed(keys)
    rows = acc.join(F.broadcast(totals), [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])
    picks, out = [F.max("__q_n").alias("__q_n")], []
    for i, (name, p) in enumerate(probs.items()):
        at = F.lit(float(p)) * (F.col("__q_n") - 1)
        for end, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col(cum) - F.col(count) <= place) & (place < F.col(cum))
            picks.append(F.max(F.when(here, F.col(value))).alias(f"__q_{end}{i}"))
        lo, hi = F.col(f"__q_lo{i}"), F.col(f"__q_hi{i}")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return rows.groupBy(*segment_by).agg(*picks).select(*segment_by, *out)


def quantiles(df: DataFrame, columns: dict[str, Column], probs: dict[str, float],
              segment_by: Sequence[str] = ()) -> DataFrame:
    """(metric, segment columns, one column per entry of ``probs``): exact quantiles of each of ``columns``, NULLs
    left out; a segment without values has no row. Values are counted before they are shuffled, and ranked in
    range partitions."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in columns.items()])
    counts = (df.select(*segment_by, F.inline(pairs)).where(F.col("value").isNotNull())
              .groupBy("metric", *segment_by, "value").agg(F.count(F.lit(1)).alias("c")))
    segments = ["metric", *segment_by]
    acc = running_totals(counts, [F.col("value").asc()], {"cum": F.col("c")}, segment_by=segments)
    return quantiles_of(acc, probs, segments)


def average_rank(df: DataFrame, value: str, out: str, segment_by: Sequence[str] = (),
                 descending: bool = False, count_out: str | None = None) -> DataFrame:
    """pandas ``rank(method='average')`` of ``value`` within ``segment_by``: ties share the mean of
    their positions; NULL values get a NULL rank. Optionally adds the non-null count per segment.

    Works on the distinct values (one row per value and segment), so a heavily repeated value is
    one row, then joins the ranks back on (segment, value); common values by broadcast (``join_common``).
    """
    seg = list(segment_by)
    v = F.col(value)
    distinct = df.where(v.isNotNull()).groupBy(*seg, value).agg(F.count(F.lit(1)).alias("__ar_c"))
    key = v.desc() if descending else v.asc()
    acc = running_totals(distinct, [key], {"__ar_cum": F.col("__ar_c")}, segment_by=seg)
    ranks = acc.select(*seg, value, "__ar_c", (F.col("__ar_cum") - (F.col("__ar_c") - 1) / 2.0).alias(out))
    if count_out is not None:
        totals = distinct.groupBy(*seg).agg(F.sum("__ar_c").alias(count_out))
        ranks = ranks.join(totals, seg, "inner") if seg else ranks.withColumn(
            count_out, distinct.select(F.sum("__ar_c")).scalar())
    return join_common(df, ranks, [*seg, value], "__ar_c").drop("__ar_c")
