"""The shared cross-filter: attribute filters → a supplier-id set applied by semi-join, and a
quarter range applied as a semi-join with the axis rows it covers (P2–P8)."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL_SUPPLIERS = "All suppliers"
SOLE_ONLY = "Sole-sourced only"
ALTERNATIVES_ONLY = "Has alternatives only"


@dataclass
class Filters:
    """Empty lists mean "no filter"; the quarter range is a pair of labels (any order)."""
    categories: list[str] = field(default_factory=list)
    tiers: list[str] = field(default_factory=list)
    regions: list[str] = field(default_factory=list)
    sizes: list[str] = field(default_factory=list)
    abc: list[str] = field(default_factory=list)
    sourcing: str = ALL_SUPPLIERS
    quarter_range: tuple | list | None = None


def supplier_predicate(f: Filters):
    """AND of the non-empty ``IN`` lists and the sourcing choice (a NULL flag fails both choices)."""
    conds = []
    for col, vals in (("primary_category", f.categories), ("supplier_tier", f.tiers), ("region", f.regions),
                      ("business_size", f.sizes), ("abc_class", f.abc)):
        if vals:
            conds.append(F.col(col).isin(list(vals)))
    if f.sourcing == SOLE_ONLY:
        conds.append(F.col("is_sole_source") == 1)
    elif f.sourcing == ALTERNATIVES_ONLY:
        conds.append(F.col("is_sole_source") == 0)
    pred = F.lit(True)
    for c in conds:
        pred = pred & F.coalesce(c, F.lit(False))
    return pred


def supplier_ids(sup: DataFrame, f: Filters) -> DataFrame:
    """The surviving supplier ids (a DataFrame, never collected)."""
    return sup.where(supplier_predicate(f)).select("supplier_id")


def quarter_range(dq: DataFrame, f: Filters) -> DataFrame:
    """The axis rows of the selected range; swapped when reversed; the whole axis when the range is absent,
    malformed or names an unknown label. The bounds are scalar subqueries, so nothing runs on the driver."""
    v = f.quarter_range
    if not isinstance(v, (tuple, list)) or len(v) != 2:
        return dq
    named = dq.where(F.col("fiscal_quarter").isin(list(v)))
    known = named.select(F.count_distinct("fiscal_quarter") == len(set(v))).scalar()
    lo, hi = named.select(F.min("qi")).scalar(), named.select(F.max("qi")).scalar()
    return dq.where((F.col("qi") >= F.when(known, lo).otherwise(F.lit(-1))) & (~known | (F.col("qi") <= hi)))


def in_range(rows: DataFrame, dq: DataFrame, f: Filters) -> DataFrame:
    """The rows whose quarter index lies in the selected range. The range (at most the axis, tens of rows) is
    broadcast; where the rows are files partitioned by ``qi``, it prunes them before they are read."""
    return rows.join(F.broadcast(quarter_range(dq, f).select("qi")), "qi", "left_semi")


def fs(sup: DataFrame, f: Filters) -> DataFrame:
    """P5: filtered supplier summary (attributes only, not time)."""
    return sup.join(supplier_ids(sup, f), "supplier_id", "left_semi")


def fsq(sq: DataFrame, sup: DataFrame, dq: DataFrame, f: Filters) -> DataFrame:
    """Filtered supplier-quarter rows (attributes and time)."""
    return in_range(sq, dq, f).join(supplier_ids(sup, f), "supplier_id", "left_semi")


def fscored(scored: DataFrame, sup: DataFrame, dq: DataFrame, f: Filters, prob: str,
            only_scored_quarters: bool = True) -> DataFrame:
    """P7."""
    d = in_range(scored, dq, f).join(supplier_ids(sup, f), "supplier_id", "left_semi")
    return d.where(F.col(prob).isNotNull()) if only_scored_quarters else d


def fevents(events: DataFrame, sup: DataFrame, dq: DataFrame, f: Filters) -> DataFrame:
    """Events of the selected suppliers and quarters; an unknown quarter has no index and drops."""
    e = events.join(F.broadcast(quarter_range(dq, f)), "fiscal_quarter")
    return e.join(supplier_ids(sup, f), "supplier_id", "left_semi")
