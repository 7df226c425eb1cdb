"""Supplier × quarter modelling panel, the one-column benchmark score and the scored panel.

Windows here are partitioned by supplier and ordered by quarter: a partition holds at most one row
per calendar quarter, so no task grows with the data. Per-quarter totals (spend share, min/max of
the benchmark) are aggregated to one row per quarter and joined back by broadcast — their size is
bounded by the calendar, never by the number of suppliers.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendorlens import constants as K
from vendorlens.functions.scalar import safe_div
from vendorlens.plans import marts as M
from vendorlens.session import materialize
from vendorlens.sources.adapter import Inputs

PANEL_FAILURE_CUTOFF = 0.6  # next quarter's on-time rate below this is a delivery failure (ours)


def _events_by_supplier_quarter(event: DataFrame) -> DataFrame:
    keys = ["supplier_id", "fiscal_quarter"]
    return (event.where(F.col("supplier_id").isNotNull() & F.col("fiscal_quarter").isNotNull())
            .groupBy(*keys).agg(F.count("event_id").alias("event_count"),
                                F.count_if(F.col("severity").isin(K.HIGH_SEVERITIES)).alias("critical_event_count")))


def build_panel(inp: Inputs, dq: DataFrame | None = None, sq: DataFrame | None = None) -> DataFrame:
    """Lagged / rolling features and the next-quarter delivery-failure target. ``sq`` is the stored
    quarter mart, if there is one.

    Lags look at quarter numbers, not rows: after a gap there is no previous quarter, and the value is NULL.
    Rows without a next quarter (or without its on-time rate) carry no target and are dropped."""
    dq = dq if dq is not None else M.quarter_axis(inp)
    keys = ["supplier_id", "fiscal_quarter"]
    sq = sq if sq is not None else M.supplier_quarter(inp, dq)
    sole = inp.supplier.select("supplier_id", "is_sole_source", "num_alternate_suppliers")
    qtot = (sq.groupBy("fiscal_quarter").agg(F.sum("spend_inr").alias("q_spend")))
    base = (sq.join(_events_by_supplier_quarter(inp.event), keys, "left")
            .join(sole, "supplier_id", "left")
            .join(F.broadcast(qtot), "fiscal_quarter", "left"))
    w = Window.partitionBy("supplier_id").orderBy("qi")
    prev2 = w.rangeBetween(-1, Window.currentRow)
    spend = F.col("spend_inr").cast("double")
    lag_po = F.first("po_count").over(w.rangeBetween(-1, -1))
    lag_credit = F.first("external_credit_score").over(w.rangeBetween(-1, -1))
    lag_spend4 = F.first(spend).over(w.rangeBetween(-4, -4))
    nxt_on_time = F.lead("on_time_rate").over(w)
    nxt_qi = F.lead("qi").over(w)
    panel = base.select(
        "supplier_id", "fiscal_quarter", "qi",
        "supplier_tier", "business_size", "primary_category", "region", "credit_rating",
        "lines", "po_count", "on_time_rate", "in_full_rate", "otif_rate", "avg_delay_days", "stockouts",
        "reject_rate_pct", "invoice_error_rate", "dispute_rate",
        spend.alias("total_spend_inr"),
        (safe_div(spend, F.col("q_spend").cast("double")) * 100).alias("spend_share_of_quarter_pct"),
        "external_credit_score", "altman_z_score", "days_sales_outstanding", "debt_to_equity_ratio",
        "current_ratio", "promoter_pledge_pct", "news_sentiment_score", "gst_filing_delay_flag",
        "litigation_case_count", "is_sole_source", "num_alternate_suppliers",
        F.coalesce("event_count", F.lit(0)).alias("event_count"),
        F.coalesce("critical_event_count", F.lit(0)).alias("critical_event_count"),
        F.avg("on_time_rate").over(prev2).alias("rolling_2q_on_time_rate"),
        (safe_div(F.col("po_count") - lag_po, lag_po.cast("double")) * 100).alias("po_count_qoq_growth_pct"),
        (F.col("external_credit_score") - lag_credit).alias("credit_score_change"),
        (safe_div(spend - lag_spend4, lag_spend4) * 100).alias("yoy_revenue_growth_pct"),
        F.when(nxt_qi == F.col("qi") + 1, (nxt_on_time < PANEL_FAILURE_CUTOFF).cast("int"))
         .alias(K.TARGET))
    return panel.where(F.col(K.TARGET).isNotNull())


def benchmark_score(panel: DataFrame) -> DataFrame:
    """The two-quarter rolling on-time rate, inverted and min-max scaled within its quarter:
    (max − x)/(max − min); a constant or all-NULL quarter scores 0.5 for every row."""
    x = "rolling_2q_on_time_rate"
    mm = panel.groupBy("fiscal_quarter").agg(F.max(x).alias("__mx"), F.min(x).alias("__mn"))
    j = panel.select("supplier_id", "fiscal_quarter", x).join(F.broadcast(mm), "fiscal_quarter", "left")
    scaled = F.when(F.col("__mx") > F.col("__mn"),
                    (F.col("__mx") - F.col(x)) / (F.col("__mx") - F.col("__mn"))).otherwise(F.lit(0.5))
    return j.select("supplier_id", "fiscal_quarter", scaled.alias("prob_benchmark"))


SUPPLIER_EXTRAS = ["supplier_name", "city", "state", "msme_registered", "iso_certified", "onboarding_date"]


def scored_panel(inp: Inputs, model_scores: DataFrame | None = None, dq: DataFrame | None = None,
                 first_scored_qi: int = K.FIRST_SCORED_QI, panel: DataFrame | None = None) -> DataFrame:
    """Panel ⟕ out-of-sample scores ⟕ supplier extras ⟕ category criticality.

    Scores exist for quarters ``qi >= first_scored_qi``. ``model_scores`` (optional) holds
    ``prob_rf``/``prob_lr`` per (supplier, quarter); without it only the benchmark is present."""
    dq = dq if dq is not None else M.quarter_axis(inp)
    # The panel feeds both the benchmark and the output: without a stored one it is checkpointed
    # instead of evaluating its window and join chain twice.
    panel = panel if panel is not None else materialize(build_panel(inp, dq))
    keys = ["supplier_id", "fiscal_quarter"]
    bench = benchmark_score(panel).join(
        F.broadcast(dq.where(F.col("qi") >= first_scored_qi).select("fiscal_quarter")), "fiscal_quarter", "left_semi")
    out = panel.join(bench, keys, "left")
    if model_scores is not None:
        out = out.join(model_scores.select(*keys, "prob_rf", "prob_lr"), keys, "left")
    extras = inp.supplier.select("supplier_id", *[c for c in SUPPLIER_EXTRAS if c not in panel.columns])
    return (out.join(extras, "supplier_id", "left")
            .join(F.broadcast(M.category_criticality(inp.item)), "primary_category", "left"))  # one row per category
