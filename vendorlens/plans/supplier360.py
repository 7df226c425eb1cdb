"""Supplier 360, in batch over every supplier at once."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlens import constants as K
from vendorlens.functions.scalar import risk_band
from vendorlens.operators.ordered import join_common, quantiles_of, running_totals

# FIXED VALUES — the peer metrics and whether higher is better.
PEER_METRICS = [("otif_rate", "OTIF rate", True), ("on_time_rate", "On-time rate", True),
                ("invoice_accuracy", "Invoice accuracy", True), ("external_credit_score", "Credit score", True),
                ("avg_delay_days", "Average delay", False), ("reject_rate_pct", "Rejection rate", False)]
FLAG_CODES = ["sole_sourced", "no_alternates", "below_sla", "promoter_pledge", "altman_distress",
              "high_or_critical_incidents"]


def attention_flags(sup: DataFrame) -> DataFrame:
    """B1: the attention flags of every supplier, as '; '-joined codes and a count."""
    sole = F.coalesce(F.col("is_sole_source") != 0, F.lit(False))
    conds = [
        sole,
        (F.col("num_alternate_suppliers") == 0) & ~sole,
        F.col("sla_gap_pp") < 0,
        F.col("promoter_pledge_pct") > K.PLEDGE_LIMIT,
        F.col("altman_z_score") < K.ALTMAN_DISTRESS,
        F.col("critical_events") > 0,
    ]
    flags = [F.when(c, F.lit(code)) for c, code in zip(conds, FLAG_CODES)]
    n = sum(F.coalesce(c, F.lit(False)).cast("int") for c in conds)
    return sup.select("supplier_id", "supplier_name", F.concat_ws("; ", *flags).alias("flags"),
                      n.alias("n_flags"), "sla_gap_pp", "promoter_pledge_pct", "altman_z_score", "critical_events")


def latest_prediction(scored: DataFrame, prob: str) -> DataFrame:
    """Each supplier's latest non-NULL score (``max_by`` — a partial aggregate)."""
    return (scored.where(F.col(prob).isNotNull()).groupBy("supplier_id")
            .agg(F.max_by(F.col(prob), F.col("qi")).alias("latest_prob"), F.max("qi").alias("latest_qi")))


def supplier360(sup: DataFrame, scored: DataFrame, prob: str) -> DataFrame:
    """B2: summary record + latest prediction + its band ('not scored' without one)."""
    lp = latest_prediction(scored, prob)
    out = sup.join(lp, "supplier_id", "left")
    band = F.when(F.col("latest_prob").isNull(), F.lit("not scored")).otherwise(risk_band(F.col("latest_prob")))
    return out.select("supplier_id", "supplier_name", "supplier_tier", "primary_category", "city", "state",
                      "vendor_code", "onboarding_date", "total_spend_inr", "po_count", "otif_rate", "on_time_rate",
                      "invoice_accuracy", "dispute_rate", "external_credit_score", "credit_rating",
                      "sla_gap_pp", "sla_target_pct", "latest_prob", "latest_qi", band.alias("risk_band"))


def quarter_detail(sq: DataFrame) -> DataFrame:
    """Per supplier and quarter, rates in percent, spend in crore, plus the signals."""
    return sq.select(
        "supplier_id", "fiscal_quarter", "qi", "lines", "po_count", (F.col("spend_inr") / 1e7).alias("spend_cr"),
        *[(F.col(c) * 100).alias(c.replace("_rate", "_pct"))
          for c in ["on_time_rate", "in_full_rate", "otif_rate", "invoice_error_rate"]],
        "avg_delay_days", "stockouts", "external_credit_score", "altman_z_score", "current_ratio",
        "debt_to_equity_ratio", "gst_filing_delay_flag", "litigation_case_count", "promoter_pledge_pct",
        "news_sentiment_score", "days_sales_outstanding")


def incident_log(events: DataFrame) -> DataFrame:
    """Every supplier's incidents with their position newest-first (ties by event id). Rows are range
    partitioned on (supplier, date, id), so one supplier's incidents may fill many tasks."""
    log = events.select("supplier_id", "event_id", "event_date", "fiscal_quarter", "event_type", "severity",
                        "reported_by", "resolved_flag", "resolution_days")
    return running_totals(log, [F.col("event_date").desc(), F.col("event_id").desc()], row_number="position",
                          segment_by=["supplier_id"])


def severity_counts(sup: DataFrame, events: DataFrame) -> DataFrame:
    """Incidents per supplier re-indexed to the four severities, missing ones as 0.
    The domain is generated per supplier with ``explode`` (four rows each), not a cross join."""
    dom = sup.select("supplier_id", F.explode(F.array(*[F.lit(s) for s in K.SEVERITIES])).alias("severity"))
    cnt = events.groupBy("supplier_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    return dom.join(cnt, ["supplier_id", "severity"], "left").select(
        "supplier_id", "severity", F.coalesce("n", F.lit(0)).alias("incidents"))


def events_quarter_severity(events: DataFrame) -> DataFrame:
    """A24."""
    return events.groupBy("supplier_id", "fiscal_quarter", "severity").agg(F.count(F.lit(1)).alias("n"))


def peer_percentiles(sup: DataFrame) -> DataFrame:
    """For each supplier and metric, the share of category peers strictly worse (×100; every
    peer, NULLs included, in the denominator; 0 when the supplier's own value is NULL) and the peer
    median. "Strictly worse" counts come from running totals over the distinct values of each
    (category, metric) — a range-partitioned scan, so a large category is split across tasks; those of common
    values return by broadcast."""
    metrics = F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(label).alias("metric_label"), F.lit(hib).alias("higher_is_better"),
                                 F.col(k).cast("double").alias("value")) for k, label, hib in PEER_METRICS])
    stacked = sup.select("supplier_id", "primary_category", F.inline(metrics))
    seg = ["primary_category", "metric"]
    vals = stacked.where(F.col("value").isNotNull()).groupBy(*seg, "value").agg(F.count(F.lit(1)).alias("c"))
    acc = running_totals(vals, [F.col("value").asc()], {"cum": F.col("c")}, segment_by=seg)
    peers = stacked.groupBy(*seg).agg(F.count(F.lit(1)).alias("peers"), F.count("value").alias("non_null"))
    peers = peers.join(F.broadcast(quantiles_of(acc, {"peer_median": 0.5}, seg)), seg, "left")
    j = join_common(stacked, acc, [*seg, "value"], "c").join(F.broadcast(peers), seg, "inner")  # one row per category and metric
    below = F.col("cum") - F.col("c")
    above = F.col("non_null") - F.col("cum")
    worse = F.when(F.col("value").isNull(), F.lit(0)).when(F.col("higher_is_better"), below).otherwise(above)
    return j.select("supplier_id", "primary_category", "metric", "metric_label", "value", "peer_median",
                    "peers", (worse * 100.0 / F.col("peers")).alias("percentile"))
