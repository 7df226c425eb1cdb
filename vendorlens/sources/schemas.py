"""Declared schemas of the nine procurement inputs (no schema inference at scale)."""
from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, DT = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.DateType()
MONEY = T.DecimalType(18, 2)


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


DIM_SUPPLIER = _schema(
    ("supplier_id", L), ("supplier_name", S), ("vendor_code", S), ("supplier_tier", S),
    ("business_size", S), ("primary_category", S), ("region", S), ("state", S), ("city", S),
    ("onboarding_date", DT), ("is_sole_source", I), ("num_alternate_suppliers", I),
    ("msme_registered", I), ("iso_certified", I))

DIM_ITEM = _schema(("item_id", L), ("item_category", S), ("criticality_score", D))

DIM_CONTRACT = _schema(
    ("contract_id", L), ("supplier_id", L), ("sla_on_time_delivery_pct", D),
    ("committed_annual_value_inr", D), ("penalty_clause_pct", D))

FACT_PURCHASE_ORDER = _schema(
    ("purchase_order_id", L), ("supplier_id", L), ("fiscal_quarter", S), ("po_value_inr", MONEY),
    ("order_priority", S))

FACT_GOODS_RECEIPT = _schema(
    ("goods_receipt_id", L), ("purchase_order_id", L), ("supplier_id", L), ("on_time_flag", I),
    ("in_full_flag", I), ("stockout_triggered_flag", I), ("delay_days", D),
    ("rejected_quantity", D), ("received_quantity", D))

FACT_INVOICE = _schema(
    ("invoice_id", L), ("supplier_id", L), ("purchase_order_id", L), ("fiscal_quarter", S),
    ("invoice_error_flag", I), ("dispute_raised_flag", I), ("invoice_error_type", S),
    ("days_to_payment", D), ("invoice_variance_inr", D))

DIM_SUPPLIER_QUARTERLY_RISK = _schema(
    ("supplier_id", L), ("fiscal_quarter", S), ("external_credit_score", D), ("credit_rating", S),
    ("altman_z_score", D), ("days_sales_outstanding", D), ("debt_to_equity_ratio", D),
    ("current_ratio", D), ("promoter_pledge_pct", D), ("news_sentiment_score", D),
    ("litigation_case_count", I), ("gst_filing_delay_flag", I))

FACT_SUPPLIER_EVENT = _schema(
    ("event_id", L), ("supplier_id", L), ("event_date", DT), ("fiscal_quarter", S), ("event_type", S),
    ("severity", S), ("reported_by", S), ("resolved_flag", I), ("resolution_days", D))

ML_SUPPLIER_QUARTER_PANEL = _schema(
    ("supplier_id", L), ("fiscal_quarter", S), ("qi", I),
    *[(c, S) for c in ("supplier_tier", "business_size", "primary_category", "region", "credit_rating")],
    ("lines", L), ("po_count", L),
    *[(c, D) for c in ("on_time_rate", "in_full_rate", "otif_rate", "avg_delay_days")], ("stockouts", L),
    *[(c, D) for c in ("reject_rate_pct", "invoice_error_rate", "dispute_rate", "total_spend_inr",
                       "spend_share_of_quarter_pct", "external_credit_score", "altman_z_score",
                       "days_sales_outstanding", "debt_to_equity_ratio", "current_ratio", "promoter_pledge_pct",
                       "news_sentiment_score")],
    *[(c, I) for c in ("gst_filing_delay_flag", "litigation_case_count", "is_sole_source", "num_alternate_suppliers")],
    ("event_count", L), ("critical_event_count", L),
    *[(c, D) for c in ("rolling_2q_on_time_rate", "po_count_qoq_growth_pct", "credit_score_change",
                       "yoy_revenue_growth_pct")],
    ("target_delivery_failure_next_q", I))

INPUTS = {
    "dim_supplier": DIM_SUPPLIER,
    "dim_item": DIM_ITEM,
    "dim_contract": DIM_CONTRACT,
    "fact_purchase_order": FACT_PURCHASE_ORDER,
    "fact_goods_receipt": FACT_GOODS_RECEIPT,
    "fact_invoice": FACT_INVOICE,
    "dim_supplier_quarterly_risk": DIM_SUPPLIER_QUARTERLY_RISK,
    "fact_supplier_event": FACT_SUPPLIER_EVENT,
}
