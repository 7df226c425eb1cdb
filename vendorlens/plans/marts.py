"""Derived tables: supplier, supplier×quarter and category×quarter marts.

Design for scale: every fact is aggregated on its own key first (partial aggregation on the map
side absorbs a hot supplier or category), and only the aggregates are joined. Aggregates keyed on
the same columns share one hash partitioning, so the chained joins add no further exchanges.
Only the quarter axis is broadcast explicitly (its size is bounded by the calendar).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlens import constants as K
from vendorlens.functions import calendar as cal
from vendorlens.functions.scalar import abc_class, safe_div
from vendorlens.operators.ordered import running_totals
from vendorlens.sources.adapter import Inputs

#: Sums and counts of the flags, which the quarter mart keeps for coarser rollups.
ROLLUP = {"on_time_flag": ("on_time_sum", "on_time_n"), "otif": ("otif_sum", "otif_n")}
ROLLUP_COLS = [c for names in ROLLUP.values() for c in names]
SUPPLIER_ATTRS = ["supplier_id", "supplier_name", "supplier_tier", "business_size",
                  "primary_category", "region", "state"]
RISK_LATEST_COLS = ["external_credit_score", "credit_rating", "altman_z_score", "days_sales_outstanding",
                    "debt_to_equity_ratio", "current_ratio", "promoter_pledge_pct", "news_sentiment_score",
                    "litigation_case_count"]


def quarter_axis(inp: Inputs) -> DataFrame:
    """``dim_quarter(fiscal_quarter, qi)`` of the orders (tens of rows)."""
    po = inp.po
    if "fiscal_year" not in po.columns:
        # Label-only inputs: two-digit years from 69 on belong to the last century.
        year = F.substring("fiscal_quarter", 3, 2).try_cast("int")
        po = po.select("fiscal_quarter", (year + F.when(year >= 69, 1900).otherwise(2000)).alias("fiscal_year"),
                       F.substring("fiscal_quarter", -1, 1).try_cast("int").alias("fiscal_qtr"))
    return cal.dim_quarter(po)


def _keyed(df: DataFrame, *keys: str) -> DataFrame:
    # Grouping drops NULL keys (pandas groupby semantics).
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond)


def _spread(inp: Inputs, fact: DataFrame) -> DataFrame:
    """A fact dealt by order over as many tasks as its size needs, where that is more than the session's number."""
    if (inp.tasks or 0) <= int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return fact
    return fact.repartition(inp.tasks, "purchase_order_id")


# ---------------------------------------------------------------- supplier grain
def receipt_enriched(inp: Inputs) -> DataFrame:
    """Receipt lines with their order's quarter, value and priority; OTIF flag. Facts that were dealt together
    need no join."""
    rec = inp.order_receipt
    if rec is None:
        po = inp.po.select("purchase_order_id", "fiscal_quarter", "po_value_inr", "order_priority")
        rec = _spread(inp, inp.receipt).join(_spread(inp, po), "purchase_order_id", "inner")
    return rec.withColumn("otif", F.col("on_time_flag") * F.col("in_full_flag"))


def delivery_by_supplier(rec: DataFrame) -> DataFrame:
    """A1. p90 is the exact linear-interpolated percentile. Receipts are first summed and counted per supplier and
    delay, which Spark does row by row in one hash table; the percentile then sees each delay once, with its count."""
    rates = {"on_time_flag": "on_time_rate", "in_full_flag": "in_full_rate", "otif": "otif_rate", "delay_days": "avg_delay_days"}
    per_delay = _keyed(rec, "supplier_id").groupBy("supplier_id", F.col("delay_days").alias("delay")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("goods_receipt_id").alias("lines"),
        *[x for c in rates for x in (F.sum(c).alias("s_" + c), F.count(c).alias("n_" + c))],
        *[F.sum(c).alias("s_" + c) for c in ("stockout_triggered_flag", "rejected_quantity", "received_quantity")])
    return per_delay.groupBy("supplier_id").agg(
        F.sum("lines").alias("lines"),
        *[safe_div(F.sum("s_" + c).cast("double"), F.sum("n_" + c).cast("double")).alias(name) for c, name in rates.items()],
        F.percentile("delay", 0.9, F.col("rows")).alias("p90_delay_days"),
        F.max("delay").alias("max_delay_days"),
        F.coalesce(F.sum("s_stockout_triggered_flag"), F.lit(0)).cast("long").alias("stockouts"),
        (safe_div(F.coalesce(F.sum("s_rejected_quantity"), F.lit(0.0)),
                  F.coalesce(F.sum("s_received_quantity"), F.lit(0.0))) * 100).alias("reject_rate_pct"))


def invoice_by_supplier(invoice: DataFrame) -> DataFrame:
    """A2."""
    return _keyed(invoice, "supplier_id").groupBy("supplier_id").agg(
        F.count("invoice_id").alias("invoices"),
        (1 - F.avg("invoice_error_flag")).alias("invoice_accuracy"),
        F.avg("dispute_raised_flag").alias("dispute_rate"),
        F.avg("days_to_payment").alias("avg_days_to_payment"),
        F.coalesce(F.sum(F.abs("invoice_variance_inr")), F.lit(0.0)).alias("abs_variance_inr"))


def spend_by_supplier(po: DataFrame) -> DataFrame:
    """A3: exact DECIMAL spend, order count, emergency orders."""
    return _keyed(po, "supplier_id").groupBy("supplier_id").agg(
        F.coalesce(F.sum("po_value_inr"), F.lit(0).cast("decimal(18,2)")).alias("total_spend_inr"),
        F.count("purchase_order_id").alias("po_count"),
        F.count_if(F.col("order_priority") == K.EMERGENCY).alias("emergency_pos"))


def sla_by_supplier(contract: DataFrame) -> DataFrame:
    """A4: several contracts per supplier are averaged / summed."""
    return _keyed(contract, "supplier_id").groupBy("supplier_id").agg(
        F.avg("sla_on_time_delivery_pct").alias("sla_target_pct"),
        F.coalesce(F.sum("committed_annual_value_inr"), F.lit(0.0)).alias("committed_value_inr"),
        F.avg("penalty_clause_pct").alias("penalty_pct"))


def latest_risk(risk: DataFrame, dq: DataFrame) -> DataFrame:
    """The latest quarterly risk row per supplier. A row whose quarter is not on the axis has
    no index and counts as the latest (it sorts after every known quarter). Implemented as a
    ``max`` of a struct — a partial aggregate, so a supplier with many rows is no hot task."""
    r = _keyed(risk, "supplier_id").join(F.broadcast(dq), "fiscal_quarter", "left")
    key = F.struct(F.col("qi").isNull().alias("k0"), F.col("qi").alias("k1"),
                   F.col("fiscal_quarter").alias("k2"),
                   *[F.col(c) for c in RISK_LATEST_COLS])
    best = r.groupBy("supplier_id").agg(F.max(key).alias("m"))
    return best.select("supplier_id", F.col("m.k2").alias("risk_as_of"),
                       *[F.col("m." + c).alias(c) for c in RISK_LATEST_COLS])


def incidents_by_supplier(event: DataFrame) -> DataFrame:
    """A5."""
    return _keyed(event, "supplier_id").groupBy("supplier_id").agg(
        F.count("event_id").alias("events"),
        F.count_if(F.col("severity").isin(K.HIGH_SEVERITIES)).alias("critical_events"))


def category_criticality(item: DataFrame) -> DataFrame:
    """Mean criticality per item category (one row per category)."""
    return (_keyed(item, "item_category").groupBy("item_category")
            .agg(F.avg("criticality_score").alias("category_criticality"))
            .withColumnRenamed("item_category", "primary_category"))


def supplier_summary(inp: Inputs, dq: DataFrame | None = None) -> DataFrame:
    """One row per supplier with orders, receipts and invoices.

    Spend rank and cumulative share come from :func:`running_totals` (range partition, no
    single-partition window); the share denominators are scalar subqueries."""
    dq = dq if dq is not None else quarter_axis(inp)
    rec = receipt_enriched(inp)
    sup = (inp.supplier
           .join(spend_by_supplier(inp.po), "supplier_id")
           .join(delivery_by_supplier(rec), "supplier_id")
           .join(invoice_by_supplier(inp.invoice), "supplier_id")
           .join(sla_by_supplier(inp.contract), "supplier_id", "left")
           .join(latest_risk(inp.risk, dq), "supplier_id", "left")
           .join(incidents_by_supplier(inp.event), "supplier_id", "left")
           .join(F.broadcast(category_criticality(inp.item)), "primary_category", "left")  # one row per category
           .fillna(0, subset=["events", "critical_events"]))
    ranked = running_totals(sup, [F.col("total_spend_inr").desc(), F.col("supplier_id").asc()],
                            {"cum_spend_inr": F.col("total_spend_inr")}, row_number="spend_rank")
    grand = ranked.select(F.sum("total_spend_inr").cast("double")).scalar()
    cols = [c for c in sup.columns if c != "primary_category"]
    cols.insert(cols.index("region"), "primary_category")
    return ranked.select(
        *cols,
        (F.col("total_spend_inr").cast("double") / grand * 100).alias("spend_share_pct"),
        (F.col("on_time_rate") * 100 - F.col("sla_target_pct")).alias("sla_gap_pp"),
        F.col("spend_rank").cast("long").alias("spend_rank"),
        (F.col("cum_spend_inr").cast("double") / grand * 100).alias("cum_spend_pct"),
    ).withColumn("abc_class", abc_class(F.col("cum_spend_pct")))


# ---------------------------------------------------------------- supplier × quarter grain
def delivery_by_supplier_quarter(rec: DataFrame) -> DataFrame:
    return _keyed(rec, "supplier_id", "fiscal_quarter").groupBy("supplier_id", "fiscal_quarter").agg(
        F.count("goods_receipt_id").alias("lines"),
        F.avg("on_time_flag").alias("on_time_rate"),
        F.avg("in_full_flag").alias("in_full_rate"),
        F.avg("otif").alias("otif_rate"),
        F.avg("delay_days").alias("avg_delay_days"),
        F.coalesce(F.sum("stockout_triggered_flag"), F.lit(0)).cast("long").alias("stockouts"),
        (safe_div(F.coalesce(F.sum("rejected_quantity"), F.lit(0.0)),
                  F.coalesce(F.sum("received_quantity"), F.lit(0.0))) * 100).alias("reject_rate_pct"),
        *[f(c).cast("long").alias(n) for c, names in ROLLUP.items() for f, n in zip((F.sum, F.count), names)])


def invoice_by_order_quarter(inp: Inputs) -> DataFrame:
    """An invoice is booked to the quarter of the order it bills, not its own date."""
    inv = inp.order_invoice
    if inv is None:
        po = inp.po.select("purchase_order_id", "fiscal_quarter")
        inv = _spread(inp, inp.invoice.drop("fiscal_quarter")).join(_spread(inp, po), "purchase_order_id", "inner")
    return _keyed(inv, "supplier_id", "fiscal_quarter").groupBy("supplier_id", "fiscal_quarter").agg(
        F.avg("invoice_error_flag").alias("invoice_error_rate"),
        F.avg("dispute_raised_flag").alias("dispute_rate"))


def spend_by_supplier_quarter(po: DataFrame) -> DataFrame:
    return _keyed(po, "supplier_id", "fiscal_quarter").groupBy("supplier_id", "fiscal_quarter").agg(
        F.coalesce(F.sum("po_value_inr"), F.lit(0).cast("decimal(18,2)")).alias("spend_inr"),
        F.count("purchase_order_id").alias("po_count"))


def supplier_quarter(inp: Inputs, dq: DataFrame | None = None) -> DataFrame:
    """Full outer union of delivery, invoice and spend rollups on (supplier, quarter), the
    quarter's risk row, known quarters only with their index, supplier attributes."""
    dq = dq if dq is not None else quarter_axis(inp)
    keys = ["supplier_id", "fiscal_quarter"]
    rec = receipt_enriched(inp)
    sq = (delivery_by_supplier_quarter(rec)
          .join(invoice_by_order_quarter(inp), keys, "full")
          .join(spend_by_supplier_quarter(inp.po), keys, "full")
          .join(inp.risk, keys, "left")
          .join(F.broadcast(dq), "fiscal_quarter", "inner"))
    attrs = inp.supplier.select(*SUPPLIER_ATTRS)
    out = sq.join(attrs, "supplier_id", "inner")
    risk_cols = [c for c in inp.risk.columns if c not in keys]
    return out.select("supplier_id", "fiscal_quarter", "lines", "on_time_rate", "in_full_rate", "otif_rate",
                      "avg_delay_days", "stockouts", "reject_rate_pct", "invoice_error_rate", "dispute_rate", "spend_inr",
                      "po_count", *risk_cols, "qi", *SUPPLIER_ATTRS[1:], *ROLLUP_COLS)


def category_quarter(sq: DataFrame) -> DataFrame:
    """Category × quarter spend and delivery rollups of the quarter mart; no fact is read again. Rates are
    of all lines (sums and counts), not means of rates."""
    keys = ["primary_category", "fiscal_quarter"]
    rates = [safe_div(F.sum(total).cast("double"), F.sum(n).cast("double")).alias(out)
             for (total, n), out in zip(ROLLUP.values(), ("on_time_rate", "otif_rate"))]
    cq = _keyed(sq, *keys).groupBy(*keys).agg(
        F.count("po_count").alias("__ordered"),
        F.coalesce(F.sum("spend_inr"), F.lit(0)).cast("decimal(28,2)").alias("spend_inr"), F.sum("po_count").alias("po_count"),
        *rates, F.sum("stockouts").cast("long").alias("stockouts"))
    return cq.where("__ordered > 0").drop("__ordered")


def events_enriched(inp: Inputs) -> DataFrame:
    """Incidents with supplier attributes."""
    attrs = inp.supplier.select("supplier_id", "supplier_name", "supplier_tier", "primary_category", "region")
    return inp.event.join(attrs, "supplier_id", "inner")


def invoice_errors(inp: Inputs) -> DataFrame:
    """Invoices per (supplier, error type), in a column named ``size``."""
    return (_keyed(inp.invoice, "supplier_id", "invoice_error_type")
            .groupBy("supplier_id", "invoice_error_type").agg(F.count(F.lit(1)).alias("size")))
