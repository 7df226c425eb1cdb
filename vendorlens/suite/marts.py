"""Keys for the batch data layer: inputs, supplier and quarterly marts."""
from __future__ import annotations

from pyspark.sql import functions as F

from oraclesql.ctes import with_ctes
from vendorlens.plans import exports as X
from vendorlens.plans import marts as M
from vendorlens.plans import stored
from vendorlens.registry import register
from vendorlens.sources import io
from vendorlens.sources.adapter import file_inputs


@register("dim_quarter", with_ctes("SELECT * FROM m_dq", "m_dq"))
def dim_quarter(spark, sf):
    """ordered fiscal-quarter axis of the orders."""
    return stored.axis(spark, sf)


@register("quarter_list", with_ctes("SELECT * FROM m_dq", "m_dq"))
def quarter_list(spark, sf):
    """S3: the quarter axis from the quarter list that was written as JSON."""
    path = stored.once_at(spark, sf, "quarters-json", lambda at: X.write_quarters(stored.axis(spark, sf), at))
    return X.read_quarters(spark, path)


@register("supplier_summary_from_files", with_ctes("SELECT * FROM m_sup", "m_sup"))
def supplier_summary_from_files(spark, sf):
    """The supplier mart from the eight CSV input files, which the test tables are written to first."""
    folder = stored.once_at(spark, sf, "inputs-csv", lambda at: io.write_inputs(
        file_inputs(spark, sf, stored.lines(spark, sf)), at, "csv"))
    return M.supplier_summary(io.read_inputs(spark, folder, "csv"))


@register("receipt_enriched", with_ctes("SELECT * FROM m_rec", "m_rec"))
def receipt_enriched(spark, sf):
    """Receipts with their orders and the OTIF flag."""
    return M.receipt_enriched(stored.inputs(spark, sf))


@register("delivery_by_supplier", with_ctes("SELECT * FROM m_deliv", "m_deliv"))
def delivery_by_supplier(spark, sf):
    """A1."""
    return M.delivery_by_supplier(M.receipt_enriched(stored.inputs(spark, sf)))


@register("invoice_by_supplier", with_ctes("SELECT * FROM m_inv", "m_inv"))
def invoice_by_supplier(spark, sf):
    """A2."""
    return M.invoice_by_supplier(stored.inputs(spark, sf).invoice)


@register("spend_by_supplier", with_ctes("SELECT * FROM m_spend", "m_spend"))
def spend_by_supplier(spark, sf):
    """A3."""
    return M.spend_by_supplier(stored.inputs(spark, sf).po)


@register("sla_by_supplier", with_ctes("SELECT * FROM m_sla", "m_sla"))
def sla_by_supplier(spark, sf):
    """A4."""
    return M.sla_by_supplier(stored.inputs(spark, sf).contract)


@register("latest_risk", with_ctes("SELECT * FROM m_latest_risk", "m_latest_risk"))
def latest_risk(spark, sf):
    """W1."""
    inp = stored.inputs(spark, sf)
    return M.latest_risk(inp.risk, M.quarter_axis(inp))


@register("incidents_by_supplier", with_ctes("SELECT * FROM m_ev", "m_ev"))
def incidents_by_supplier(spark, sf):
    """A5."""
    return M.incidents_by_supplier(stored.inputs(spark, sf).event)


@register("category_criticality", with_ctes("SELECT * FROM m_cat_crit", "m_cat_crit"))
def category_criticality(spark, sf):
    """A6."""
    return M.category_criticality(stored.inputs(spark, sf).item)


@register("supplier_summary", with_ctes("SELECT * FROM m_sup", "m_sup"))
def supplier_summary(spark, sf):
    """The supplier mart."""
    return stored.suppliers(spark, sf)


@register("spend_concentration", with_ctes(
    "SELECT supplier_id, supplier_name, total_spend_inr, spend_rank, spend_share_pct, cum_spend_pct FROM m_sup",
    "m_sup"))
def spend_concentration(spark, sf):
    """Rank and cumulative share by spend (ROWS frame, ties broken by id)."""
    s = stored.suppliers(spark, sf)
    return s.select("supplier_id", "supplier_name", "total_spend_inr", "spend_rank", "spend_share_pct",
                    "cum_spend_pct")


@register("abc_classes", with_ctes(
    "SELECT abc_class, count(*) AS suppliers, CAST(sum(total_spend_inr) AS DECIMAL(28,2)) AS spend_inr,"
    " min(spend_rank) AS first_rank, max(spend_rank) AS last_rank FROM m_sup GROUP BY abc_class", "m_sup"))
def abc_classes(spark, sf):
    """ABC class sizes, spend and rank span."""
    s = stored.suppliers(spark, sf)
    return s.groupBy("abc_class").agg(
        F.count(F.lit(1)).alias("suppliers"), F.sum("total_spend_inr").cast("decimal(28,2)").alias("spend_inr"),
        F.min("spend_rank").alias("first_rank"), F.max("spend_rank").alias("last_rank"))


@register("invoice_quality_by_order_quarter", with_ctes("SELECT * FROM m_qi", "m_qi"))
def invoice_quality_by_order_quarter(spark, sf):
    """Invoices re-attributed to the order's quarter."""
    return M.invoice_by_order_quarter(stored.inputs(spark, sf))


@register("supplier_quarter", with_ctes("SELECT * FROM m_sq", "m_sq"))
def supplier_quarter(spark, sf):
    """The supplier × quarter mart."""
    return stored.quarters(spark, sf).drop(*M.ROLLUP_COLS)


@register("category_quarter", with_ctes("""
SELECT a.*, b.on_time_rate, b.otif_rate, b.stockouts FROM
 (SELECT s.primary_category, p.fiscal_quarter, CAST(coalesce(sum(p.po_value_inr), 0) AS DECIMAL(28,2)) AS spend_inr,
    count(p.purchase_order_id) AS po_count
  FROM x_po p JOIN x_supplier s USING (supplier_id)
  WHERE s.primary_category IS NOT NULL AND p.fiscal_quarter IS NOT NULL GROUP BY 1, 2) a
LEFT JOIN
 (SELECT s.primary_category, r.fiscal_quarter, avg(r.on_time_flag) AS on_time_rate, avg(r.otif) AS otif_rate,
    CAST(coalesce(sum(r.stockout_triggered_flag), 0) AS BIGINT) AS stockouts
  FROM m_rec r JOIN x_supplier s USING (supplier_id)
  WHERE s.primary_category IS NOT NULL AND r.fiscal_quarter IS NOT NULL GROUP BY 1, 2) b
USING (primary_category, fiscal_quarter)""", "x_po", "x_supplier", "m_rec"))
def category_quarter(spark, sf):
    """J8/A8."""
    return M.category_quarter(stored.quarters(spark, sf))


@register("events_enriched", with_ctes("""
SELECT e.*, s.supplier_name, s.supplier_tier, s.primary_category, s.region
FROM x_event e JOIN x_supplier s USING (supplier_id)""", "x_event", "x_supplier"))
def events_enriched(spark, sf):
    """J9."""
    return M.events_enriched(stored.inputs(spark, sf))


@register("invoice_errors", with_ctes("""
SELECT supplier_id, invoice_error_type, count(*) AS size FROM x_invoice
WHERE supplier_id IS NOT NULL AND invoice_error_type IS NOT NULL GROUP BY 1, 2""", "x_invoice"))
def invoice_errors(spark, sf):
    """A9."""
    return M.invoice_errors(stored.inputs(spark, sf))
