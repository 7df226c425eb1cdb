"""Keys for the cross-filter and the descriptive reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from oraclesql.ctes import cte, with_ctes
from vendorlens.plans import filters as FL
from vendorlens.plans import marts as M
from vendorlens.plans import portfolio as G
from vendorlens.plans import stored
from vendorlens.plans import reports as R
from vendorlens.plans import supplier360 as B
from vendorlens.registry import register
from vendorlens.suite.risk import PROB, fscored

# Example selections exercised by the filter keys.
SEL_SUPPLIERS = FL.Filters(categories=["ECONOMY", "PROMO", "SMALL"], tiers=["Strategic", "Preferred"],
                           sourcing=FL.ALTERNATIVES_ONLY)
SEL_RANGE = FL.Filters(regions=["ASIA", "EUROPE"], quarter_range=("FY99-00-Q2", "FY97-98-Q1"))
SEL_SCORED = FL.Filters(tiers=["Strategic", "Preferred"], sourcing=FL.ALTERNATIVES_ONLY,
                        quarter_range=("FY97-98-Q1", "FY99-00-Q2"))
SEL_EARLY = FL.Filters(tiers=["Strategic", "Preferred"], quarter_range=("FY94-95-Q4", "FY95-96-Q2"))  # before the first score
SEL_EVENTS = FL.Filters(abc=["A", "B"], sizes=["Large", "Medium"])


def _wavg(rate: str) -> str:
    return f"coalesce(sum(coalesce({rate}, 0) * coalesce(lines, 0)) / nullif(sum(coalesce(lines, 0)), 0), 0)"


@register("cross_filter_suppliers", with_ctes("""
SELECT supplier_id FROM m_sup
WHERE primary_category IN ('ECONOMY', 'PROMO', 'SMALL') AND supplier_tier IN ('Strategic', 'Preferred')
  AND is_sole_source = 0""", "m_sup"))
def cross_filter_suppliers(spark, sf):
    """Supplier ids surviving category, tier and sourcing filters."""
    return FL.supplier_ids(stored.suppliers(spark, sf), SEL_SUPPLIERS)


@register("filter_quarter_range", with_ctes("""
SELECT supplier_id, fiscal_quarter, qi, on_time_rate, spend_inr FROM m_sq
WHERE supplier_id IN (SELECT supplier_id FROM m_sup WHERE region IN ('ASIA', 'EUROPE'))
  AND qi BETWEEN (SELECT qi FROM m_dq WHERE fiscal_quarter = 'FY97-98-Q1')
             AND (SELECT qi FROM m_dq WHERE fiscal_quarter = 'FY99-00-Q2')""", "m_sq", "m_sup", "m_dq"))
def filter_quarter_range(spark, sf):
    """A reversed quarter range is swapped; inclusive bounds."""
    return FL.fsq(stored.quarters(spark, sf), stored.suppliers(spark, sf), stored.axis(spark, sf), SEL_RANGE).select("supplier_id", "fiscal_quarter", "qi", "on_time_rate", "spend_inr")


cte("m_fsc_sel", ["m_fsc", "m_sup", "m_dq"], """
SELECT * FROM m_fsc
WHERE supplier_id IN (SELECT supplier_id FROM m_sup WHERE supplier_tier IN ('Strategic', 'Preferred') AND is_sole_source = 0)
  AND qi BETWEEN (SELECT qi FROM m_dq WHERE fiscal_quarter = 'FY97-98-Q1')
             AND (SELECT qi FROM m_dq WHERE fiscal_quarter = 'FY99-00-Q2')""")


def selected_scores(spark, sf):
    return FL.fscored(stored.scored_panel(spark, sf), stored.suppliers(spark, sf), stored.axis(spark, sf), SEL_SCORED, PROB)


@register("scored_filtered", with_ctes("SELECT supplier_id, fiscal_quarter, qi, prob_benchmark FROM m_fsc_sel", "m_fsc_sel"))
def scored_filtered(spark, sf):
    """Scored rows of the selected suppliers and quarters."""
    return selected_scores(spark, sf).select("supplier_id", "fiscal_quarter", "qi", PROB)


@register("latest_rows_filtered", with_ctes("""
SELECT supplier_id, fiscal_quarter, qi, prob_benchmark FROM m_fsc_sel
WHERE qi = (SELECT coalesce(max(qi) FILTER (WHERE qi = (SELECT max(qi) FROM m_fsc)), max(qi)) FROM m_fsc_sel)""",
                                            "m_fsc_sel", "m_fsc"))
def latest_rows_filtered(spark, sf):
    """P10: the selection ends before the latest scored quarter, so its own last quarter is taken."""
    return G.latest_quarter_rows(selected_scores(spark, sf), PROB).select("supplier_id", "fiscal_quarter", "qi", PROB)


@register("latest_rows_unscored", with_ctes("""
SELECT supplier_id, fiscal_quarter, qi, prob_benchmark FROM (
  SELECT *, max(qi) OVER () AS last FROM m_scored
  WHERE supplier_id IN (SELECT supplier_id FROM m_sup WHERE supplier_tier IN ('Strategic', 'Preferred'))
    AND qi BETWEEN (SELECT qi FROM m_dq WHERE fiscal_quarter = 'FY94-95-Q4')
               AND (SELECT qi FROM m_dq WHERE fiscal_quarter = 'FY95-96-Q2')) t
WHERE qi = last""", "m_scored", "m_sup", "m_dq"))
def latest_rows_unscored(spark, sf):
    """P10: a selection that ends before the first score falls back to its greatest quarter."""
    rows = FL.fscored(stored.scored_panel(spark, sf), stored.suppliers(spark, sf), stored.axis(spark, sf), SEL_EARLY, PROB,
                      only_scored_quarters=False)
    return G.latest_quarter_rows(rows, PROB, fall_back=True).select("supplier_id", "fiscal_quarter", "qi", PROB)


@register("events_filtered", with_ctes("""
SELECT e.event_id, e.supplier_id, e.fiscal_quarter, d.qi, e.severity
FROM x_event e JOIN m_dq d ON e.fiscal_quarter = d.fiscal_quarter
WHERE e.supplier_id IN (SELECT supplier_id FROM m_sup WHERE abc_class IN ('A', 'B')
                        AND business_size IN ('Large', 'Medium'))""", "x_event", "m_dq", "m_sup"))
def events_filtered(spark, sf):
    """Events of the selection; events in quarters outside the axis drop out."""
    kept = FL.fevents(stored.inputs(spark, sf).event, stored.suppliers(spark, sf), stored.axis(spark, sf), SEL_EVENTS)
    return kept.select("event_id", "supplier_id", "fiscal_quarter", "qi", "severity")


@register("overview_kpis", with_ctes(f"""
SELECT (SELECT CAST(sum(spend_inr) AS DOUBLE) FROM m_sq) AS spend, (SELECT sum(po_count) FROM m_sq) AS orders,
  (SELECT count(*) FROM m_sup) AS suppliers, (SELECT {_wavg('on_time_rate')} FROM m_sq) AS on_time,
  (SELECT {_wavg('otif_rate')} FROM m_sq) AS otif,
  (SELECT count_if(sla_gap_pp < 0) FROM m_sup) AS sla_breaches,
  (SELECT count(*) FROM m_fsc WHERE qi = (SELECT max(qi) FROM m_fsc) AND prob_benchmark >= 0.45) AS at_risk,
  (SELECT coalesce(sum(total_spend_inr), 0) FROM m_fsc
    WHERE qi = (SELECT max(qi) FROM m_fsc) AND prob_benchmark >= 0.45) AS spend_at_risk""",
                                      "m_sq", "m_sup", "m_fsc"))
def overview_kpis(spark, sf):
    """Executive KPIs (benchmark score for the at-risk figures)."""
    return R.overview_kpis(spark, stored.suppliers(spark, sf), stored.quarters(spark, sf), fscored(spark, sf), PROB)


cte("m_trend", ["m_sq"], """
SELECT fiscal_quarter, qi,
  sum(coalesce(on_time_rate, 0) * coalesce(lines, 0)) / nullif(sum(coalesce(lines, 0)), 0) * 100 AS on_time,
  coalesce(sum(lines), 0) AS lines
FROM m_sq GROUP BY fiscal_quarter, qi""")


@register("ontime_trend", with_ctes("SELECT * FROM m_trend", "m_trend"))
def ontime_trend(spark, sf):
    """Weighted on-time trend by quarter."""
    return R.ontime_trend(stored.quarters(spark, sf))


@register("festive_effect", with_ctes("""
SELECT avg(CASE WHEN fiscal_quarter LIKE '%Q3' THEN on_time END) AS q3_on_time,
  avg(CASE WHEN fiscal_quarter NOT LIKE '%Q3' THEN on_time END) AS other_on_time FROM m_trend""", "m_trend"))
def festive_effect(spark, sf):
    """Festive Q3 quarters against the rest."""
    return R.festive_effect(R.ontime_trend(stored.quarters(spark, sf)))


cte("m_catperf", ["m_sq"], """
SELECT *, median(on_time) OVER () AS median_on_time FROM (
  SELECT primary_category, CAST(sum(spend_inr) AS DOUBLE) / 1e7 AS spend,
    sum(coalesce(on_time_rate, 0) * coalesce(lines, 0)) / nullif(sum(coalesce(lines, 0)), 0) * 100 AS on_time,
    count(DISTINCT supplier_id) AS suppliers
  FROM m_sq GROUP BY primary_category) c
WHERE primary_category IS NOT NULL AND spend IS NOT NULL AND on_time IS NOT NULL""")


@register("category_performance", with_ctes("SELECT * FROM m_catperf", "m_catperf"))
def category_performance(spark, sf):
    """A12/A29."""
    return R.category_performance(stored.quarters(spark, sf))


@register("notable_categories", with_ctes("""
SELECT DISTINCT * FROM (
  (SELECT * FROM m_catperf ORDER BY on_time, primary_category LIMIT 3)
  UNION ALL (SELECT * FROM m_catperf ORDER BY spend DESC, primary_category LIMIT 2)) u""", "m_catperf"))
def notable_categories(spark, sf):
    """Union of two top-k lists, de-duplicated by key."""
    return R.notable_categories(R.category_performance(stored.quarters(spark, sf)))


@register("delivery_kpis", with_ctes(f"""
SELECT {_wavg('on_time_rate')} AS on_time, {_wavg('in_full_rate')} AS in_full,
  avg(avg_delay_days) AS avg_delay_days, coalesce(sum(stockouts), 0) AS stockouts FROM m_sq""", "m_sq"))
def delivery_kpis(spark, sf):
    """A15."""
    return R.delivery_kpis(stored.quarters(spark, sf))


# The fiscal quarters of the test tables' orders: October 1994 on, 27 in all.
AXIS = [f"FY{y % 100:02d}-{(y + 1) % 100:02d}-Q{q}" for y in range(1994, 2002) for q in range(1, 5)][3:30]
_HEAT = ", ".join(f"avg(on_time_rate) FILTER (fiscal_quarter = '{q}') * 100 AS \"{q}\"" for q in AXIS)


@register("ontime_heatmap", with_ctes(f"""
SELECT primary_category, {_HEAT} FROM m_sq GROUP BY primary_category""", "m_sq"))
def ontime_heatmap(spark, sf):
    """Pivot category × quarter (the quarters present, in axis order)."""
    return R.ontime_heatmap(stored.quarters(spark, sf), stored.axis(spark, sf))


@register("worst_performers", with_ctes("""
SELECT supplier_id, supplier_name, otif_rate * 100 AS otif_pct, avg_delay_days,
  CAST(total_spend_inr AS DOUBLE) / 1e7 AS spend_cr
FROM m_sup WHERE otif_rate IS NOT NULL ORDER BY otif_rate, spend_rank LIMIT 12""", "m_sup"))
def worst_performers(spark, sf):
    """O3: twelve lowest OTIF rates."""
    return R.worst_performers(stored.suppliers(spark, sf))


def _shown(x: str, digits: int) -> str:
    return f"round_even(({x}) * {10 ** digits}.0::DOUBLE, 0) / {10 ** digits}.0::DOUBLE"


@register("worst_performers_display", with_ctes(f"""
SELECT supplier_id, supplier_name, {_shown('otif_rate * 100', 1)} AS otif_pct, avg_delay_days,
  {_shown('CAST(total_spend_inr AS DOUBLE) / 1e7', 1)} AS spend_cr
FROM m_sup WHERE otif_rate IS NOT NULL ORDER BY otif_rate, spend_rank LIMIT 12""", "m_sup"))
def worst_performers_display(spark, sf):
    """The table of the lowest OTIF rates as it is shown, rates and crore to one decimal."""
    return R.displayed(R.worst_performers(stored.suppliers(spark, sf)), {"otif_pct": 1, "spend_cr": 1})


@register("quarter_detail_display", with_ctes(f"""
SELECT supplier_id, fiscal_quarter, qi, {_shown('on_time_rate * 100', 1)} AS on_time_pct, {_shown('in_full_rate * 100', 1)} AS in_full_pct,
  {_shown('otif_rate * 100', 1)} AS otif_pct, {_shown('invoice_error_rate * 100', 1)} AS invoice_error_pct,
  {_shown('CAST(spend_inr AS DOUBLE) / 1e7', 2)} AS spend_cr FROM m_sq""", "m_sq"))
def quarter_detail_display(spark, sf):
    """Every supplier's quarters as the page shows them, rates to one decimal, crore to two."""
    pct = ("on_time_pct", "in_full_pct", "otif_pct", "invoice_error_pct")
    rows = B.quarter_detail(stored.quarters(spark, sf).withColumn("spend_inr", F.col("spend_inr").cast("double")))
    return R.displayed(rows, dict.fromkeys(pct, 1) | {"spend_cr": 2}).select("supplier_id", "fiscal_quarter", "qi", *pct, "spend_cr")


@register("delay_quartiles_by_tier", with_ctes("""
SELECT supplier_tier, count(avg_delay_days) AS n, min(avg_delay_days) AS min,
  quantile_cont(avg_delay_days, 0.25) AS q1, quantile_cont(avg_delay_days, 0.5) AS median,
  quantile_cont(avg_delay_days, 0.75) AS q3, max(avg_delay_days) AS max
FROM m_sq WHERE supplier_tier IN ('Strategic', 'Preferred', 'Transactional') GROUP BY supplier_tier""", "m_sq"))
def delay_quartiles_by_tier(spark, sf):
    """A17."""
    return R.delay_quartiles_by_tier(stored.quarters(spark, sf))


@register("invoice_kpis", with_ctes("""
SELECT avg(invoice_accuracy) AS invoice_accuracy, avg(dispute_rate) AS dispute_rate,
  avg(avg_days_to_payment) AS days_to_payment, coalesce(sum(abs_variance_inr), 0) AS abs_variance_inr
FROM m_sup""", "m_sup"))
def invoice_kpis(spark, sf):
    """A18."""
    return R.invoice_kpis(stored.suppliers(spark, sf))


@register("invoice_error_totals", with_ctes("""
SELECT invoice_error_type, sum(size) AS size FROM (
  SELECT supplier_id, invoice_error_type, count(*) AS size FROM x_invoice
  WHERE supplier_id IS NOT NULL AND invoice_error_type IS NOT NULL GROUP BY 1, 2) e
WHERE supplier_id IN (SELECT supplier_id FROM m_sup) AND invoice_error_type <> 'None'
GROUP BY invoice_error_type""", "x_invoice", "m_sup"))
def invoice_error_totals(spark, sf):
    """A19."""
    inp, sup = stored.inputs(spark, sf), stored.suppliers(spark, sf)
    return R.invoice_error_totals(M.invoice_errors(inp), FL.supplier_ids(sup, FL.Filters()))


@register("otif_accuracy_corr", with_ctes("""
SELECT corr(otif_rate, invoice_accuracy) AS corr,
  CASE WHEN abs(corr(otif_rate, invoice_accuracy)) < 0.6 THEN 'related but distinct' ELSE 'closely linked' END
    AS reading
FROM m_sup""", "m_sup"))
def otif_accuracy_corr(spark, sf):
    """A20."""
    return R.otif_accuracy_corr(stored.suppliers(spark, sf))


@register("sla_kpis", with_ctes("""
SELECT count_if(sla_gap_pp < 0) AS breaches, count(*) AS suppliers, median(sla_gap_pp) AS median_gap,
  min(sla_gap_pp) AS worst_gap, CAST(coalesce(sum(CASE WHEN sla_gap_pp < 0 THEN total_spend_inr END), 0) AS DOUBLE)
    AS spend_in_breach
FROM m_sup""", "m_sup"))
def sla_kpis(spark, sf):
    """A21."""
    return R.sla_kpis(stored.suppliers(spark, sf))


@register("sla_status", with_ctes("""
SELECT supplier_id, supplier_name, sla_target_pct, on_time_rate * 100 AS actual_on_time_pct,
  CASE WHEN sla_gap_pp >= 0 THEN 'Meeting SLA' ELSE 'In breach' END AS status,
  least(min(sla_target_pct) OVER (), min(on_time_rate * 100) OVER ()) - 3 AS axis_lo,
  greatest(max(sla_target_pct) OVER (), max(on_time_rate * 100) OVER ()) + 3 AS axis_hi
FROM m_sup WHERE sla_target_pct IS NOT NULL""", "m_sup"))
def sla_status(spark, sf):
    """A22."""
    return R.sla_status(stored.suppliers(spark, sf))


@register("top20_share", with_ctes("""
SELECT (SELECT sum(CAST(total_spend_inr AS DOUBLE)) FROM
          (SELECT total_spend_inr FROM m_sup ORDER BY total_spend_inr DESC, supplier_id LIMIT 20) t)
       / (SELECT CAST(sum(total_spend_inr) AS DOUBLE) FROM m_sup) * 100 AS top_share_pct,
  20 AS k, (SELECT count_if(abc_class = 'A') FROM m_sup) AS class_a""", "m_sup"))
def top20_share(spark, sf):
    """Top-20 spend share of the selection."""
    return R.top20_share(stored.suppliers(spark, sf))


@register("format_inr", with_ctes("""
SELECT supplier_id, CAST(total_spend_inr AS DOUBLE) AS total_spend_inr,
  CASE WHEN CAST(total_spend_inr AS DOUBLE) >= 1e7 THEN 'cr' WHEN CAST(total_spend_inr AS DOUBLE) >= 1e5 THEN 'L'
       WHEN CAST(total_spend_inr AS DOUBLE) >= 1e3 THEN 'k' ELSE '' END AS unit
FROM m_sup""", "m_sup"))
def format_inr(spark, sf):
    """the unit of the Indian money convention per value (``format_inr_text`` gives the text)."""
    sup = stored.suppliers(spark, sf)
    a = F.abs(F.col("total_spend_inr").cast("double"))
    unit = F.when(a >= 1e7, "cr").when(a >= 1e5, "L").when(a >= 1e3, "k").otherwise("")
    return sup.select("supplier_id", F.col("total_spend_inr").cast("double").alias("total_spend_inr"), unit.alias("unit"))


@register("format_inr_text", with_ctes("""
SELECT supplier_id, CASE WHEN v < 0 THEN '-' ELSE '' END || CASE
    WHEN abs(v) >= 1e7 THEN format('₹{:,.1f} cr', abs(v) / 1e7) WHEN abs(v) >= 1e5 THEN format('₹{:,.1f} L', abs(v) / 1e5)
    WHEN abs(v) >= 1e3 THEN format('₹{:,.0f}k', abs(v) / 1e3) ELSE format('₹{:,.0f}', abs(v)) END AS inr
FROM (SELECT supplier_id, CAST(total_spend_inr AS DOUBLE) AS v FROM m_sup) t""", "m_sup"))
def inr_text(spark, sf):
    """the formatted money text of every supplier's spend."""
    from vendorlens.functions.scalar import inr
    return stored.suppliers(spark, sf).select("supplier_id", inr(F.col("total_spend_inr")).alias("inr"))
