"""Keys for the panel, the benchmark score and everything computed from the scored panel.

The SQL-checked keys use the one-column benchmark score (``prob_benchmark``); the same functions
take ``prob_rf`` / ``prob_lr`` from the ML keys.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from oraclesql.ctes import cte, with_ctes
from vendorlens import constants as K
from vendorlens.functions.scalar import risk_band
from vendorlens.plans import economics as E
from vendorlens.plans import exports as X
from vendorlens.plans import stored
from vendorlens.plans import panel as P
from vendorlens.plans import portfolio as G
from vendorlens.plans import supplier360 as B
from vendorlens.registry import register

PROB = "prob_benchmark"
CHOSEN_THRESHOLD = 0.5


def fscored(spark, sf):
    """Scored panel restricted to rows that carry a score, materialised once per query."""
    return stored.scored_panel(spark, sf).where(F.col(PROB).isNotNull())


GRID_SQL = ("(SELECT range + 1 AS b, CAST(0.02 AS DOUBLE) + range * CAST(0.02 AS DOUBLE) AS t "
            "FROM range(49)) g")

cte("m_cost", ["m_fsc"], f"""
SELECT round(g.t, 2) AS threshold,
  count_if(f.prob_benchmark >= g.t) AS flagged,
  count_if(f.prob_benchmark >= g.t AND f.target_delivery_failure_next_q = 1) AS tp,
  count_if(f.prob_benchmark >= g.t AND f.target_delivery_failure_next_q = 0) AS fp,
  count_if(NOT coalesce(f.prob_benchmark >= g.t, false) AND f.target_delivery_failure_next_q = 1) AS fn,
  count_if(NOT coalesce(f.prob_benchmark >= g.t, false) AND f.target_delivery_failure_next_q = 0) AS tn
FROM {GRID_SQL} JOIN m_fsc f ON true GROUP BY g.t""")

cte("m_cost_full", ["m_cost"], f"""
SELECT threshold, flagged, tp, fp, fn, tn, tp / greatest(tp + fp, 1) AS precision,
  tp / greatest(tp + fn, 1) AS recall, fn * {K.DEFAULT_COST_MISS!r} + (tp + fp) * {K.DEFAULT_COST_ACTION!r} AS cost
FROM m_cost""")

cte("m_opt", ["m_cost_full"], """
SELECT arg_min(threshold, struct_pack(c := cost, t := threshold)) AS opt_threshold, min(cost) AS opt_cost
FROM m_cost_full""")


@register("panel_features", with_ctes("SELECT * FROM m_panel", "m_panel"))
def panel_features(spark, sf):
    """Rolling, lag and share features with the next-quarter failure target."""
    return stored.panel(spark, sf)


@register("benchmark_score", with_ctes("SELECT * FROM m_bench", "m_bench"))
def benchmark_score(spark, sf):
    """Inverse min-max scaling of the rolling on-time rate within each quarter."""
    return P.benchmark_score(stored.panel(spark, sf))


@register("scored_panel", with_ctes("SELECT * FROM m_scored", "m_scored"))
def scored_panel(spark, sf):
    """J10/J11 with the benchmark score (scores from qi >= 6)."""
    return stored.scored_panel(spark, sf)


@register("latest_quarter_rows", with_ctes(
    "SELECT supplier_id, fiscal_quarter, qi, prob_benchmark FROM m_fsc WHERE qi = (SELECT max(qi) FROM m_fsc)",
    "m_fsc"))
def latest_quarter_rows(spark, sf):
    """P10."""
    return G.latest_quarter_rows(fscored(spark, sf), PROB).select("supplier_id", "fiscal_quarter", "qi", PROB)


@register("risk_bands", with_ctes("""
SELECT supplier_id, fiscal_quarter, prob_benchmark,
  CASE WHEN prob_benchmark >= 0.7 THEN 'Critical' WHEN prob_benchmark >= 0.45 THEN 'High'
       WHEN prob_benchmark >= 0.2 THEN 'Moderate' ELSE 'Low' END AS risk_band
FROM m_scored""", "m_scored"))
def risk_bands(spark, sf):
    """F2: bands for every panel row (NULL score → Low)."""
    s = stored.scored_panel(spark, sf)
    return s.select("supplier_id", "fiscal_quarter", PROB, risk_band(F.col(PROB)).alias("risk_band"))


@register("risk_profile", with_ctes("""
SELECT band AS risk_band, count(*) AS suppliers, sum(total_spend_inr) AS spend,
  CASE band WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Moderate' THEN 2 ELSE 3 END AS band_order
FROM (SELECT *, CASE WHEN prob_benchmark >= 0.7 THEN 'Critical' WHEN prob_benchmark >= 0.45 THEN 'High'
        WHEN prob_benchmark >= 0.2 THEN 'Moderate' ELSE 'Low' END AS band
      FROM m_fsc WHERE qi = (SELECT max(qi) FROM m_fsc)) t GROUP BY band""", "m_fsc"))
def risk_profile(spark, sf):
    """Suppliers and spend per band in the latest scored quarter, with the band order."""
    from vendorlens.functions.scalar import risk_band_order
    cur = G.latest_quarter_rows(fscored(spark, sf), PROB)
    agg = cur.groupBy(risk_band(F.col(PROB)).alias("risk_band")).agg(
        F.count(F.lit(1)).alias("suppliers"), F.sum("total_spend_inr").alias("spend"))
    return agg.withColumn("band_order", risk_band_order(F.col("risk_band")))


@register("cost_table", with_ctes("SELECT * FROM m_cost_full", "m_cost_full"))
def cost_table(spark, sf):
    """49-threshold cost table in one pass (bucket counts + reverse running sum)."""
    return E.cost_table(fscored(spark, sf), PROB)


@register("optimal_threshold", with_ctes(f"""
SELECT o.opt_threshold, o.opt_cost,
  (SELECT min(threshold) FROM m_cost_full WHERE cost <= o.opt_cost * 1.05) AS plateau_lo,
  (SELECT max(threshold) FROM m_cost_full WHERE cost <= o.opt_cost * 1.05) AS plateau_hi,
  (SELECT count(*) FROM m_cost_full WHERE cost <= o.opt_cost * 1.05) AS plateau_n,
  {CHOSEN_THRESHOLD!r} AS chosen_threshold,
  (SELECT max(cost) FROM m_cost_full WHERE abs(threshold - {CHOSEN_THRESHOLD!r}) < 1e-9) AS chosen_cost,
  (SELECT max(cost) FROM m_cost_full WHERE abs(threshold - {CHOSEN_THRESHOLD!r}) < 1e-9) - o.opt_cost AS cost_gap
FROM m_opt o""", "m_opt", "m_cost_full"))
def optimal_threshold(spark, sf):
    """First minimum, 5% plateau, and the gap of a chosen threshold."""
    return E.optimal_threshold(E.cost_table(fscored(spark, sf), PROB), chosen=CHOSEN_THRESHOLD)


@register("confusion_at_threshold", with_ctes(f"""
SELECT {CHOSEN_THRESHOLD!r} AS threshold, tp, fp, fn, tn, n, tp + fp AS flagged,
  (tp + fp) * 100.0 / nullif(n, 0) AS flagged_pct, tp / greatest(tp + fp, 1) AS precision,
  tp / greatest(tp + fn, 1) AS recall,
  fn * {K.DEFAULT_COST_MISS!r} + (tp + fp) * {K.DEFAULT_COST_ACTION!r} AS cost,
  failures * {K.DEFAULT_COST_MISS!r} AS do_nothing_cost
FROM (SELECT count_if(coalesce(prob_benchmark >= {CHOSEN_THRESHOLD!r}, false) AND target_delivery_failure_next_q = 1) AS tp,
        count_if(coalesce(prob_benchmark >= {CHOSEN_THRESHOLD!r}, false) AND target_delivery_failure_next_q = 0) AS fp,
        count_if(NOT coalesce(prob_benchmark >= {CHOSEN_THRESHOLD!r}, false) AND target_delivery_failure_next_q = 1) AS fn,
        count_if(NOT coalesce(prob_benchmark >= {CHOSEN_THRESHOLD!r}, false) AND target_delivery_failure_next_q = 0) AS tn,
        count(*) AS n, CAST(coalesce(sum(target_delivery_failure_next_q), 0) AS BIGINT) AS failures
      FROM m_fsc) t""", "m_fsc"))
def confusion_at_threshold(spark, sf):
    """E3."""
    return E.confusion_at_threshold(fscored(spark, sf), PROB, CHOSEN_THRESHOLD)


@register("capacity_triage", with_ctes(f"""
SELECT 'Single column rule' AS model, count(*) AS reviewed,
  CAST(coalesce(sum(target_delivery_failure_next_q), 0) AS BIGINT) AS caught,
  coalesce(sum(target_delivery_failure_next_q), 0) / greatest(count(*), 1) AS precision,
  coalesce(sum(target_delivery_failure_next_q), 0)
    / greatest((SELECT coalesce(sum(target_delivery_failure_next_q), 0) FROM m_fsc), 1) AS recall,
  {K.DEFAULT_CAPACITY} AS capacity
FROM (SELECT *, row_number() OVER (PARTITION BY fiscal_quarter ORDER BY prob_benchmark DESC, supplier_id) AS r
      FROM m_fsc WHERE prob_benchmark IS NOT NULL) t WHERE r <= {K.DEFAULT_CAPACITY}""", "m_fsc"))
def capacity_triage(spark, sf):
    """Per-quarter top-40 review under a capacity limit."""
    return E.capacity_triage(fscored(spark, sf), {"Single column rule": PROB})


def _reviewed(model: str, score: str) -> str:
    return f"""
SELECT '{model}' AS model, count(*) AS reviewed, CAST(coalesce(sum(y), 0) AS BIGINT) AS caught
FROM (SELECT target_delivery_failure_next_q AS y,
        row_number() OVER (PARTITION BY fiscal_quarter ORDER BY {score} DESC, supplier_id) AS r
      FROM m_fsc WHERE {score} IS NOT NULL) t WHERE r <= {K.DEFAULT_CAPACITY}"""


cte("m_two_rules", ["m_fsc"], _reviewed("Single column rule", "prob_benchmark") + " UNION ALL "
    + _reviewed("This quarter only", "(1 - on_time_rate)"))


@register("capacity_gain", with_ctes(f"""
SELECT model, reviewed, caught, caught / greatest(reviewed, 1) AS precision,
  caught / greatest((SELECT coalesce(sum(target_delivery_failure_next_q), 0) FROM m_fsc), 1) AS recall,
  {K.DEFAULT_CAPACITY} AS capacity, caught - base AS extra_caught, abs(caught - base) * {K.DEFAULT_COST_MISS!r} AS extra_worth
FROM (SELECT *, (SELECT caught FROM m_two_rules WHERE model = 'Single column rule') AS base FROM m_two_rules) t""",
                                     "m_two_rules", "m_fsc"))
def capacity_gain(spark, sf):
    """The catches of another score (this quarter's late rate) beyond the one-column rule, and their worth."""
    scored = fscored(spark, sf).withColumn("this_quarter", 1 - F.col("on_time_rate"))
    triage = E.capacity_triage(scored, {"Single column rule": PROB, "This quarter only": "this_quarter"})
    return E.capacity_gain(triage, "Single column rule")


@register("watchlist", with_ctes("""
SELECT supplier_id, supplier_name, supplier_tier, primary_category, fiscal_quarter,
  prob_benchmark AS failure_probability,
  CASE WHEN prob_benchmark >= 0.7 THEN 'Critical' WHEN prob_benchmark >= 0.45 THEN 'High'
       WHEN prob_benchmark >= 0.2 THEN 'Moderate' ELSE 'Low' END AS risk_band,
  spend_share_of_quarter_pct, is_sole_source, num_alternate_suppliers, on_time_rate * 100 AS on_time_pct,
  external_credit_score, total_spend_inr / 1e7 AS spend_cr, exposure, prob_benchmark * (1 + exposure) AS priority,
  sum(spend_share_of_quarter_pct) OVER () AS flagged_share_total
FROM (SELECT *, spend_share_of_quarter_pct * (1 + is_sole_source) / (1 + num_alternate_suppliers) AS exposure
      FROM m_fsc WHERE qi = (SELECT max(qi) FROM m_fsc)) w
WHERE prob_benchmark >= (SELECT opt_threshold FROM m_opt)""", "m_fsc", "m_opt"))
def watchlist(spark, sf):
    """E5: latest-quarter watchlist at the cost-optimal threshold."""
    sc = fscored(spark, sf)
    opt = E.optimal_threshold(E.cost_table(sc, PROB)).select("opt_threshold").scalar()
    return E.watchlist(sc, PROB, opt)


cte("m_kraljic", ["m_fsc"], """
SELECT *, quantile_cont(supply_risk, 0.7) OVER () AS risk_cutoff,
  quantile_cont(profit_impact, 0.7) OVER () AS impact_cutoff
FROM (SELECT *, prob_benchmark * 0.6 + is_sole_source * 0.20 + (1 / (1 + num_alternate_suppliers)) * 0.20 AS supply_risk,
        spend_share_of_quarter_pct * coalesce(category_criticality, 0.5) AS profit_impact
      FROM m_fsc WHERE qi = (SELECT max(qi) FROM m_fsc)) s""")

cte("m_quadrant", ["m_kraljic"], """
SELECT *, CASE WHEN supply_risk >= risk_cutoff AND profit_impact >= impact_cutoff THEN 'Strategic'
               WHEN supply_risk >= risk_cutoff AND profit_impact < impact_cutoff THEN 'Bottleneck'
               WHEN supply_risk < risk_cutoff AND profit_impact >= impact_cutoff THEN 'Leverage'
               ELSE 'Non-critical' END AS quadrant
FROM m_kraljic""")


@register("kraljic_quadrants", with_ctes("""
SELECT supplier_id, fiscal_quarter, prob_benchmark, supply_risk, profit_impact, quadrant, risk_cutoff,
  impact_cutoff FROM m_quadrant""", "m_quadrant"))
def kraljic_quadrants(spark, sf):
    """Quadrant of every supplier in the latest scored quarter."""
    q = G.kraljic_quadrants(fscored(spark, sf), PROB)
    return q.select("supplier_id", "fiscal_quarter", PROB, "supply_risk", "profit_impact", "quadrant",
                    "risk_cutoff", "impact_cutoff")


@register("kraljic_summary", with_ctes(f"""
SELECT d.quadrant, d.quadrant_order, coalesce(a.suppliers, 0) AS suppliers, coalesce(a.spend, 0.0) AS spend,
  coalesce(a.spend_share, 0.0) AS spend_share, coalesce(a.mean_risk, 0.0) AS mean_risk,
  coalesce(a.actual_failure, 0.0) AS actual_failure, d.action
FROM (VALUES {", ".join(f"('{q}', {i}, '{K.QUADRANT_ACTIONS[q]}')" for i, q in enumerate(K.QUADRANTS))})
     d(quadrant, quadrant_order, action)
LEFT JOIN (SELECT quadrant, count(*) AS suppliers, sum(total_spend_inr) AS spend,
             sum(spend_share_of_quarter_pct) AS spend_share, avg(prob_benchmark) AS mean_risk,
             avg(target_delivery_failure_next_q) AS actual_failure
           FROM m_quadrant GROUP BY quadrant) a ON d.quadrant = a.quadrant""", "m_quadrant"))
def kraljic_summary(spark, sf):
    """G2."""
    return G.kraljic_summary(G.kraljic_quadrants(fscored(spark, sf), PROB), PROB)


@register("attention_flags", with_ctes("""
SELECT supplier_id, supplier_name,
  concat_ws('; ', CASE WHEN coalesce(is_sole_source <> 0, false) THEN 'sole_sourced' END,
    CASE WHEN num_alternate_suppliers = 0 AND NOT coalesce(is_sole_source <> 0, false) THEN 'no_alternates' END,
    CASE WHEN sla_gap_pp < 0 THEN 'below_sla' END,
    CASE WHEN promoter_pledge_pct > 50 THEN 'promoter_pledge' END,
    CASE WHEN altman_z_score < 1.8 THEN 'altman_distress' END,
    CASE WHEN critical_events > 0 THEN 'high_or_critical_incidents' END) AS flags,
  CAST(coalesce(is_sole_source <> 0, false) AS INTEGER)
  + CAST(coalesce(num_alternate_suppliers = 0 AND NOT coalesce(is_sole_source <> 0, false), false) AS INTEGER)
  + CAST(coalesce(sla_gap_pp < 0, false) AS INTEGER) + CAST(coalesce(promoter_pledge_pct > 50, false) AS INTEGER)
  + CAST(coalesce(altman_z_score < 1.8, false) AS INTEGER) + CAST(coalesce(critical_events > 0, false) AS INTEGER)
  AS n_flags,
  sla_gap_pp, promoter_pledge_pct, altman_z_score, critical_events
FROM m_sup""", "m_sup"))
def attention_flags(spark, sf):
    """B1: attention flags of every supplier."""
    return B.attention_flags(stored.suppliers(spark, sf))


@register("latest_prediction", with_ctes("""
SELECT supplier_id, arg_max(prob_benchmark, qi) AS latest_prob, max(qi) AS latest_qi
FROM m_scored WHERE prob_benchmark IS NOT NULL GROUP BY supplier_id""", "m_scored"))
def latest_prediction(spark, sf):
    """W11."""
    return B.latest_prediction(stored.scored_panel(spark, sf), PROB)


@register("supplier360", with_ctes("""
SELECT s.supplier_id, s.supplier_name, s.supplier_tier, s.primary_category, s.city, s.state, s.vendor_code,
  s.onboarding_date, s.total_spend_inr, s.po_count, s.otif_rate, s.on_time_rate, s.invoice_accuracy,
  s.dispute_rate, s.external_credit_score, s.credit_rating, s.sla_gap_pp, s.sla_target_pct,
  lp.latest_prob, lp.latest_qi,
  CASE WHEN lp.latest_prob IS NULL THEN 'not scored' WHEN lp.latest_prob >= 0.7 THEN 'Critical'
       WHEN lp.latest_prob >= 0.45 THEN 'High' WHEN lp.latest_prob >= 0.2 THEN 'Moderate' ELSE 'Low' END AS risk_band
FROM m_sup s LEFT JOIN (SELECT supplier_id, arg_max(prob_benchmark, qi) AS latest_prob, max(qi) AS latest_qi
                        FROM m_scored WHERE prob_benchmark IS NOT NULL GROUP BY supplier_id) lp
  ON s.supplier_id = lp.supplier_id""", "m_sup", "m_scored"))
def supplier360(spark, sf):
    """B2: the 360 record of every supplier."""
    return B.supplier360(stored.suppliers(spark, sf), stored.scored_panel(spark, sf), PROB)


@register("quarter_detail", with_ctes("""
SELECT supplier_id, fiscal_quarter, qi, lines, po_count, spend_inr / 1e7 AS spend_cr,
  on_time_rate * 100 AS on_time_pct, in_full_rate * 100 AS in_full_pct, otif_rate * 100 AS otif_pct,
  invoice_error_rate * 100 AS invoice_error_pct, avg_delay_days, stockouts, external_credit_score,
  altman_z_score, current_ratio, debt_to_equity_ratio, gst_filing_delay_flag, litigation_case_count,
  promoter_pledge_pct, news_sentiment_score, days_sales_outstanding
FROM m_sq""", "m_sq"))
def quarter_detail(spark, sf):
    """Per-quarter detail and signals of every supplier."""
    return B.quarter_detail(stored.quarters(spark, sf))


@register("incident_log", with_ctes("""
SELECT supplier_id, event_id, event_date, fiscal_quarter, event_type, severity, reported_by, resolved_flag,
  resolution_days, row_number() OVER (PARTITION BY supplier_id ORDER BY event_date DESC, event_id DESC) AS position
FROM x_event""", "x_event"))
def incident_log(spark, sf):
    """Incidents newest first (no quarter filter, as in the 360 view)."""
    return B.incident_log(stored.inputs(spark, sf).event)


@register("severity_counts", with_ctes("""
SELECT s.supplier_id, d.severity, coalesce(c.n, 0) AS incidents
FROM m_sup s JOIN (VALUES ('Critical'), ('High'), ('Medium'), ('Low')) d(severity) ON true
LEFT JOIN (SELECT supplier_id, severity, count(*) AS n FROM x_event GROUP BY 1, 2) c
  ON s.supplier_id = c.supplier_id AND d.severity = c.severity""", "m_sup", "x_event"))
def severity_counts(spark, sf):
    """Incidents per supplier and severity, zeros included."""
    return B.severity_counts(stored.suppliers(spark, sf), stored.inputs(spark, sf).event)


@register("events_quarter_severity", with_ctes("""
SELECT supplier_id, fiscal_quarter, severity, count(*) AS n FROM x_event GROUP BY 1, 2, 3""", "x_event"))
def events_quarter_severity(spark, sf):
    """A24."""
    return B.events_quarter_severity(stored.inputs(spark, sf).event)


_PEER_UNION = " UNION ALL ".join(
    f"SELECT supplier_id, primary_category, '{k}' AS metric, '{lab}' AS metric_label, {str(h).lower()} AS higher_is_better, "
    f"CAST({k} AS DOUBLE) AS value FROM m_sup" for k, lab, h in B.PEER_METRICS)
cte("m_peer_stack", ["m_sup"], _PEER_UNION)


@register("peer_percentiles", with_ctes("""
SELECT a.supplier_id, a.primary_category, a.metric, a.metric_label, a.value, m.peer_median, m.peers,
  CASE WHEN a.value IS NULL THEN 0 ELSE
    (SELECT count(*) FROM m_peer_stack b WHERE b.primary_category = a.primary_category AND b.metric = a.metric
       AND CASE WHEN a.higher_is_better THEN b.value < a.value ELSE b.value > a.value END) END * 100.0 / m.peers
    AS percentile
FROM m_peer_stack a JOIN (SELECT primary_category, metric, count(*) AS peers, median(value) AS peer_median
                          FROM m_peer_stack GROUP BY 1, 2) m
  ON a.primary_category = m.primary_category AND a.metric = m.metric""", "m_peer_stack"))
def peer_percentiles(spark, sf):
    """Percentile against category peers, six metrics."""
    return B.peer_percentiles(stored.suppliers(spark, sf))


@register("supplier_history", with_ctes("""
SELECT supplier_id, fiscal_quarter, qi, on_time_rate * 100 AS on_time_pct, external_credit_score,
  prob_benchmark * 100 AS risk_pct FROM m_scored""", "m_scored"))
def supplier_history(spark, sf):
    """Every supplier's ordered history (order by qi when reading)."""
    s = stored.scored_panel(spark, sf)
    return s.select("supplier_id", "fiscal_quarter", "qi", (F.col("on_time_rate") * 100).alias("on_time_pct"),
                    "external_credit_score", (F.col(PROB) * 100).alias("risk_pct"))


def _shown(x: str, digits: int) -> str:
    return f"round_even(({x}) * {10 ** digits}.0::DOUBLE, 0) / {10 ** digits}.0::DOUBLE"


@register("watchlist_export", with_ctes(f"""
SELECT supplier_name, supplier_tier, primary_category, prob_benchmark AS failure_probability,
  CASE WHEN prob_benchmark >= 0.7 THEN 'Critical' WHEN prob_benchmark >= 0.45 THEN 'High'
       WHEN prob_benchmark >= 0.2 THEN 'Moderate' ELSE 'Low' END AS risk_band,
  spend_share_of_quarter_pct, is_sole_source, num_alternate_suppliers, {_shown('on_time_rate * 100', 1)} AS on_time_rate,
  external_credit_score, {_shown('CAST(total_spend_inr AS DOUBLE) / 1e7', 2)} AS total_spend_inr
FROM m_fsc WHERE qi = (SELECT max(qi) FROM m_fsc) AND prob_benchmark >= {CHOSEN_THRESHOLD!r}""", "m_fsc"))
def watchlist_export(spark, sf):
    """The watchlist at the chosen threshold as the exported CSV file holds it."""
    flagged = E.prioritised(fscored(spark, sf), PROB).where(F.col(PROB) >= CHOSEN_THRESHOLD)
    table = X.watchlist_table(flagged, PROB)
    path = stored.once_at(spark, sf, "watchlist-csv", lambda at: X.export(table, X.WATCHLIST, at))
    return X.exported(spark, path, table)


@register("segment_export", with_ctes(f"""
SELECT supplier_name, supplier_tier, primary_category, region, prob_benchmark AS failure_probability, spend_share_of_quarter_pct,
  is_sole_source, num_alternate_suppliers, {_shown('on_time_rate * 100', 1)} AS on_time_rate, external_credit_score
FROM m_quadrant WHERE quadrant = 'Leverage'""", "m_quadrant"))
def segment_export(spark, sf):
    """One quadrant's suppliers as the exported CSV file holds them."""
    table = X.segment_table(G.kraljic_quadrants(fscored(spark, sf), PROB), PROB, "Leverage")
    path = stored.once_at(spark, sf, "segment-csv", lambda at: X.export(table, X.SEGMENT, at))
    return X.exported(spark, path, table)
