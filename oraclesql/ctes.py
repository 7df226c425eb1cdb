"""DuckDB CTEs over the driver's raw views: the test-table mapping and the derived marts.

Each entry is (dependencies, SELECT text). ``with_ctes`` emits the needed ones in dependency order.
Names start with ``x_``/``m_`` so they never clash with the driver's own views.
"""
from __future__ import annotations

ORIGIN = 7980


def fy(ts: str) -> str:
    return f"year(CAST({ts} AS DATE) - INTERVAL 3 MONTH)"


def fq(ts: str) -> str:
    return f"quarter(CAST({ts} AS DATE) - INTERVAL 3 MONTH)"


def label(y: str, q: str) -> str:
    return f"printf('FY%02d-%02d-Q%d', ({y}) % 100, (({y}) + 1) % 100, {q})"


def label_ts(ts: str) -> str:
    return label(fy(ts), fq(ts))


def label_n(n: str) -> str:
    a = f"(({n}) + {ORIGIN})"
    y = f"(({a} - 1) // 4)"
    return label(y, f"({a} - {y} * 4)")


CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], sql: str) -> None:
    CTES[name] = (deps, sql)


# ---------------------------------------------------------------- test-table mapping
cte("x_supplier", [], """
SELECT s.s_suppkey AS supplier_id, s.s_name AS supplier_name,
  'V' || CAST(s.s_suppkey AS VARCHAR) AS vendor_code,
  CASE s.s_suppkey % 5 WHEN 0 THEN 'Strategic' WHEN 1 THEN 'Preferred' WHEN 2 THEN 'Preferred'
       ELSE 'Transactional' END AS supplier_tier,
  CASE s.s_suppkey % 3 WHEN 0 THEN 'Large' WHEN 1 THEN 'Medium' ELSE 'Micro/Small' END AS business_size,
  CASE s.s_suppkey % 6 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'LARGE' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'PROMO'
       WHEN 4 THEN 'SMALL' ELSE 'STANDARD' END AS primary_category,
  r.r_name AS region, n.n_name AS state, n.n_name AS city,
  CAST(DATE '2010-01-01' + CAST((s.s_suppkey * 53) % 4000 AS INTEGER) AS DATE) AS onboarding_date,
  CAST(s.s_suppkey % 7 = 0 AS INTEGER) AS is_sole_source,
  CAST(CASE WHEN s.s_suppkey % 7 = 0 THEN 0 ELSE s.s_suppkey % 4 END AS INTEGER) AS num_alternate_suppliers,
  CAST(s.s_suppkey % 4 = 1 AS INTEGER) AS msme_registered,
  CAST(s.s_suppkey % 3 <> 2 AS INTEGER) AS iso_certified
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")

cte("x_item", [], """
SELECT p_partkey AS item_id, p_type AS item_category, p_size / 50.0 AS criticality_score FROM part""")

cte("x_contract", [], """
SELECT s_suppkey * 10 + 1 AS contract_id, s_suppkey AS supplier_id,
  CAST(70 + 5 * (s_suppkey % 4) AS DOUBLE) AS sla_on_time_delivery_pct,
  s_acctbal * 12 AS committed_annual_value_inr, CAST(0.5 + 0.5 * (s_suppkey % 3) AS DOUBLE) AS penalty_clause_pct
FROM supplier WHERE s_suppkey % 10 <> 9
UNION ALL
SELECT s_suppkey * 10 + 2, s_suppkey, CAST(70 + 5 * (s_suppkey % 4) AS DOUBLE) + 2.0, s_acctbal * 12,
  CAST(0.5 + 0.5 * (s_suppkey % 3) AS DOUBLE)
FROM supplier WHERE s_suppkey % 10 <> 9 AND s_suppkey % 2 = 0""")

cte("x_po", [], f"""
SELECT l.l_orderkey || '-' || l.l_suppkey AS purchase_order_id, l.l_suppkey AS supplier_id,
  {label_ts('o.o_orderdate')} AS fiscal_quarter, l.po_value_inr,
  CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'Emergency' ELSE 'Routine' END AS order_priority,
  {fy('o.o_orderdate')} AS fiscal_year, {fq('o.o_orderdate')} AS fiscal_qtr
FROM (SELECT l_orderkey, l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS po_value_inr
      FROM lineitem GROUP BY l_orderkey, l_suppkey) l
JOIN orders o ON l.l_orderkey = o.o_orderkey""")

cte("x_lines", [], """
SELECT l.*, o.o_orderdate, l.l_orderkey || '-' || l.l_suppkey AS purchase_order_id,
  abs(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE))) AS dd,
  greatest(0, abs(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE))) % 12 - 6
              - l.l_suppkey % 5) AS delay
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")

cte("x_receipt", ["x_lines"], """
SELECT l_orderkey || '-' || l_linenumber AS goods_receipt_id, purchase_order_id, l_suppkey AS supplier_id,
  CAST(delay = 0 AS INTEGER) AS on_time_flag,
  CAST(l_returnflag <> 'R' OR l_linestatus = 'F' AS INTEGER) AS in_full_flag,
  CAST(delay >= 4 AS INTEGER) AS stockout_triggered_flag, CAST(delay AS DOUBLE) AS delay_days,
  CAST(CASE WHEN l_returnflag = 'R' THEN floor(l_quantity / 10) ELSE 0 END AS DOUBLE) AS rejected_quantity,
  CAST(l_quantity AS DOUBLE) AS received_quantity
FROM x_lines""")

cte("x_invoice", ["x_lines"], f"""
SELECT l_orderkey || '-' || l_linenumber AS invoice_id, l_suppkey AS supplier_id, purchase_order_id,
  {label_ts('l_shipdate')} AS fiscal_quarter,
  CAST(l_discount >= 0.09 AS INTEGER) AS invoice_error_flag,
  CAST(l_discount >= 0.09 AND l_tax >= 0.04 AS INTEGER) AS dispute_raised_flag,
  CASE WHEN NOT (l_discount >= 0.09) THEN 'None'
       ELSE CASE l_returnflag WHEN 'A' THEN 'Price mismatch' WHEN 'N' THEN 'Quantity mismatch'
                              WHEN 'R' THEN 'Tax error' ELSE 'None' END END AS invoice_error_type,
  CAST(30 + dd % 31 AS DOUBLE) AS days_to_payment,
  l_extendedprice * (l_tax - l_discount) AS invoice_variance_inr
FROM x_lines""")

cte("x_risk", ["x_po"], f"""
SELECT supplier_id, fiscal_quarter, credit AS external_credit_score,
  CASE WHEN credit >= 75 THEN 'A' WHEN credit >= 50 THEN 'B' ELSE 'C' END AS credit_rating,
  credit / 20 - 1 AS altman_z_score, 120 - credit AS days_sales_outstanding,
  2 - credit / 100 AS debt_to_equity_ratio, 0.8 + credit / 100 AS current_ratio,
  CAST((13 * supplier_id + n) % 80 AS DOUBLE) AS promoter_pledge_pct,
  CAST(((supplier_id + n) % 21 - 10) / 10 AS DOUBLE) AS news_sentiment_score,
  CAST((supplier_id + n) % 4 AS INTEGER) AS litigation_case_count,
  CAST((supplier_id + n) % 9 = 0 AS INTEGER) AS gst_filing_delay_flag
FROM (SELECT p.supplier_id, p.n, p.fiscal_quarter,
        greatest(1.0, least(100.0, 50 + s.s_acctbal / 250 + (7 * p.supplier_id + 3 * p.n) % 11 - 5)) AS credit
      FROM (SELECT DISTINCT supplier_id, fiscal_year * 4 + fiscal_qtr - {ORIGIN} AS n, fiscal_quarter FROM x_po) p
      JOIN supplier s ON p.supplier_id = s.s_suppkey
      WHERE (p.supplier_id + p.n) % 17 <> 0) t""")

cte("x_event", [], f"""
SELECT e.event_id, e.user_id AS supplier_id, CAST(e.ts AS DATE) AS event_date,
  {label_n('e.event_id % 30')} AS fiscal_quarter, e.event_type,
  CASE WHEN e.value >= 110 THEN 'Critical' WHEN e.value >= 70 THEN 'High' WHEN e.value >= 35 THEN 'Medium'
       ELSE 'Low' END AS severity,
  e.event_type AS reported_by, CAST(e.event_id % 3 <> 0 AS INTEGER) AS resolved_flag,
  CASE WHEN e.event_id % 3 <> 0 THEN CAST(e.event_id % 20 AS DOUBLE) END AS resolution_days
FROM events e""")

# ---------------------------------------------------------------- marts
cte("m_dq", ["x_po"], """
SELECT fiscal_quarter,
  CAST(row_number() OVER (ORDER BY min(fiscal_year), min(fiscal_qtr), fiscal_quarter) - 1 AS INTEGER) AS qi
FROM x_po WHERE fiscal_quarter IS NOT NULL GROUP BY fiscal_quarter""")

cte("m_rec", ["x_receipt", "x_po"], """
SELECT r.*, p.fiscal_quarter, p.po_value_inr, p.order_priority, r.on_time_flag * r.in_full_flag AS otif
FROM x_receipt r JOIN x_po p USING (purchase_order_id)""")

cte("m_deliv", ["m_rec"], """
SELECT supplier_id, count(*) AS lines, avg(on_time_flag) AS on_time_rate, avg(in_full_flag) AS in_full_rate,
  avg(otif) AS otif_rate, avg(delay_days) AS avg_delay_days,
  quantile_cont(delay_days, 0.9) AS p90_delay_days, max(delay_days) AS max_delay_days,
  CAST(coalesce(sum(stockout_triggered_flag), 0) AS BIGINT) AS stockouts,
  coalesce(sum(rejected_quantity), 0) / nullif(coalesce(sum(received_quantity), 0), 0) * 100 AS reject_rate_pct
FROM m_rec WHERE supplier_id IS NOT NULL GROUP BY supplier_id""")

cte("m_inv", ["x_invoice"], """
SELECT supplier_id, count(*) AS invoices, 1 - avg(invoice_error_flag) AS invoice_accuracy,
  avg(dispute_raised_flag) AS dispute_rate, avg(days_to_payment) AS avg_days_to_payment,
  coalesce(sum(abs(invoice_variance_inr)), 0) AS abs_variance_inr
FROM x_invoice WHERE supplier_id IS NOT NULL GROUP BY supplier_id""")

cte("m_spend", ["x_po"], """
SELECT supplier_id, CAST(coalesce(sum(po_value_inr), 0) AS DECIMAL(28,2)) AS total_spend_inr,
  count(purchase_order_id) AS po_count, CAST(count_if(order_priority = 'Emergency') AS BIGINT) AS emergency_pos
FROM x_po WHERE supplier_id IS NOT NULL GROUP BY supplier_id""")

cte("m_sla", ["x_contract"], """
SELECT supplier_id, avg(sla_on_time_delivery_pct) AS sla_target_pct,
  coalesce(sum(committed_annual_value_inr), 0) AS committed_value_inr, avg(penalty_clause_pct) AS penalty_pct
FROM x_contract WHERE supplier_id IS NOT NULL GROUP BY supplier_id""")

cte("m_latest_risk", ["x_risk", "m_dq"], """
SELECT supplier_id, fiscal_quarter AS risk_as_of, external_credit_score, credit_rating, altman_z_score,
  days_sales_outstanding, debt_to_equity_ratio, current_ratio, promoter_pledge_pct, news_sentiment_score,
  litigation_case_count
FROM (SELECT r.*, row_number() OVER (PARTITION BY r.supplier_id
        ORDER BY d.qi IS NULL DESC, d.qi DESC, r.fiscal_quarter DESC) AS rn
      FROM x_risk r LEFT JOIN m_dq d USING (fiscal_quarter) WHERE r.supplier_id IS NOT NULL) t
WHERE rn = 1""")

cte("m_ev", ["x_event"], """
SELECT supplier_id, count(event_id) AS events,
  CAST(count_if(severity IN ('High', 'Critical')) AS BIGINT) AS critical_events
FROM x_event WHERE supplier_id IS NOT NULL GROUP BY supplier_id""")

cte("m_cat_crit", ["x_item"], """
SELECT item_category AS primary_category, avg(criticality_score) AS category_criticality
FROM x_item WHERE item_category IS NOT NULL GROUP BY item_category""")

cte("m_sup_joined", ["x_supplier", "m_spend", "m_deliv", "m_inv", "m_sla", "m_latest_risk", "m_ev",
                     "m_cat_crit"], """
SELECT s.*, sp.total_spend_inr, sp.po_count, sp.emergency_pos,
  d.lines, d.on_time_rate, d.in_full_rate, d.otif_rate, d.avg_delay_days, d.p90_delay_days, d.max_delay_days,
  d.stockouts, d.reject_rate_pct,
  i.invoices, i.invoice_accuracy, i.dispute_rate, i.avg_days_to_payment, i.abs_variance_inr,
  c.sla_target_pct, c.committed_value_inr, c.penalty_pct,
  lr.risk_as_of, lr.external_credit_score, lr.credit_rating, lr.altman_z_score, lr.days_sales_outstanding,
  lr.debt_to_equity_ratio, lr.current_ratio, lr.promoter_pledge_pct, lr.news_sentiment_score,
  lr.litigation_case_count,
  coalesce(e.events, 0) AS events, coalesce(e.critical_events, 0) AS critical_events,
  cc.category_criticality
FROM x_supplier s
JOIN m_spend sp USING (supplier_id) JOIN m_deliv d USING (supplier_id) JOIN m_inv i USING (supplier_id)
LEFT JOIN m_sla c USING (supplier_id) LEFT JOIN m_latest_risk lr USING (supplier_id)
LEFT JOIN m_ev e USING (supplier_id) LEFT JOIN m_cat_crit cc ON s.primary_category = cc.primary_category""")

cte("m_sup", ["m_sup_joined"], """
SELECT *, CASE WHEN cum_spend_pct <= 70 THEN 'A' WHEN cum_spend_pct <= 90 THEN 'B' ELSE 'C' END AS abc_class
FROM (SELECT j.*,
        CAST(total_spend_inr AS DOUBLE) / CAST(sum(total_spend_inr) OVER () AS DOUBLE) * 100 AS spend_share_pct,
        on_time_rate * 100 - sla_target_pct AS sla_gap_pp,
        row_number() OVER (ORDER BY total_spend_inr DESC, supplier_id) AS spend_rank,
        CAST(sum(total_spend_inr) OVER (ORDER BY total_spend_inr DESC, supplier_id
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
          / CAST(sum(total_spend_inr) OVER () AS DOUBLE) * 100 AS cum_spend_pct
      FROM m_sup_joined j) t""")

cte("m_qs", ["m_rec"], """
SELECT supplier_id, fiscal_quarter, count(*) AS lines, avg(on_time_flag) AS on_time_rate,
  avg(in_full_flag) AS in_full_rate, avg(otif) AS otif_rate, avg(delay_days) AS avg_delay_days,
  CAST(coalesce(sum(stockout_triggered_flag), 0) AS BIGINT) AS stockouts,
  coalesce(sum(rejected_quantity), 0) / nullif(coalesce(sum(received_quantity), 0), 0) * 100 AS reject_rate_pct
FROM m_rec WHERE supplier_id IS NOT NULL AND fiscal_quarter IS NOT NULL GROUP BY supplier_id, fiscal_quarter""")

cte("m_qi", ["x_invoice", "x_po"], """
SELECT i.supplier_id, p.fiscal_quarter, avg(i.invoice_error_flag) AS invoice_error_rate,
  avg(i.dispute_raised_flag) AS dispute_rate
FROM x_invoice i JOIN x_po p ON i.purchase_order_id = p.purchase_order_id
WHERE i.supplier_id IS NOT NULL AND p.fiscal_quarter IS NOT NULL GROUP BY i.supplier_id, p.fiscal_quarter""")

cte("m_qp", ["x_po"], """
SELECT supplier_id, fiscal_quarter, CAST(coalesce(sum(po_value_inr), 0) AS DECIMAL(28,2)) AS spend_inr,
  count(purchase_order_id) AS po_count
FROM x_po WHERE supplier_id IS NOT NULL AND fiscal_quarter IS NOT NULL GROUP BY supplier_id, fiscal_quarter""")

cte("m_sq", ["m_qs", "m_qi", "m_qp", "x_risk", "m_dq", "x_supplier"], """
SELECT k.supplier_id, k.fiscal_quarter, k.lines, k.on_time_rate, k.in_full_rate, k.otif_rate, k.avg_delay_days,
  k.stockouts, k.reject_rate_pct, k.invoice_error_rate, k.dispute_rate, k.spend_inr, k.po_count,
  r.external_credit_score, r.credit_rating, r.altman_z_score, r.days_sales_outstanding, r.debt_to_equity_ratio,
  r.current_ratio, r.promoter_pledge_pct, r.news_sentiment_score, r.litigation_case_count,
  r.gst_filing_delay_flag, d.qi, s.supplier_name, s.supplier_tier, s.business_size, s.primary_category,
  s.region, s.state
FROM (SELECT * FROM m_qs FULL OUTER JOIN m_qi USING (supplier_id, fiscal_quarter)
      FULL OUTER JOIN m_qp USING (supplier_id, fiscal_quarter)) k
LEFT JOIN x_risk r ON k.supplier_id = r.supplier_id AND k.fiscal_quarter = r.fiscal_quarter
JOIN m_dq d ON k.fiscal_quarter = d.fiscal_quarter
JOIN x_supplier s ON k.supplier_id = s.supplier_id""")


cte("m_panel", ["m_sq", "x_event", "x_supplier"], """
SELECT * FROM (
SELECT sq.supplier_id, sq.fiscal_quarter, sq.qi, sq.supplier_tier, sq.business_size, sq.primary_category,
  sq.region, sq.credit_rating, sq.lines, sq.po_count, sq.on_time_rate, sq.in_full_rate, sq.otif_rate,
  sq.avg_delay_days, sq.stockouts, sq.reject_rate_pct, sq.invoice_error_rate, sq.dispute_rate,
  CAST(sq.spend_inr AS DOUBLE) AS total_spend_inr,
  CAST(sq.spend_inr AS DOUBLE) / nullif(CAST(qt.q_spend AS DOUBLE), 0) * 100 AS spend_share_of_quarter_pct,
  sq.external_credit_score, sq.altman_z_score, sq.days_sales_outstanding, sq.debt_to_equity_ratio,
  sq.current_ratio, sq.promoter_pledge_pct, sq.news_sentiment_score, sq.gst_filing_delay_flag,
  sq.litigation_case_count, s.is_sole_source, s.num_alternate_suppliers,
  coalesce(ev.event_count, 0) AS event_count, coalesce(ev.critical_event_count, 0) AS critical_event_count,
  avg(sq.on_time_rate) OVER (PARTITION BY sq.supplier_id ORDER BY sq.qi
                             RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS rolling_2q_on_time_rate,
  (sq.po_count - first_value(sq.po_count) OVER p1) / nullif(CAST(first_value(sq.po_count) OVER p1 AS DOUBLE), 0) * 100
    AS po_count_qoq_growth_pct,
  sq.external_credit_score - first_value(sq.external_credit_score) OVER p1 AS credit_score_change,
  (CAST(sq.spend_inr AS DOUBLE) - first_value(CAST(sq.spend_inr AS DOUBLE)) OVER p4)
    / nullif(first_value(CAST(sq.spend_inr AS DOUBLE)) OVER p4, 0) * 100 AS yoy_revenue_growth_pct,
  CASE WHEN lead(sq.qi) OVER w = sq.qi + 1 THEN CAST(lead(sq.on_time_rate) OVER w < 0.6 AS INTEGER) END
    AS target_delivery_failure_next_q
FROM m_sq sq
LEFT JOIN (SELECT supplier_id, fiscal_quarter, count(event_id) AS event_count,
             CAST(count_if(severity IN ('High', 'Critical')) AS BIGINT) AS critical_event_count
           FROM x_event WHERE supplier_id IS NOT NULL AND fiscal_quarter IS NOT NULL GROUP BY 1, 2) ev
  ON sq.supplier_id = ev.supplier_id AND sq.fiscal_quarter = ev.fiscal_quarter
LEFT JOIN x_supplier s ON sq.supplier_id = s.supplier_id
LEFT JOIN (SELECT fiscal_quarter, sum(spend_inr) AS q_spend FROM m_sq GROUP BY 1) qt
  ON sq.fiscal_quarter = qt.fiscal_quarter
WINDOW w AS (PARTITION BY sq.supplier_id ORDER BY sq.qi),
  p1 AS (PARTITION BY sq.supplier_id ORDER BY sq.qi RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING),
  p4 AS (PARTITION BY sq.supplier_id ORDER BY sq.qi RANGE BETWEEN 4 PRECEDING AND 4 PRECEDING)) t
WHERE target_delivery_failure_next_q IS NOT NULL""")

cte("m_bench", ["m_panel"], """
SELECT p.supplier_id, p.fiscal_quarter,
  CASE WHEN mm.mx > mm.mn THEN (mm.mx - p.rolling_2q_on_time_rate) / (mm.mx - mm.mn) ELSE 0.5 END AS prob_benchmark
FROM m_panel p LEFT JOIN (SELECT fiscal_quarter, max(rolling_2q_on_time_rate) AS mx,
                                 min(rolling_2q_on_time_rate) AS mn FROM m_panel GROUP BY 1) mm
  ON p.fiscal_quarter = mm.fiscal_quarter""")

cte("m_scored", ["m_panel", "m_bench", "m_dq", "x_supplier", "m_cat_crit"], """
SELECT p.*, b.prob_benchmark, s.supplier_name, s.city, s.state, s.msme_registered, s.iso_certified,
  s.onboarding_date, cc.category_criticality
FROM m_panel p
LEFT JOIN (SELECT b.* FROM m_bench b JOIN m_dq d ON b.fiscal_quarter = d.fiscal_quarter WHERE d.qi >= 6) b
  ON p.supplier_id = b.supplier_id AND p.fiscal_quarter = b.fiscal_quarter
LEFT JOIN x_supplier s ON p.supplier_id = s.supplier_id
LEFT JOIN m_cat_crit cc ON p.primary_category = cc.primary_category""")

cte("m_fsc", ["m_scored"], """
SELECT * FROM m_scored WHERE prob_benchmark IS NOT NULL""")


def with_ctes(body: str, *names: str) -> str:
    """``WITH`` clause holding ``names`` and everything they depend on, then ``body``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][1].strip()})" for n in order]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
