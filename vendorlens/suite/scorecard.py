"""Keys for the weighted scorecard and its robustness checks."""
from __future__ import annotations

from pyspark.sql import functions as F

from oraclesql.ctes import cte, with_ctes
from vendorlens import constants as K
from vendorlens.plans import exports as X
from vendorlens.plans import stored
from vendorlens.plans import scorecard as S
from vendorlens.registry import register
from vendorlens.session import materialize

ALT_WEIGHTS = (10.0, 10.0, 70.0, 10.0)  # invoice accuracy dominant: the "different story" case
SEARCH_GRADES = ["B — Maintain", "C — Develop"]
SEARCH_PATTERN = "supplier#0000000[1-3]"
SWEEP_SETS = 800


def _sup(spark, sf):
    return stored.suppliers(spark, sf)


def _pillars(spark, sf):
    return materialize(S.pillars(_sup(spark, sf)))


def _norm(w):
    t = max(sum(w), 1e-9)
    return [x / t for x in w]


# ---------------------------------------------------------------- oracle texts
def _pr(col: str, hib: bool) -> str:
    r = (f"(rank() OVER (ORDER BY {col}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2.0)"
         f" / count({col}) OVER ()")
    expr = r if hib else f"(1 - {r})"
    return f"CASE WHEN {col} IS NULL THEN NULL ELSE {expr} * 100 END"


cte("m_pr", ["m_sup"], "SELECT supplier_id, " + ", ".join(
    f"{_pr(m, h)} AS pr_{m}" for m, h in S.METRICS) + " FROM m_sup")

cte("m_pillars", ["m_sup", "m_pr"], """
SELECT s.*, p.pr_otif_rate * CAST(0.6 AS DOUBLE) + p.pr_avg_delay_days * CAST(0.4 AS DOUBLE) AS delivery_score,
  p.pr_reject_rate_pct AS quality_score,
  p.pr_invoice_accuracy * CAST(0.7 AS DOUBLE) + p.pr_dispute_rate * CAST(0.3 AS DOUBLE) AS invoice_score,
  p.pr_external_credit_score AS financial_score
FROM m_sup s LEFT JOIN m_pr p ON s.supplier_id = p.supplier_id""")


def _composite_sql(w) -> str:
    wd, wq, wi, wf = _norm(w)
    return (f"delivery_score * CAST({wd!r} AS DOUBLE) + quality_score * CAST({wq!r} AS DOUBLE)"
            f" + invoice_score * CAST({wi!r} AS DOUBLE) + financial_score * CAST({wf!r} AS DOUBLE)")


def _grade_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} > {lo!r} AND {c} <= {hi!r} THEN '{name}'"
                              for lo, hi, name in K.GRADE_BINS) + " END"


def _scorecard_cte(name: str, w) -> None:
    cte(name, ["m_pillars"], f"""
SELECT *, {_grade_sql('composite_score')} AS grade,
  row_number() OVER (ORDER BY composite_score DESC NULLS LAST, supplier_id) AS rank
FROM (SELECT *, {_composite_sql(w)} AS composite_score FROM m_pillars) t""")


_scorecard_cte("m_sc_base", tuple(K.BASE_WEIGHTS.values()))
_scorecard_cte("m_sc_alt", ALT_WEIGHTS)

cte("m_moves", ["m_sc_alt", "m_sc_base"], """
SELECT a.*, b.rank AS base_rank, b.composite_score AS base_composite, b.rank - a.rank AS rank_move
FROM m_sc_alt a JOIN m_sc_base b ON a.supplier_id = b.supplier_id""")

SC_COLS = "supplier_id, delivery_score, quality_score, invoice_score, financial_score, composite_score, grade, rank"


@register("pct_rank_metrics", with_ctes("SELECT * FROM m_pr", "m_pr"))
def pct_rank_metrics(spark, sf):
    """Pandas-style percentile ranks of the six scorecard metrics."""
    return S.pct_rank_metrics(_sup(spark, sf))


@register("scorecard_base", with_ctes(f"SELECT {SC_COLS} FROM m_sc_base", "m_sc_base"))
def scorecard_base(spark, sf):
    """Scorecard at the 40/20/15/25 base weights."""
    sc = S.build_scorecard(None, *K.BASE_WEIGHTS.values(), scored_pillars=_pillars(spark, sf))
    return sc.select(*[c.strip() for c in SC_COLS.split(",")])


def _moves(spark, sf):
    p = _pillars(spark, sf)
    base = S.build_scorecard(None, *K.BASE_WEIGHTS.values(), scored_pillars=p)
    alt = S.build_scorecard(None, *ALT_WEIGHTS, scored_pillars=p)
    return materialize(S.rank_moves(alt, base))


@register("scorecard_rank_moves", with_ctes("""
SELECT supplier_id, rank, base_rank, rank_move, composite_score, base_composite FROM m_moves""", "m_moves"))
def scorecard_rank_moves(spark, sf):
    """Rank moves of the invoice-heavy weighting against the base."""
    return _moves(spark, sf).select("supplier_id", "rank", "base_rank", "rank_move", "composite_score",
                                    "base_composite")


@register("scorecard_stability", with_ctes("""
SELECT (SELECT count(*) FROM m_moves) AS suppliers,
  (SELECT corr(r_now, r_base) FROM (
     SELECT rank() OVER (ORDER BY composite_score) + (count(*) OVER (PARTITION BY composite_score) - 1) / 2.0 AS r_now,
            rank() OVER (ORDER BY base_composite) + (count(*) OVER (PARTITION BY base_composite) - 1) / 2.0 AS r_base
     FROM m_moves WHERE composite_score IS NOT NULL AND base_composite IS NOT NULL) r) AS rank_corr,
  k, count_if(rank > n - k AND base_rank > n - k) AS bottom_retained,
  count_if(rank <= k AND base_rank <= k) AS top_retained, max(abs(rank_move)) AS max_move
FROM (SELECT *, CAST(greatest(3, least(30, floor(n / 10))) AS BIGINT) AS k
      FROM (SELECT *, count(*) OVER () AS n FROM m_moves) a) b GROUP BY k""", "m_moves"))
def scorecard_stability(spark, sf):
    """Spearman ρ, top/bottom-k retention, largest move."""
    return S.stability(_moves(spark, sf))


@register("rank_movers", with_ctes("""
SELECT supplier_id, substr(supplier_name, 1, 28) AS supplier_label, rank, base_rank, rank_move,
  abs(rank_move) AS abs_move
FROM m_moves WHERE rank_move <> 0 ORDER BY abs(rank_move) DESC, rank LIMIT 10""", "m_moves"))
def rank_movers(spark, sf):
    """Ten largest moves."""
    return S.rank_movers(_moves(spark, sf))


@register("grade_distribution", with_ctes(f"""
SELECT d.grade, d.grade_order, coalesce(c.n, 0) AS suppliers
FROM (VALUES {", ".join(f"('{g}', {i})" for i, g in enumerate(K.GRADE_ORDER))}) d(grade, grade_order)
LEFT JOIN (SELECT grade, count(*) AS n FROM m_sc_base GROUP BY grade) c ON d.grade = c.grade""", "m_sc_base"))
def grade_distribution(spark, sf):
    """Grade counts over the fixed grade domain."""
    return S.grade_distribution(S.build_scorecard(None, *K.BASE_WEIGHTS.values(), scored_pillars=_pillars(spark, sf)))


@register("pillar_profile", with_ctes("""
SELECT slice, avg(delivery_score) AS delivery_score, avg(quality_score) AS quality_score,
  avg(invoice_score) AS invoice_score, avg(financial_score) AS financial_score, count(*) AS suppliers
FROM (SELECT *, CASE WHEN rank <= k THEN 'top' WHEN rank > n - k THEN 'bottom' END AS slice
      FROM (SELECT *, greatest(3, least(30, floor(n / 10))) AS k
            FROM (SELECT *, count(*) OVER () AS n FROM m_sc_base) a) b) c
WHERE slice IS NOT NULL GROUP BY slice""", "m_sc_base"))
def pillar_profile(spark, sf):
    """Mean pillars of the top-k and bottom-k."""
    return S.pillar_profile(S.build_scorecard(None, *K.BASE_WEIGHTS.values(), scored_pillars=_pillars(spark, sf)))


@register("scorecard_search", with_ctes(f"""
SELECT rank, supplier_id, supplier_name, supplier_tier, primary_category, abc_class, composite_score,
  delivery_score, quality_score, invoice_score, financial_score, otif_rate * 100 AS otif_pct,
  invoice_accuracy * 100 AS invoice_accuracy_pct, external_credit_score,
  CAST(total_spend_inr AS DOUBLE) / 1e7 AS spend_cr, grade
FROM m_sc_base WHERE grade IN ({", ".join(f"'{g}'" for g in SEARCH_GRADES)})
  AND coalesce(regexp_matches(supplier_name, '{SEARCH_PATTERN}', 'i'), false)""", "m_sc_base"))
def scorecard_search(spark, sf):
    """Grade filter and case-insensitive regex name search."""
    sc = S.build_scorecard(None, *K.BASE_WEIGHTS.values(), scored_pillars=_pillars(spark, sf))
    return S.search(sc, SEARCH_GRADES, SEARCH_PATTERN)


cte("m_ws", [], f"""
SELECT range + 1 AS weight_id, CAST((range + 1) * 37 % 101 AS DOUBLE) AS w_delivery,
  CAST((range + 1) * 53 % 103 AS DOUBLE) AS w_quality,
  CAST((range + 1) * 71 % 107 AS DOUBLE) AS w_invoice,
  CAST((range + 1) * 89 % 109 AS DOUBLE) AS w_financial
FROM range({SWEEP_SETS})""")

cte("m_sweep_rows", ["m_sc_base", "m_ws"], """
SELECT *, row_number() OVER (PARTITION BY weight_id ORDER BY composite_score DESC NULLS LAST, supplier_id) AS rank
FROM (SELECT b.supplier_id, b.composite_score AS base_composite, b.rank AS base_rank, w.weight_id,
        (b.delivery_score * (w.w_delivery / tot) + b.quality_score * (w.w_quality / tot)
         + b.invoice_score * (w.w_invoice / tot) + b.financial_score * (w.w_financial / tot)) AS composite_score
      FROM m_sc_base b JOIN (SELECT *, greatest(w_delivery + w_quality + w_invoice + w_financial, 1e-9) AS tot
                             FROM m_ws) w ON true) t""")


cte("m_sweep", ["m_ws", "m_sweep_rows"], """
SELECT w.*, r.rank_corr, t.bottom_retained, t.k, t.bottom_retained / t.k AS bottom_retention
FROM m_ws w
LEFT JOIN (SELECT weight_id, corr(r_now, r_base) AS rank_corr FROM (
    SELECT weight_id,
      rank() OVER (PARTITION BY weight_id ORDER BY composite_score)
        + (count(*) OVER (PARTITION BY weight_id, composite_score) - 1) / 2.0 AS r_now,
      rank() OVER (PARTITION BY weight_id ORDER BY base_composite)
        + (count(*) OVER (PARTITION BY weight_id, base_composite) - 1) / 2.0 AS r_base
    FROM m_sweep_rows WHERE composite_score IS NOT NULL AND base_composite IS NOT NULL) x GROUP BY weight_id) r
  ON w.weight_id = r.weight_id
LEFT JOIN (SELECT weight_id, count_if(rank > n - k AND base_rank > n - k) AS bottom_retained, k FROM (
    SELECT *, CAST(greatest(3, least(30, floor(n / 10))) AS BIGINT) AS k FROM (
      SELECT *, count(*) OVER (PARTITION BY weight_id) AS n FROM m_sweep_rows) a) b GROUP BY weight_id, k) t
  ON w.weight_id = t.weight_id""")


@register("weight_sweep", with_ctes("SELECT * FROM m_sweep", "m_sweep"))
def weight_sweep(spark, sf):
    """800 deterministic weight sets, rank correlation and bottom-k retention against the base."""
    return S.weight_sweep(_sup(spark, sf), SWEEP_SETS)


@register("weight_sweep_summary", with_ctes("""
SELECT count(*) AS weight_sets, avg(rank_corr) AS mean_rank_corr, min(rank_corr) AS min_rank_corr,
  avg(bottom_retention) AS mean_bottom_retention, min(bottom_retention) AS min_bottom_retention FROM m_sweep""", "m_sweep"))
def weight_sweep_summary(spark, sf):
    """The sweep in one row."""
    return S.sweep_summary(S.weight_sweep(_sup(spark, sf), SWEEP_SETS))


def _shown(x: str, digits: int) -> str:
    return f"round_even(({x}) * {10 ** digits}.0::DOUBLE, 0) / {10 ** digits}.0::DOUBLE"


@register("scorecard_export", with_ctes(f"""
SELECT rank, supplier_name, supplier_tier, primary_category, abc_class, composite_score, delivery_score, quality_score,
  invoice_score, financial_score, {_shown('otif_rate * 100', 1)} AS otif_rate, {_shown('invoice_accuracy * 100', 1)} AS invoice_accuracy,
  external_credit_score, {_shown('CAST(total_spend_inr AS DOUBLE) / 1e7', 2)} AS total_spend_inr, rank_move, grade
FROM m_moves""", "m_moves"))
def scorecard_export(spark, sf):
    """The ranking as the exported CSV file holds it."""
    table = X.scorecard_table(_moves(spark, sf))
    path = stored.once_at(spark, sf, "scorecard-csv", lambda at: X.export(table, X.SCORECARD, at))
    return X.exported(spark, path, table)
