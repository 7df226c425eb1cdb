"""Keys for the statistics and the Spark ML models.

SQL-checked: folds, class weights, preparation statistics, category levels, AUC and ROC of the
benchmark score. ML keys (random forest, logistic regression, importances, what-if) are
rows-only and use the library defaults (400 trees, depth 30, up to 3000 iterations). The out-of-sample scores are
stored fold by fold and the final forest when it is fitted; a later run goes on from there.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from oraclesql.ctes import cte, with_ctes
from vendorlens import constants as K
from vendorlens.operators import stats as ST
from vendorlens.plans import exports as X
from vendorlens.plans import panel as P
from vendorlens.plans import portfolio as G
from vendorlens.plans import scoring as SC
from vendorlens.plans import stored
from vendorlens.registry import register
from vendorlens.sources.io import written
from vendorlens.suite.risk import PROB, fscored

# Numeric panel features in schema order (M1); a test checks this against the panel schema.
PANEL_NUMERIC = ["lines", "po_count", "on_time_rate", "in_full_rate", "otif_rate", "avg_delay_days", "stockouts",
                 "reject_rate_pct", "invoice_error_rate", "dispute_rate", "total_spend_inr",
                 "spend_share_of_quarter_pct", "external_credit_score", "altman_z_score", "days_sales_outstanding",
                 "debt_to_equity_ratio", "current_ratio", "promoter_pledge_pct", "news_sentiment_score",
                 "gst_filing_delay_flag", "litigation_case_count", "is_sole_source", "num_alternate_suppliers",
                 "event_count", "critical_event_count", "rolling_2q_on_time_rate", "po_count_qoq_growth_pct",
                 "credit_score_change", "yoy_revenue_growth_pct"]
KEY_PARAMS = SC.ModelParams()
SCENARIO = {"on_time_rate": 10.0, "external_credit_score": 5.0}


def _panel(spark, sf):
    return stored.panel(spark, sf)


@register("expanding_folds", with_ctes(f"""
SELECT test_qi, test_rows, test_positives, coalesce(sum(n) OVER w, 0) AS train_rows,
  coalesce(sum(pos) OVER w, 0) AS train_positives
FROM (SELECT qi AS test_qi, count(*) AS n, coalesce(sum(target_delivery_failure_next_q), 0) AS pos,
        count(*) AS test_rows, coalesce(sum(target_delivery_failure_next_q), 0) AS test_positives
      FROM m_panel GROUP BY qi) t
WINDOW w AS (ORDER BY test_qi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
QUALIFY test_qi >= {K.FIRST_SCORED_QI}""", "m_panel"))
def expanding_folds(spark, sf):
    """Fold sizes of the expanding-window split."""
    return SC.expanding_folds(_panel(spark, sf))


@register("class_weights", with_ctes("""
SELECT target_delivery_failure_next_q, count(*) AS n_c,
  (SELECT count(*) FROM m_panel) / (count(*) * 2.0) AS weight
FROM m_panel GROUP BY target_delivery_failure_next_q""", "m_panel"))
def class_weights(spark, sf):
    """M7: balanced class weights over the whole panel."""
    return SC.class_weights(_panel(spark, sf))


_MED = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, median(CAST({c} AS DOUBLE)) AS median FROM m_panel" for c in PANEL_NUMERIC)
_MOM = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg(coalesce(CAST({c} AS DOUBLE), (SELECT median FROM m_med WHERE feature = '{c}'))) AS mean,"
    f" stddev_pop(coalesce(CAST({c} AS DOUBLE), (SELECT median FROM m_med WHERE feature = '{c}'))) AS std FROM m_panel"
    for c in PANEL_NUMERIC)
cte("m_med", ["m_panel"], _MED)
cte("m_mom", ["m_panel", "m_med"], _MOM)


@register("impute_median", with_ctes("""
SELECT m.feature, m.median, o.mean, o.std FROM m_med m JOIN m_mom o ON m.feature = o.feature""", "m_med", "m_mom"))
def impute_median(spark, sf):
    """M2/M3: exact medians and the mean / population std after imputation (whole panel)."""
    return SC.prep_statistics(_panel(spark, sf), PANEL_NUMERIC, K.CATEGORICAL_FEATURES)


_STD = ", ".join(
    f"(coalesce(CAST(p.{c} AS DOUBLE), (SELECT median FROM m_med WHERE feature = '{c}'))"
    f" - (SELECT mean FROM m_mom WHERE feature = '{c}'))"
    f" / coalesce(nullif((SELECT std FROM m_mom WHERE feature = '{c}'), 0), 1) AS n_{c}" for c in PANEL_NUMERIC)


@register("standardise", with_ctes(f"""
SELECT p.supplier_id, p.fiscal_quarter, {_STD} FROM m_panel p""", "m_panel", "m_med", "m_mom"))
def standardise(spark, sf):
    """M3: every numeric feature imputed, centred and scaled as the models see it (whole panel)."""
    panel = _panel(spark, sf)
    prep = SC.fit_prep(panel, PANEL_NUMERIC, K.CATEGORICAL_FEATURES)
    return prep.transform(panel).select("supplier_id", "fiscal_quarter", *[f"n_{c}" for c in PANEL_NUMERIC])


_LEV = " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS feature, {c} AS category FROM m_panel WHERE {c} IS NOT NULL"
                          for c in K.CATEGORICAL_FEATURES)


@register("one_hot", with_ctes(f"""
SELECT feature, category, row_number() OVER (PARTITION BY feature ORDER BY category) - 1 AS position,
  row_number() OVER (PARTITION BY feature ORDER BY category) > 1 AS encoded
FROM ({_LEV}) l""", "m_panel"))
def one_hot(spark, sf):
    """M4: sorted categories per categorical feature; the first one is the dropped base level."""
    return SC.category_levels(_panel(spark, sf), K.CATEGORICAL_FEATURES)


@register("auc_benchmark", with_ctes("""
SELECT 'benchmark' AS model, CASE WHEN p > 0 AND q > 0 THEN (sr - p * (p + 1) / 2.0) / (p * q) END AS auc,
  p + q AS n, p AS positives
FROM (SELECT sum(CASE WHEN y = 1 THEN r END) AS sr, count_if(y = 1) AS p, count_if(y = 0) AS q FROM (
        SELECT target_delivery_failure_next_q AS y,
          rank() OVER (ORDER BY prob_benchmark) + (count(*) OVER (PARTITION BY prob_benchmark) - 1) / 2.0 AS r
        FROM m_fsc WHERE prob_benchmark IS NOT NULL AND target_delivery_failure_next_q IS NOT NULL) a) b""", "m_fsc"))
def auc_benchmark(spark, sf):
    """M9: exact AUC of the one-column benchmark over the scored quarters."""
    return ST.auc(fscored(spark, sf), {"benchmark": PROB}, K.TARGET)


@register("roc_curve", with_ctes("""
SELECT 'benchmark' AS model, score AS threshold, fp / n_neg AS fpr, tp / n_pos AS tpr FROM (
  SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg
  FROM (SELECT prob_benchmark AS score, count_if(target_delivery_failure_next_q = 1) AS pos,
          count_if(target_delivery_failure_next_q = 0) AS neg
        FROM m_fsc WHERE prob_benchmark IS NOT NULL AND target_delivery_failure_next_q IS NOT NULL GROUP BY 1) s
  WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) t
WHERE n_pos > 0 AND n_neg > 0
UNION ALL
SELECT 'benchmark', NULL, 0.0, 0.0 FROM m_fsc
WHERE prob_benchmark IS NOT NULL AND target_delivery_failure_next_q IS NOT NULL
HAVING count_if(target_delivery_failure_next_q = 1) > 0 AND count_if(target_delivery_failure_next_q = 0) > 0""",
                                   "m_fsc"))
def roc_curve(spark, sf):
    """ROC points of the benchmark (all distinct scores, plus the origin)."""
    return ST.roc_points(fscored(spark, sf), {"benchmark": PROB}, K.TARGET, corners=False)


# ---------------------------------------------------------------- ML keys (rows-only checks)
def _named(kind: str) -> str:
    return f"{kind}-" + "-".join(str(v) for v in (KEY_PARAMS.num_trees, KEY_PARAMS.max_depth, KEY_PARAMS.min_leaf, KEY_PARAMS.seed,
                                                  KEY_PARAMS.lr_c, KEY_PARAMS.lr_max_iter))


def _oos(spark, sf):
    path = stored.resumed_at(spark, sf, _named("oos"), lambda at: SC.store_folds(_panel(spark, sf), KEY_PARAMS, at))
    return SC.read_folds(spark, path)


def _oos_panel(spark, sf):
    """The scored panel with the probabilities of both models, where there are some."""
    return stored.scored_panel(spark, sf).join(
        _oos(spark, sf).select("supplier_id", "fiscal_quarter", "prob_rf", "prob_lr"),
        ["supplier_id", "fiscal_quarter"], "left").where(F.col("prob_rf").isNotNull())


def _final(spark, sf):
    fitted = []

    def fit(at):
        if not written(spark, f"{at}/prep"):  # written last
            fitted.append(SC.final_model(_panel(spark, sf), KEY_PARAMS))
            SC.save_model(*fitted[0], at)
    path = stored.resumed_at(spark, sf, _named("forest"), fit)
    return fitted[0] if fitted and isinstance(fitted[0][1], SC.Forest) else SC.load_model(spark, path)  # a grown one is a stored table


@register("oos_scores")
def oos_scores(spark, sf):
    """Expanding-window out-of-sample RF and LR probabilities."""
    return _oos(spark, sf)


@register("rf_scores")
def rf_scores(spark, sf):
    """M5: out-of-sample probabilities of the random forest."""
    return _oos(spark, sf).select("supplier_id", "fiscal_quarter", "prob_rf")


@register("lr_scores")
def lr_scores(spark, sf):
    """M6: out-of-sample probabilities of the logistic regression; its folds are stored without the forests."""
    path = stored.resumed_at(spark, sf, _named("oos_lr"), lambda at: SC.store_folds(_panel(spark, sf), KEY_PARAMS, at, kinds=("lr",)))
    return SC.read_folds(spark, path, kinds=("lr",)).select("supplier_id", "fiscal_quarter", "prob_lr")


@register("model_metrics")
def model_metrics(spark, sf):
    """AUCs, scored rows, base rate and scored quarters, written as a JSON record and read back."""
    path = stored.once_at(spark, sf, _named("metrics"), lambda at: X.write_metrics(SC.metrics_record(
        _oos_panel(spark, sf), {"rf": "prob_rf", "lr": "prob_lr", "benchmark": PROB}), at))
    return X.read_metrics(spark, path).withColumn("quarters_scored", F.array_join("quarters_scored", ","))


@register("auc_models")
def auc_models(spark, sf):
    """M9 for all three scores on the out-of-sample rows (RF, LR, benchmark)."""
    return ST.auc(_oos_panel(spark, sf), {"rf": "prob_rf", "lr": "prob_lr", "benchmark": PROB}, K.TARGET)


@register("capacity_triage_models")
def capacity_triage_models(spark, sf):
    """E4 across the three scores, as on the prediction page."""
    from vendorlens.plans import economics as E
    triage = E.capacity_triage(_oos_panel(spark, sf), {"Random Forest": "prob_rf", "Logistic Regression": "prob_lr",
                                                       "Single column rule": PROB})
    return E.capacity_gain(triage, "Single column rule")


@register("feature_importance")
def feature_importance(spark, sf):
    """Importances of the forest fitted on the whole panel, top 25, with class tags."""
    prep, model = _final(spark, sf)
    return SC.feature_importance(spark, prep, model)


def _latest_rows(spark, sf):
    return G.latest_quarter_rows(stored.scored_panel(spark, sf), PROB)


@register("lever_sensitivity")
def lever_sensitivity(spark, sf):
    """L1: per supplier of the latest scored quarter, swing of each lever across its range."""
    prep, model = _final(spark, sf)
    return SC.lever_sensitivity(_latest_rows(spark, sf), prep, model)


@register("lever_sensitivity_adjusted")
def lever_sensitivity_adjusted(spark, sf):
    """L1 around the adjusted row: the levers swing while the others stand where the scenario put them."""
    prep, model = _final(spark, sf)
    return SC.lever_sensitivity(SC.adjusted_rows(_latest_rows(spark, sf), prep, SCENARIO), prep, model)


@register("scenario_rescore")
def scenario_rescore(spark, sf):
    """L2: base vs scenario probability (+10 pp on-time, +5 credit) for every latest-quarter supplier."""
    prep, model = _final(spark, sf)
    return SC.scenario_rescore(_latest_rows(spark, sf), prep, model, SCENARIO)
