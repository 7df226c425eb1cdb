"""Fixed values that results depend on.

FIXED VALUES — these must equal the analytics being reproduced; do not edit to make a test pass.
"""

# Domains of the supplier attributes.
TIERS = ["Strategic", "Preferred", "Transactional"]
SIZES = ["Large", "Medium", "Micro/Small"]
SEVERITIES = ["Critical", "High", "Medium", "Low"]
HIGH_SEVERITIES = ["High", "Critical"]
EMERGENCY = "Emergency"
NO_ERROR_TYPE = "None"

# Delivery-failure probability bands: p >= 0.70 Critical, >= 0.45 High, >= 0.20 Moderate, else Low.
RISK_BANDS = [("Critical", 0.70), ("High", 0.45), ("Moderate", 0.20)]
RISK_BAND_LOW = "Low"
RISK_BAND_ORDER = ["Critical", "High", "Moderate", "Low"]
AT_RISK_THRESHOLD = 0.45

# Scorecard grades on the composite score, right-closed bins (-0.01,25] (25,50] (50,75] (75,100.01].
GRADE_BINS = [(-0.01, 25.0, "D — Exit / Replace"), (25.0, 50.0, "C — Develop"),
              (50.0, 75.0, "B — Maintain"), (75.0, 100.01, "A — Preferred")]
GRADE_ORDER = ["A — Preferred", "B — Maintain", "C — Develop", "D — Exit / Replace"]

# Base pillar weights: delivery 40, quality 20, invoice 15, financial 25.
BASE_WEIGHTS = {"w_delivery": 40.0, "w_quality": 20.0, "w_invoice": 15.0, "w_financial": 25.0}

# ABC classes on cumulative spend share: <= 70 A, <= 90 B, else C.
ABC_A_MAX = 70.0
ABC_B_MAX = 90.0

# Kraljic quadrant order and the posture text per quadrant.
QUADRANTS = ["Strategic", "Bottleneck", "Leverage", "Non-critical"]
QUADRANT_ACTIONS = {
    "Strategic": "Dual-source now, executive review, joint continuity plan",
    "Bottleneck": "Qualify an alternate, hold buffer stock, redesign out where possible",
    "Leverage": "Competitive tendering, hold performance, protect the margin",
    "Non-critical": "Automate ordering, consolidate vendors, review annually",
}

# Threshold grid of the cost table: 0.02, 0.04, ..., 0.98 (49 values).
GRID_START = 0.02
GRID_STEP = 0.02
GRID_SIZE = 49

# Economics defaults: missed failure 8.5 lakh, mitigation action 60 thousand, reviews per quarter 40.
DEFAULT_COST_MISS = 8.5e5
DEFAULT_COST_ACTION = 60e3
DEFAULT_CAPACITY = 40

# Attention-flag limits.
PLEDGE_LIMIT = 50.0
ALTMAN_DISTRESS = 1.8

# Model target and feature handling.
TARGET = "target_delivery_failure_next_q"
CATEGORICAL_FEATURES = ["supplier_tier", "business_size", "primary_category", "region"]
FEATURE_EXCLUDE = [TARGET, "target_supplier_exit_next_q", "target_disengaged_next_q", "supplier_id",
                   "fiscal_quarter", "credit_rating", "qi"]
FIRST_SCORED_QI = 6

# External financial features (the rest are operational / commercial).
FINANCIAL_FEATURES = ["external_credit_score", "altman_z_score", "days_sales_outstanding",
                      "debt_to_equity_ratio", "current_ratio", "yoy_revenue_growth_pct",
                      "news_sentiment_score", "gst_filing_delay_flag", "litigation_case_count",
                      "promoter_pledge_pct", "credit_score_change", "event_count", "critical_event_count"]

# What-if levers: (feature, label, low, high, scale to model units).
LEVERS = [
    ("rolling_2q_on_time_rate", "Two-quarter rolling on-time rate (%)", 0.0, 100.0, 0.01),
    ("on_time_rate", "On-time rate this quarter (%)", 0.0, 100.0, 0.01),
    ("otif_rate", "OTIF rate (%)", 0.0, 100.0, 0.01),
    ("avg_delay_days", "Average delay (days)", 0.0, 30.0, 1.0),
    ("reject_rate_pct", "Rejection rate (%)", 0.0, 10.0, 1.0),
    ("invoice_error_rate", "Invoice error rate (%)", 0.0, 100.0, 0.01),
    ("external_credit_score", "External credit score", 1.0, 100.0, 1.0),
    ("altman_z_score", "Altman Z score", -1.0, 7.0, 1.0),
    ("days_sales_outstanding", "Days sales outstanding", 10.0, 220.0, 1.0),
    ("promoter_pledge_pct", "Promoter pledge (%)", 0.0, 95.0, 1.0),
    ("event_count", "Incidents logged this quarter", 0.0, 12.0, 1.0),
    ("po_count_qoq_growth_pct", "Order volume change QoQ (%)", -80.0, 200.0, 1.0),
]
LEVER_POINTS = 9
