"""Edge semantics of the marts: latest risk, min-max benchmark, filters, outer union."""
from pyspark.sql import functions as F

from vendorlens.plans import filters as FL
from vendorlens.plans.marts import latest_risk
from vendorlens.plans.panel import benchmark_score


def test_unknown_quarter_risk_row_wins(spark):
    dq = spark.createDataFrame([("FY23-24-Q1", 0), ("FY23-24-Q3", 2)], "fiscal_quarter string, qi int")
    cols = ["external_credit_score", "credit_rating", "altman_z_score", "days_sales_outstanding",
            "debt_to_equity_ratio", "current_ratio", "promoter_pledge_pct", "news_sentiment_score",
            "litigation_case_count"]
    schema = "supplier_id long, fiscal_quarter string, " + ", ".join(
        f"{c} {'string' if c == 'credit_rating' else 'int' if c == 'litigation_case_count' else 'double'}" for c in cols)
    rows = [(1, "FY23-24-Q3", 60.0, "B", 2.0, 1.0, 1.0, 1.0, 1.0, 0.1, 0),
            (1, "FY99-00-Q9", 40.0, "C", 1.0, 1.0, 1.0, 1.0, 1.0, 0.1, 0),
            (2, "FY23-24-Q1", 70.0, "B", 2.0, 1.0, 1.0, 1.0, 1.0, 0.1, 0),
            (2, "FY23-24-Q3", 80.0, "A", 2.0, 1.0, 1.0, 1.0, 1.0, 0.1, 0)]
    got = {r["supplier_id"]: r["risk_as_of"] for r in latest_risk(spark.createDataFrame(rows, schema), dq).collect()}
    assert got == {1: "FY99-00-Q9", 2: "FY23-24-Q3"}


def test_minmax_benchmark(spark):
    rows = [(1, "a", 1.0), (2, "a", 3.0), (3, "b", 2.0), (4, "b", 2.0), (5, "c", None), (6, "c", None)]
    df = spark.createDataFrame(rows, "supplier_id long, fiscal_quarter string, rolling_2q_on_time_rate double")
    got = {r[0]: r[1] for r in benchmark_score(df).select("supplier_id", "prob_benchmark").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.5, 4: 0.5, 5: 0.5, 6: 0.5}


def test_filters(spark):
    sup = spark.createDataFrame(
        [(1, "X", "Strategic", "ASIA", "Large", "A", 1), (2, "Y", "Preferred", "EUROPE", "Medium", "B", 0),
         (3, "X", "Preferred", "ASIA", "Large", "C", None)],
        "supplier_id long, primary_category string, supplier_tier string, region string, business_size string, "
        "abc_class string, is_sole_source int")
    ids = lambda f: sorted(r[0] for r in FL.supplier_ids(sup, f).collect())
    assert ids(FL.Filters()) == [1, 2, 3]
    assert ids(FL.Filters(categories=["X"])) == [1, 3]
    assert ids(FL.Filters(sourcing=FL.SOLE_ONLY)) == [1]
    assert ids(FL.Filters(sourcing=FL.ALTERNATIVES_ONLY)) == [2]  # NULL flag fails both choices
    dq = spark.createDataFrame([(f"Q{i}", i) for i in range(5)], "fiscal_quarter string, qi int")
    span = lambda v: sorted(r.qi for r in FL.quarter_range(dq, FL.Filters(quarter_range=v)).collect())
    assert span(("Q3", "Q1")) == [1, 2, 3] and span(["Q2", "Q2"]) == [2]
    assert span(("Q3", "nope")) == span("Q2") == span(None) == span(("nope", "nope")) == [0, 1, 2, 3, 4]
