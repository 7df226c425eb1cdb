"""Driver contract, oracle coverage, plan properties on the smallest test tables."""
import __spark_entry__ as E
from vendorlens.registry import REGISTRY, recorded_kinds

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"supplier_id", "abc_class", "spend_rank", "cum_spend_pct"} <= set(df.columns)


def test_every_oracle_key_is_a_query_and_kinds_recorded():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    kinds = recorded_kinds()
    for k in set(sqls) & set(REGISTRY):
        assert k in kinds, k


def test_panel_numeric_list_matches_schema(spark):
    from vendorlens.plans.panel import build_panel
    from vendorlens.plans.scoring import numeric_features
    from vendorlens.sources.adapter import load_inputs
    from vendorlens.suite.models import PANEL_NUMERIC
    assert numeric_features(build_panel(load_inputs(spark, SF))) == PANEL_NUMERIC


def test_no_python_udf_and_pushdown(spark):
    import re

    from vendorlens.plans import marts as M
    from vendorlens.plans import stored
    from vendorlens.sources.adapter import load_inputs, order_lines
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for k in ["supplier_summary", "cost_table", "kraljic_quadrants"]:
        text = plan(REGISTRY[k].build(spark, SF))
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    # the dealt lines read the columns that they keep, and no others
    read = re.findall(r"ReadSchema: struct<([^\n]*)", plan(order_lines(spark, SF)))
    assert not any("l_comment" in r or "o_totalprice" in r for r in read) and len(read) == 2
    # a mart over the stored lines reads its own columns only; the orders are the first lines, filtered in the scan
    spend = plan(M.spend_by_supplier(stored.inputs(spark, SF).po))
    assert re.search(r"ReadSchema: struct<l_suppkey:bigint,order_priority:string,po_value_inr:decimal\(18,2\),first_line:boolean>", spend)
    assert "PushedFilters: [IsNotNull(first_line), EqualTo(first_line,true)" in spend and "Exchange" in spend
    critical = plan(REGISTRY["watchlist"].build(spark, SF))
    assert "PushedFilters" in critical and "prob_benchmark" in critical
    raw = plan(M.category_criticality(load_inputs(spark, SF).item))
    assert "PushedFilters: [IsNotNull(p_type)]" in raw and "ReadSchema: struct<p_type:string,p_size:int>" in raw


def test_feature_labels(spark):
    import numpy as np

    from vendorlens.plans import scoring as SC
    prep = SC.Prep(["on_time_rate"], ["region"], {}, {}, {}, {"region": ["ASIA", "EUROPE_W"]})
    model = type("M", (), {"featureImportances": type("V", (), {"toArray": lambda s: np.array([0.25, 0.75])})()})()
    got = SC.feature_importance(spark, prep, model).collect()
    assert [(r.feature, r.label, r.importance) for r in got] == [("region_EUROPE_W", "region EUROPE W", 0.75), ("on_time_rate", "on time rate", 0.25)]
