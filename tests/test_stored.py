"""Stored marts: validity, quarter pruning, facts dealt once."""
import re
import shutil

import pytest

import vendorlens.suite  # noqa: F401  (registers every key)
from vendorlens.plans import filters as FL
from vendorlens.plans import marts as M
from vendorlens.plans import stored
from vendorlens.registry import REGISTRY
from vendorlens.sources.adapter import by_supplier, line_tasks, load_inputs, order_lines

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_changed_file_gives_a_new_mart(spark, tmp_path):
    folder = str(tmp_path / "sf")
    shutil.copytree(SF, folder)
    (tmp_path / "sf").chmod(0o755)  # the test tables' folder is read-only, and its mode is copied
    before = stored.axis(spark, folder)
    path = stored.once_at(spark, folder, "axis", lambda at: pytest.fail("stored already"))
    assert before.count() == stored.axis(spark, folder).count()
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    (tmp_path / "sf" / "orders.parquet").unlink()
    orders.limit(3).coalesce(1).write.parquet(f"{folder}/orders.parquet")
    again = stored.axis(spark, folder)
    assert again.count() <= 3
    assert stored.once_at(spark, folder, "axis", lambda at: None) != path
    with pytest.raises(Exception, match="(?i)path|exist|found"):  # the old one is removed
        spark.read.parquet(path).count()


@pytest.mark.parametrize("key", ["filter_quarter_range", "scored_filtered"])
def test_quarter_ranges_prune_files(spark, key):
    df = REGISTRY[key].build(spark, SF)
    filters = [re.search(r"PartitionFilters: \[(.*)", s).group(1) for s in plan(df).split("\n") if "PartitionFilters: [" in s]
    # the range itself, or the broadcast rows of the axis, known when the query runs
    assert any("qi#" in f and ("ubquery" in f or "dynamicpruning" in f) for f in filters), filters


def test_quarters_are_partitioned_and_unchanged(spark):
    for table in (stored.quarters, stored.panel, stored.scored_panel):
        df = table(spark, SF)
        assert all(re.search(r"/qi=\d+/", f) for f in df.inputFiles())
    built = M.supplier_quarter(load_inputs(spark, SF), stored.axis(spark, SF))
    kept = stored.quarters(spark, SF)
    assert kept.dtypes == built.dtypes
    key = lambda r: (r.supplier_id, r.qi)
    assert [r.spend_inr for r in sorted(kept.collect(), key=key)] == [r.spend_inr for r in sorted(built.collect(), key=key)]


def test_lines_meet_their_orders_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = plan(order_lines(spark, SF))
        assert dealt.count("Exchange hashpartitioning(l_orderkey") == 1 and dealt.count("Exchange hashpartitioning(o_orderkey") == 1
        assert dealt.count("Exchange") == 2  # the sums per order and supplier need no other
        inp = stored.inputs(spark, SF)
        for mart in (M.supplier_summary(inp, stored.axis(spark, SF)), M.supplier_quarter(inp, stored.axis(spark, SF))):
            text = plan(mart) + mart._jdf.queryExecution().optimizedPlan().toString()
            assert "orderkey, " not in re.sub(r"#\d+L?", "", " ".join(re.findall(r"hashpartitioning\(([^)]*)", text)))
        for fact in (M.receipt_enriched(inp), inp.order_invoice, inp.po):
            assert "Exchange" not in plan(fact) and "Join" not in plan(fact)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dealt_facts_equal_joined_ones(spark):
    inp = load_inputs(spark, SF)
    joined = load_inputs(spark, SF)
    joined.order_receipt = joined.order_invoice = None
    columns = M.receipt_enriched(joined).columns
    assert M.receipt_enriched(inp).select(*columns).exceptAll(M.receipt_enriched(joined)).count() == 0
    assert M.invoice_by_order_quarter(inp).exceptAll(M.invoice_by_order_quarter(joined)).count() == 0


def test_selected_rows_are_those_in_the_range(spark):
    dq, sup = stored.axis(spark, SF), stored.suppliers(spark, SF)
    labels = {r.qi: r.fiscal_quarter for r in dq.collect()}
    got = FL.fsq(stored.quarters(spark, SF), sup, dq, FL.Filters(quarter_range=(labels[7], labels[4])))
    want = stored.quarters(spark, SF).where("qi between 4 and 7").join(sup.select("supplier_id"), "supplier_id", "left_semi")
    assert got.count() == want.count() > 0 and {r.qi for r in got.select("qi").distinct().collect()} == {4, 5, 6, 7}


def test_large_inputs_get_more_tasks_and_equal_lines(spark, monkeypatch):
    from vendorlens import session
    few = order_lines(spark, SF)
    monkeypatch.setattr(session, "FILE_BYTES_PER_TASK", 4096)
    n = line_tasks(spark, SF)
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = order_lines(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(order_lines(spark, SF)).count("Exchange") == 2 and f", {n})" in plan(order_lines(spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert many.exceptAll(few).count() == few.exceptAll(many).count() == 0


def test_stored_lines_are_together_by_supplier(spark):
    from pyspark.sql import functions as F
    assert "rebalance_partitions_by_col" in plan(by_supplier(order_lines(spark, SF), 40)).lower()
    files = stored.lines(spark, SF).select("l_suppkey", F.input_file_name().alias("file")).distinct()
    assert files.groupBy("l_suppkey").count().where("count > 1").count() == 0
    kept, built = stored.lines(spark, SF), order_lines(spark, SF)
    assert kept.exceptAll(built).count() == built.exceptAll(kept).count() == 0


def test_delivery_percentiles_of_odd_delays(spark):
    rows = [(1, 10 * i, 1, 1, 1, d, 0, 1.0, 2.0) for i, d in enumerate([0.0, 0.0, 3.5, None, 7.0, 0.0])]
    rows += [(2, 1, None, None, None, None, None, None, None), (None, 2, 1, 1, 1, 5.0, 0, 1.0, 1.0)]
    rec = spark.createDataFrame(rows, "supplier_id long, goods_receipt_id long, on_time_flag int, in_full_flag int, otif int, "
                                      "delay_days double, stockout_triggered_flag int, rejected_quantity double, received_quantity double")
    got = {r.supplier_id: r for r in M.delivery_by_supplier(rec).collect()}
    assert set(got) == {1, 2} and got[1].lines == 6 and got[2].lines == 1
    assert got[1].avg_delay_days == pytest.approx(2.1) and got[1].max_delay_days == 7.0 and got[1].stockouts == 0
    assert got[1].p90_delay_days == pytest.approx(3.5 + 0.6 * 3.5) and got[1].reject_rate_pct == pytest.approx(50.0)
    assert got[2].p90_delay_days is None and got[2].on_time_rate is None and got[2].reject_rate_pct is None


def test_csv_inputs_are_compressed_and_read_alike(spark, tmp_path):
    from vendorlens.sources import io
    from vendorlens.sources.adapter import file_inputs
    io.write_inputs(file_inputs(spark, SF, stored.lines(spark, SF)), str(tmp_path), "csv")
    files = [p for p in tmp_path.rglob("part-*")]
    assert files and all(p.name.endswith(".csv.gz") for p in files)
    read = io.read_inputs(spark, str(tmp_path), "csv")
    assert read.receipt.count() == order_lines(spark, SF).count()
    read.tasks = 50
    assert M.receipt_enriched(read).count() == read.receipt.count() and ", 50)" in plan(M.receipt_enriched(read))


def test_the_sweep_is_spread_and_unchanged(spark, monkeypatch):
    from vendorlens.plans import scorecard as S
    sup = stored.suppliers(spark, SF)
    few = S.weight_sweep(sup, 20).collect()
    monkeypatch.setattr(S, "SWEEP_ROWS_PER_TASK", 10)
    assert S.tasks_for(spark, sup.count() * 20, 10) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = S.weight_sweep(sup, 20).collect()
    key = lambda r: r.weight_id
    for a, b in zip(sorted(few, key=key), sorted(many, key=key), strict=True):
        assert a.rank_corr == pytest.approx(b.rank_corr, abs=1e-9) and a.bottom_retained == b.bottom_retained
