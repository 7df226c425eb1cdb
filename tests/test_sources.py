"""CSV inputs: declared schemas, empty, NaN and 'None' cells, rejected rows, the ready-made panel."""
import csv

from vendorlens.sources import io, schemas

SF = "/root/testdata/sf0.001"


def test_csv_cells(spark, tmp_path):
    path = tmp_path / "fact_invoice.csv"
    path.write_text("invoice_id,supplier_id,purchase_order_id,fiscal_quarter,invoice_error_flag,dispute_raised_flag,"
                    "invoice_error_type,days_to_payment,invoice_variance_inr\n"
                    "1,2,3,FY24-25-Q1,0,0,None,NaN,\n,2,3,,1,0,Tax error,4.5,-7\nx,2,3,,1,0,Tax error,4.5,-7\n")
    rows = io.read_csv_table(spark, str(path), schemas.FACT_INVOICE).collect()
    assert rows[0].invoice_error_type == "None" and rows[0].days_to_payment is None and rows[0].invoice_variance_inr is None
    assert rows[1].invoice_id is None and rows[1].fiscal_quarter is None and rows[1].invoice_variance_inr == -7
    assert io.rejected_rows(spark, str(path), schemas.FACT_INVOICE) == 1


def test_missing_value_tokens(spark, tmp_path):
    tokens = [t for t in io.MISSING if t]
    head = ",".join(schemas.FACT_INVOICE.names)
    lines = [f"{n},{t},3,{t},0,{t},{t},{t},1.5" for n, t in enumerate(tokens)]
    lines += ["100,2,3,FY24-25-Q1,1,0,Tax error,4.5,-7", "101,2,3,FY24-25-Q1,yes,0,,4.5,-7", "102,2.5,3,'quoted',1,0,none,1e3, 7"]
    path = tmp_path / "fact_invoice.csv"
    path.write_text("\n".join([head, *lines]) + "\n")
    rows = {r.invoice_id: r for r in io.read_csv_table(spark, str(path), schemas.FACT_INVOICE).collect()}
    assert len(rows) == len(tokens) + 3
    for n, t in enumerate(tokens):
        r = rows[n]
        assert r.supplier_id is r.fiscal_quarter is r.dispute_raised_flag is r.days_to_payment is None and r.invoice_variance_inr == 1.5
        assert r.invoice_error_type == ("None" if t == "None" else None)  # a value of that column
    assert rows[101].invoice_error_flag is None and rows[101].invoice_error_type is None and rows[102].invoice_error_type == "none"
    counts = {r.column: (r.rows, r.missing, r.rejected) for r in io.cell_counts(spark, str(path), schemas.FACT_INVOICE).collect()}
    n = len(tokens)
    assert counts["supplier_id"] == (n + 3, n, 1) and counts["invoice_error_flag"] == (n + 3, 0, 1)
    assert counts["invoice_error_type"] == (n + 3, n, 0)  # every token but None, and an empty cell
    assert io.rejected_rows(spark, str(path), schemas.FACT_INVOICE) == 2


def test_exports_come_back(spark, tmp_path):
    from vendorlens.plans import exports as X
    axis = spark.createDataFrame([("FY99-00-Q4", 1), ("FY99-00-Q3", 0), ("FY00-01-Q1", 2)], "fiscal_quarter string, qi int")
    X.write_quarters(axis, str(tmp_path / "meta"))
    assert sorted(map(tuple, X.read_quarters(spark, str(tmp_path / "meta")).collect())) == sorted(map(tuple, axis.collect()))
    table = spark.createDataFrame([(1, 'Acme, "Ltd"', None, 0.1 + 0.2)], "rank int, supplier_name string, grade string, composite_score double")
    X.export(table, X.SCORECARD, str(tmp_path / "csv"))
    part = next((tmp_path / "csv").glob("part-*.csv"))
    assert next(csv.reader(part.read_text().splitlines())) == ["#", "Supplier", "Grade", "Score"]
    assert X.exported(spark, str(tmp_path / "csv"), table).collect() == table.collect()
    record = spark.createDataFrame([({"rf": 0.9, "lr": 0.8, "benchmark": 0.7}, 5, 0.25, ["a", "b"])],
                                   "auc map<string,double>, n long, base_rate double, quarters array<string>")
    X.write_metrics(record, str(tmp_path / "metrics"))
    assert X.read_metrics(spark, str(tmp_path / "metrics")).first().asDict() == {
        "auc_rf": 0.9, "auc_lr": 0.8, "auc_benchmark": 0.7, "n_oos": 5, "base_rate": 0.25, "quarters_scored": ["a", "b"]}


def test_panel_round_trip(spark, tmp_path):
    from vendorlens.plans import stored
    panel = stored.panel(spark, SF)
    for fmt in ("csv", "parquet"):
        io.write_table(panel, f"{tmp_path}/{io.PANEL}.{fmt}", fmt=fmt)
        back = io.read_panel(spark, str(tmp_path), fmt)
        assert back.columns == panel.columns
        def key(r):
            return r.supplier_id, r.qi
        want = sorted((tuple(r) for r in panel.collect()), key=lambda r: (r[0], r[2]))
        assert sorted((tuple(r) for r in back.collect()), key=lambda r: (r[0], r[2])) == want


def test_lags_stop_at_gaps(spark):
    from pyspark.sql import functions as F

    from vendorlens.plans import stored
    panel = {(r.supplier_id, r.qi): r for r in stored.panel(spark, SF).collect()}
    quarters = {(r.supplier_id, r.qi): r for r in stored.quarters(spark, SF).select("supplier_id", "qi", F.col("spend_inr").cast("double"), "po_count").collect()}
    gaps = 0
    for (s, q), r in panel.items():
        before, year = quarters.get((s, q - 1)), quarters.get((s, q - 4))
        gaps += before is None or year is None
        assert (r.po_count_qoq_growth_pct is None) == (before is None)
        assert (r.yoy_revenue_growth_pct is None) == (year is None)
    assert gaps
