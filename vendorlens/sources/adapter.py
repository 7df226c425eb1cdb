"""Maps the TPC-H-style test tables onto the eight procurement inputs.

Every column is a deterministic built-in expression of the raw tables, so DuckDB can compute the
same values (see ``oraclesql``). Only ``region`` and ``nation`` are broadcast: their row counts are
fixed by the schema (5 and 25). Supplier-sized and line-sized sides are left to the planner (AQE
switches to a broadcast join at run time only when the measured size is under the threshold).

Orders, receipts and invoices are the same order lines seen three ways. ``order_lines`` deals them once, on the
numeric order key: lines meet their order and the value of the order's part with their supplier in one
partitioning. ``plans.stored`` keeps that table, so no mart joins facts again.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vendorlens import constants as K
from vendorlens import session
from vendorlens.functions import calendar as cal

# FIXED VALUES — attribute rules of the test-table mapping.
TIER_BY_MOD5 = {0: "Strategic", 1: "Preferred", 2: "Preferred"}  # 3, 4 -> Transactional
SIZE_BY_MOD3 = {0: "Large", 1: "Medium"}  # 2 -> Micro/Small
CATEGORY_BY_MOD6 = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
ERROR_TYPE_BY_RETURNFLAG = {"A": "Price mismatch", "N": "Quantity mismatch", "R": "Tax error"}
URGENT_PRIORITY = "1-URGENT"
ROUTINE = "Routine"
ONBOARDING_ORIGIN = "2010-01-01"
K_MONEY = "decimal(18,2)"


@dataclass
class Inputs:
    supplier: DataFrame
    item: DataFrame
    contract: DataFrame
    po: DataFrame
    receipt: DataFrame
    invoice: DataFrame
    risk: DataFrame
    event: DataFrame
    #: receipts and invoices with what their order says, where the facts were dealt together
    order_receipt: DataFrame | None = None
    order_invoice: DataFrame | None = None
    #: tasks of the joins of facts, where the session's number would be too few for their size
    tasks: int | None = None


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(key, mapping: dict, default: str):
    expr = None
    for k, v in mapping.items():
        cond = key == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr.otherwise(F.lit(default))


def x_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = raw(spark, sf_dir, "supplier")
    geo = raw(spark, sf_dir, "nation").join(
        F.broadcast(raw(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    sid = F.col("s_suppkey")
    return (s.join(F.broadcast(geo), s.s_nationkey == geo.n_nationkey)
            .select(
                sid.alias("supplier_id"),
                F.col("s_name").alias("supplier_name"),
                F.concat(F.lit("V"), sid.cast("string")).alias("vendor_code"),
                _case(sid % 5, TIER_BY_MOD5, "Transactional").alias("supplier_tier"),
                _case(sid % 3, SIZE_BY_MOD3, "Micro/Small").alias("business_size"),
                _case(sid % 6, dict(enumerate(CATEGORY_BY_MOD6)), CATEGORY_BY_MOD6[-1]).alias("primary_category"),
                F.col("r_name").alias("region"),
                F.col("n_name").alias("state"),
                F.col("n_name").alias("city"),
                F.date_add(F.lit(ONBOARDING_ORIGIN).cast("date"), ((sid * 53) % 4000).cast("int")).alias("onboarding_date"),
                (sid % 7 == 0).cast("int").alias("is_sole_source"),
                F.when(sid % 7 == 0, F.lit(0)).otherwise(sid % 4).cast("int").alias("num_alternate_suppliers"),
                (sid % 4 == 1).cast("int").alias("msme_registered"),
                (sid % 3 != 2).cast("int").alias("iso_certified")))


def x_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_type").alias("item_category"),
        (F.col("p_size") / 50.0).alias("criticality_score"))


def x_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = raw(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 10 != 9)
    sid = F.col("s_suppkey")
    sla = (70 + 5 * (sid % 4)).cast("double")

    def row(k: int, extra: float):
        return s.select((sid * 10 + k).alias("contract_id"), sid.alias("supplier_id"),
                        (sla + extra).alias("sla_on_time_delivery_pct"),
                        (F.col("s_acctbal") * 12).alias("committed_annual_value_inr"),
                        (0.5 + 0.5 * (sid % 3)).cast("double").alias("penalty_clause_pct"))

    return row(1, 0.0).unionByName(row(2, 2.0).where(sid % 2 == 0))


def line_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks of a shuffle of all order lines."""
    size = sum(session.stored_bytes(spark, f"{sf_dir.rstrip('/')}/{t}.parquet") for t in ("lineitem", "orders"))
    return session.tasks_for(spark, size, session.FILE_BYTES_PER_TASK)


def by_supplier(lines: DataFrame, tasks: int) -> DataFrame:
    """The order lines brought together by supplier, to be stored: sums per supplier (and quarter) are then nearly
    whole before they are shuffled, whatever the number of suppliers. Spark splits the partition of a supplier with
    very many lines and joins small ones."""
    return lines.hint("rebalance", tasks, "l_suppkey")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line with its order's date and priority, the value of the order's part with the line's supplier
    (``po_value_inr``, exact DECIMAL) and whether it is the first line of that part. ``lineitem`` and ``orders``
    are shuffled once, by order key; the sums per part reuse that partitioning. The number of its tasks grows with
    the files."""
    li = raw(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate")
    o = raw(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", cal.fiscal_quarter_label(F.col("o_orderdate")).alias("fiscal_quarter"),
        F.when(F.col("o_orderpriority") == URGENT_PRIORITY, F.lit(K.EMERGENCY)).otherwise(F.lit(ROUTINE)).alias("order_priority"))
    n = line_tasks(spark, sf_dir)
    if n > int(spark.conf.get("spark.sql.shuffle.partitions")):
        li, o = li.repartition(n, "l_orderkey"), o.repartition(n, "o_orderkey")
    part = Window.partitionBy("l_orderkey", "l_suppkey").orderBy("l_linenumber")
    whole = part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one sort for both
    return li.join(o, li.l_orderkey == o.o_orderkey).drop("o_orderkey").withColumns({
        "dd": F.abs(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))),
        "po_value_inr": F.sum(F.col("l_extendedprice").cast(K_MONEY)).over(whole).cast(K_MONEY),
        "first_line": F.row_number().over(part) == 1})


def order_id():
    """The order of one supplier: both keys, so it is unique whatever their size. Shown, never joined on."""
    return F.concat_ws("-", "l_orderkey", "l_suppkey")


def line_id():
    """The receipt or invoice of one order line."""
    return F.concat_ws("-", "l_orderkey", "l_linenumber")


def x_po(lines: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """One order per (order, supplier)."""
    return lines.where("first_line").select(
        order_id().alias("purchase_order_id"),
        F.col("l_suppkey").alias("supplier_id"),
        "fiscal_quarter", "po_value_inr", "order_priority",
        cal.fiscal_year(F.col("o_orderdate")).alias("fiscal_year"),
        cal.fiscal_quarter_of_year(F.col("o_orderdate")).alias("fiscal_qtr"), *more)


def x_receipt(lines: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """One receipt per line, with the columns ``order`` of its order."""
    delay = F.greatest(F.lit(0), F.col("dd") % 12 - 6 - F.col("l_suppkey") % 5)
    return lines.select(
        line_id().alias("goods_receipt_id"),
        order_id().alias("purchase_order_id"),
        F.col("l_suppkey").alias("supplier_id"),
        (delay == 0).cast("int").alias("on_time_flag"),
        ((F.col("l_returnflag") != "R") | (F.col("l_linestatus") == "F")).cast("int").alias("in_full_flag"),
        (delay >= 4).cast("int").alias("stockout_triggered_flag"),
        delay.cast("double").alias("delay_days"),
        F.when(F.col("l_returnflag") == "R", F.floor(F.col("l_quantity") / 10)).otherwise(F.lit(0))
         .cast("double").alias("rejected_quantity"),
        F.col("l_quantity").cast("double").alias("received_quantity"), *order)


def x_invoice(lines: DataFrame, quarter: Column | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """One invoice per line, in the quarter of its own date or in ``quarter``."""
    err = F.col("l_discount") >= 0.09
    quarter = cal.fiscal_quarter_label(F.col("l_shipdate")) if quarter is None else quarter
    return lines.select(
        line_id().alias("invoice_id"),
        F.col("l_suppkey").alias("supplier_id"),
        order_id().alias("purchase_order_id"),
        quarter.alias("fiscal_quarter"),
        err.cast("int").alias("invoice_error_flag"),
        (err & (F.col("l_tax") >= 0.04)).cast("int").alias("dispute_raised_flag"),
        F.when(~err, F.lit(K.NO_ERROR_TYPE))
         .otherwise(_case(F.col("l_returnflag"), ERROR_TYPE_BY_RETURNFLAG, K.NO_ERROR_TYPE))
         .alias("invoice_error_type"),
        (30 + F.col("dd") % 31).cast("double").alias("days_to_payment"),
        (F.col("l_extendedprice") * (F.col("l_tax") - F.col("l_discount"))).alias("invoice_variance_inr"), *order)


def x_risk(spark: SparkSession, sf_dir: str, po: DataFrame) -> DataFrame:
    """Quarterly financial signals for every (supplier, quarter) with orders; some pairs are
    missing on purpose ((id + n) % 17 = 0). No cross product: the grain comes from the orders."""
    pairs = po.select("supplier_id", (F.col("fiscal_year") * 4 + F.col("fiscal_qtr")
                                      - F.lit(cal.QUARTER_NUMBER_ORIGIN)).alias("n"),
                      "fiscal_quarter").distinct()
    s = raw(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier_id"), "s_acctbal")
    j = pairs.join(s, "supplier_id").where((F.col("supplier_id") + F.col("n")) % 17 != 0)
    sid, n = F.col("supplier_id"), F.col("n")
    credit = F.greatest(F.lit(1.0), F.least(F.lit(100.0),
                        50 + F.col("s_acctbal") / 250 + (7 * sid + 3 * n) % 11 - 5))
    return j.select(
        "supplier_id", "fiscal_quarter",
        credit.alias("external_credit_score"),
        F.when(credit >= 75, "A").when(credit >= 50, "B").otherwise("C").alias("credit_rating"),
        (credit / 20 - 1).alias("altman_z_score"),
        (120 - credit).alias("days_sales_outstanding"),
        (2 - credit / 100).alias("debt_to_equity_ratio"),
        (0.8 + credit / 100).alias("current_ratio"),
        ((13 * sid + n) % 80).cast("double").alias("promoter_pledge_pct"),
        (((sid + n) % 21 - 10) / 10).cast("double").alias("news_sentiment_score"),
        ((sid + n) % 4).cast("int").alias("litigation_case_count"),
        ((sid + n) % 9 == 0).cast("int").alias("gst_filing_delay_flag"))


def x_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier incidents: all rows of ``events``; a user that is no supplier is an unknown supplier id. Quarter
    numbers 27-29 lie outside the order axis on purpose (unknown quarters)."""
    e = raw(spark, sf_dir, "events")
    eid, v = F.col("event_id"), F.col("value")
    resolved = eid % 3 != 0
    return e.select(
        "event_id",
        F.col("user_id").alias("supplier_id"),
        F.to_date("ts").alias("event_date"),
        cal.label_of_quarter_number(eid % 30).alias("fiscal_quarter"),
        "event_type",
        F.when(v >= 110, "Critical").when(v >= 70, "High").when(v >= 35, "Medium").otherwise("Low").alias("severity"),
        F.col("event_type").alias("reported_by"),
        resolved.cast("int").alias("resolved_flag"),
        F.when(resolved, (eid % 20).cast("double")).alias("resolution_days"))


def load_inputs(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> Inputs:
    """The eight inputs as plans over the raw tables and ``lines`` (``order_lines``, stored or not). Nothing is
    cached: filters and column selections reach the Parquet scans, and the marts that many queries share are
    stored once (``plans.stored``)."""
    lines = order_lines(spark, sf_dir) if lines is None else lines
    po = x_po(lines)
    return Inputs(
        supplier=x_supplier(spark, sf_dir),
        item=x_item(spark, sf_dir),
        contract=x_contract(spark, sf_dir),
        po=po,
        receipt=x_receipt(lines),
        invoice=x_invoice(lines),
        risk=x_risk(spark, sf_dir, po),
        event=x_event(spark, sf_dir),
        order_receipt=x_receipt(lines, ("fiscal_quarter", "po_value_inr", "order_priority")),
        order_invoice=x_invoice(lines, F.col("fiscal_quarter")),
    )


def file_inputs(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> Inputs:
    """The inputs as the declared file schemas have them, over ``lines`` (``order_lines``, stored or not), with whole-number ids: order key and supplier (or line) side
    by side in 64 bits, 31 of them for the second; larger keys raise an overflow error."""
    number = {"purchase_order_id": ("l_orderkey", "l_suppkey"), "goods_receipt_id": ("l_orderkey", "l_linenumber"),
              "invoice_id": ("l_orderkey", "l_linenumber")}
    ids = {c: F.col(a).cast("long") * F.lit(1 << 31) + F.col(b) for c, (a, b) in number.items()}
    lines = order_lines(spark, sf_dir) if lines is None else lines
    lines = lines.withColumns({f"n_{c}": e for c, e in ids.items()})
    po = x_po(lines, ("n_purchase_order_id",))
    po = po.withColumn("purchase_order_id", F.col("n_purchase_order_id"))
    receipt = x_receipt(lines, ("n_purchase_order_id", "n_goods_receipt_id"))
    receipt = receipt.withColumns({c: F.col(f"n_{c}") for c in ("purchase_order_id", "goods_receipt_id")})
    invoice = x_invoice(lines, order=("n_purchase_order_id", "n_invoice_id"))
    invoice = invoice.withColumns({c: F.col(f"n_{c}") for c in ("purchase_order_id", "invoice_id")})
    every = load_inputs(spark, sf_dir, lines)
    return Inputs(every.supplier, every.item, every.contract, po, receipt, invoice, every.risk, every.event)
