"""Descriptive reports over the (filtered) marts: overview, delivery, invoice and SLA (A10–A29,
O3, O6, U2). Each is a group-by or a one-row aggregate; global figures are scalar subqueries."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlens import constants as K
from vendorlens.functions.scalar import weighted_mean, round_table
from vendorlens.operators.ordered import quantiles


def _weighted_or_zero(rate: str, weight: str = "lines"):
    return F.coalesce(weighted_mean(F.col(rate), F.col(weight)), F.lit(0.0))


def overview_kpis(spark: SparkSession, sup: DataFrame, sq: DataFrame, scored: DataFrame, prob: str) -> DataFrame:
    """Spend, orders, suppliers, line-weighted on-time and OTIF, SLA breaches, and the
    at-risk count and spend (p ≥ 0.45) in the latest scored quarter."""
    latest = scored.where(F.col(prob).isNotNull()).select(F.max("qi")).scalar()
    cur = scored.where((F.col("qi") == latest) & (F.col(prob) >= K.AT_RISK_THRESHOLD))
    return spark.range(1).select(
        sq.select(F.sum("spend_inr").cast("double")).scalar().alias("spend"),
        sq.select(F.sum("po_count")).scalar().alias("orders"),
        sup.select(F.count(F.lit(1))).scalar().alias("suppliers"),
        sq.select(_weighted_or_zero("on_time_rate")).scalar().alias("on_time"),
        sq.select(_weighted_or_zero("otif_rate")).scalar().alias("otif"),
        sup.select(F.count_if(F.col("sla_gap_pp") < 0)).scalar().alias("sla_breaches"),
        cur.select(F.count(F.lit(1))).scalar().alias("at_risk"),
        cur.select(F.coalesce(F.sum("total_spend_inr"), F.lit(0.0))).scalar().alias("spend_at_risk"))


def ontime_trend(sq: DataFrame) -> DataFrame:
    """Line-weighted on-time % per quarter (NULL when the quarter has no lines)."""
    return sq.groupBy("fiscal_quarter", "qi").agg(
        (weighted_mean(F.col("on_time_rate"), F.col("lines")) * 100).alias("on_time"),
        F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


def festive_effect(trend: DataFrame) -> DataFrame:
    """Mean on-time of the festive Q3 quarters against the others."""
    q3 = F.col("fiscal_quarter").endswith("Q3")
    return trend.agg(F.avg(F.when(q3, F.col("on_time"))).alias("q3_on_time"),
                     F.avg(F.when(~q3, F.col("on_time"))).alias("other_on_time"))


def category_performance(sq: DataFrame) -> DataFrame:
    """Spend (crore), weighted on-time %, distinct suppliers; rows with a NULL dropped;
    the median category on-time as a reference column."""
    cat = sq.groupBy("primary_category").agg(
        (F.sum("spend_inr").cast("double") / 1e7).alias("spend"),
        (weighted_mean(F.col("on_time_rate"), F.col("lines")) * 100).alias("on_time"),
        F.count_distinct("supplier_id").alias("suppliers")).dropna()
    return cat.withColumn("median_on_time", cat.select(F.median("on_time")).scalar())


def notable_categories(cat: DataFrame) -> DataFrame:
    """The three lowest on-time ∪ the two largest spend, de-duplicated by category."""
    low = cat.orderBy(F.col("on_time").asc(), F.col("primary_category").asc()).limit(3)
    big = cat.orderBy(F.col("spend").desc(), F.col("primary_category").asc()).limit(2)
    return low.unionByName(big).dropDuplicates(["primary_category"])


def delivery_kpis(sq: DataFrame) -> DataFrame:
    """Weighted on-time and in-full, the unweighted mean of quarterly average delays, stockouts."""
    return sq.agg(_weighted_or_zero("on_time_rate").alias("on_time"),
                  _weighted_or_zero("in_full_rate").alias("in_full"),
                  F.avg("avg_delay_days").alias("avg_delay_days"),
                  F.coalesce(F.sum("stockouts"), F.lit(0)).alias("stockouts"))


def ontime_heatmap(sq: DataFrame, axis: DataFrame) -> DataFrame:
    """Category × quarter mean on-time % (unweighted), quarters as columns in axis order.
    Only quarters that occur in ``sq`` become columns; their labels are bounded by the calendar."""
    cells = sq.groupBy("primary_category", "fiscal_quarter").agg((F.avg("on_time_rate") * 100).alias("v"))
    cells = cells.cache()  # one row per category and quarter
    present = [r[0] for r in axis.join(F.broadcast(cells.select("fiscal_quarter").distinct()), "fiscal_quarter", "left_semi")
               .orderBy("qi").select("fiscal_quarter").collect()]
    return cells.groupBy("primary_category").pivot("fiscal_quarter", present).agg(F.first("v"))


def worst_performers(sup: DataFrame, n: int = 12) -> DataFrame:
    """O3: the ``n`` lowest OTIF rates (ties in spend-rank order), in display units."""
    return (sup.where(F.col("otif_rate").isNotNull())
            .orderBy(F.col("otif_rate").asc(), F.col("spend_rank").asc()).limit(n)
            .select("supplier_id", "supplier_name", (F.col("otif_rate") * 100).alias("otif_pct"),
                    "avg_delay_days", (F.col("total_spend_inr").cast("double") / 1e7).alias("spend_cr")))


def displayed(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """``df`` with the columns that a table shows rounded, half to even."""
    return df.withColumns({c: round_table(F.col(c), n) for c, n in digits.items()})


def delay_quartiles_by_tier(sq: DataFrame) -> DataFrame:
    """Box statistics of quarterly average delay per tier (linear quantiles)."""
    d = F.col("avg_delay_days")
    rows = sq.where(F.col("supplier_tier").isin(K.TIERS))
    box = quantiles(rows, {"delay": d}, {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["supplier_tier"]).drop("metric")
    ends = rows.groupBy("supplier_tier").agg(F.count(d).alias("n"), F.min(d).alias("min"), F.max(d).alias("max"))
    return ends.join(F.broadcast(box), "supplier_tier", "left")  # one row per tier


def invoice_kpis(sup: DataFrame) -> DataFrame:
    """Unweighted supplier means and the total absolute billing variance."""
    return sup.agg(F.avg("invoice_accuracy").alias("invoice_accuracy"), F.avg("dispute_rate").alias("dispute_rate"),
                   F.avg("avg_days_to_payment").alias("days_to_payment"),
                   F.coalesce(F.sum("abs_variance_inr"), F.lit(0.0)).alias("abs_variance_inr"))


def invoice_error_totals(errors: DataFrame, ids: DataFrame) -> DataFrame:
    """Invoices per error type (clean invoices excluded) for the selected suppliers."""
    e = errors.join(ids, "supplier_id", "left_semi").where(F.col("invoice_error_type") != K.NO_ERROR_TYPE)
    return e.groupBy("invoice_error_type").agg(F.sum("size").alias("size"))


def otif_accuracy_corr(sup: DataFrame, strong: float = 0.6) -> DataFrame:
    """Pearson correlation (pairwise complete) and its reading."""
    r = F.corr("otif_rate", "invoice_accuracy")
    return sup.agg(r.alias("corr")).select(
        "corr", F.when(F.abs("corr") < strong, "related but distinct").otherwise("closely linked").alias("reading"))


def sla_kpis(sup: DataFrame) -> DataFrame:
    """Breaches, median and worst gap, spend held in breach."""
    gap = F.col("sla_gap_pp")
    median = quantiles(sup, {"gap": gap}, {"median": 0.5}).select("median").scalar()
    out = sup.agg(F.count_if(gap < 0).alias("breaches"), F.count(F.lit(1)).alias("suppliers"),
                  F.min(gap).alias("worst_gap"),
                  F.coalesce(F.sum(F.when(gap < 0, F.col("total_spend_inr"))), F.lit(0)).cast("double")
                  .alias("spend_in_breach"))
    return out.withColumn("median_gap", median)


def sla_status(sup: DataFrame) -> DataFrame:
    """Suppliers with a contract, meeting or in breach, and the padded common axis range."""
    d = sup.where(F.col("sla_target_pct").isNotNull())
    actual = F.col("on_time_rate") * 100
    lo = d.select(F.least(F.min("sla_target_pct"), F.min(actual)) - 3).scalar()
    hi = d.select(F.greatest(F.max("sla_target_pct"), F.max(actual)) + 3).scalar()
    return d.select("supplier_id", "supplier_name", "sla_target_pct", actual.alias("actual_on_time_pct"),
                    F.when(F.col("sla_gap_pp") >= 0, "Meeting SLA").otherwise("In breach").alias("status"),
                    lo.alias("axis_lo"), hi.alias("axis_hi"))


def top20_share(sup: DataFrame, k: int = 20) -> DataFrame:
    """Share of spend held by the top ``k`` suppliers of the selection, and class-A count."""
    total = sup.select(F.sum("total_spend_inr").cast("double")).scalar()
    top = sup.orderBy(F.col("total_spend_inr").desc(), F.col("supplier_id").asc()).limit(k)
    return top.agg((F.sum(F.col("total_spend_inr").cast("double")) / total * 100).alias("top_share_pct")).select(
        "top_share_pct", F.lit(k).alias("k"),
        sup.select(F.count_if(F.col("abc_class") == "A")).scalar().alias("class_a"))
