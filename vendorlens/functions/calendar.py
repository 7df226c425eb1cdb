"""Fiscal calendar (April–March years) as Column expressions, and the quarter axis table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# FIXED VALUES — quarter numbering of the test-table mapping: the quarter holding 1994-10-01
# (label FY94-95-Q4) is number 0, i.e. number = 4 * fiscal_year + fiscal_quarter - 7980.
QUARTER_NUMBER_ORIGIN = 7980


def _shifted(ts: Column) -> Column:
    # A fiscal year starts in April: moving the date back three months turns it into a calendar one.
    return F.add_months(F.to_date(ts), -3)


def fiscal_year(ts: Column) -> Column:
    return F.year(_shifted(ts))


def fiscal_quarter_of_year(ts: Column) -> Column:
    return F.quarter(_shifted(ts))


def quarter_label(fy: Column, fq: Column) -> Column:
    """'FY23-24-Q1' style label from a fiscal year and quarter."""
    return F.format_string("FY%02d-%02d-Q%d", fy % 100, (fy + 1) % 100, fq)


def fiscal_quarter_label(ts: Column) -> Column:
    return quarter_label(fiscal_year(ts), fiscal_quarter_of_year(ts))


def quarter_number(ts: Column) -> Column:
    return fiscal_year(ts) * 4 + fiscal_quarter_of_year(ts) - F.lit(QUARTER_NUMBER_ORIGIN)


def label_of_quarter_number(n: Column) -> Column:
    """Inverse of :func:`quarter_number` for a label."""
    absolute = n + F.lit(QUARTER_NUMBER_ORIGIN)
    fy = F.floor((absolute - 1) / 4).cast("int")
    fq = (absolute - fy * 4).cast("int")
    return quarter_label(fy, fq)


def dim_quarter(po: DataFrame) -> DataFrame:
    """The ordered quarter axis: every fiscal quarter carrying a purchase order, with a dense
    0-based index ``qi``. The distinct set is bounded by the calendar span (tens of rows), so the
    un-partitioned window runs on a tiny input and the result is safe to broadcast."""
    quarters = (po.where(F.col("fiscal_quarter").isNotNull())
                .groupBy("fiscal_quarter")
                .agg(F.min("fiscal_year").alias("fy"), F.min("fiscal_qtr").alias("fq")))
    w = Window.orderBy("fy", "fq", "fiscal_quarter")
    return quarters.select("fiscal_quarter", (F.row_number().over(w) - 1).cast("int").alias("qi"))
