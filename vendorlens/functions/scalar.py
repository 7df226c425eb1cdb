"""Row-level functions as built-in Column expressions (no Python UDF anywhere)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vendorlens import constants as K


def safe_div(num: Column, den: Column) -> Column:
    """Division that yields NULL for a zero or NULL denominator (ANSI mode would raise)."""
    return F.try_divide(num, den)


def risk_band(p: Column) -> Column:
    """Critical / High / Moderate / Low; a NULL probability falls through to Low, like a NaN
    comparison does in numpy."""
    expr = None
    for name, lower in K.RISK_BANDS:
        cond = p >= F.lit(lower)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(K.RISK_BAND_LOW))


def risk_band_order(band: Column) -> Column:
    expr = None
    for i, name in enumerate(K.RISK_BAND_ORDER):
        cond = band == F.lit(name)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def grade(score: Column) -> Column:
    """Right-closed bins of the composite score; outside every bin or NULL stays NULL."""
    expr = None
    for lo, hi, name in K.GRADE_BINS:
        cond = (score > F.lit(lo)) & (score <= F.lit(hi))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def abc_class(cum_pct: Column) -> Column:
    return (F.when(cum_pct <= F.lit(K.ABC_A_MAX), F.lit("A"))
            .when(cum_pct <= F.lit(K.ABC_B_MAX), F.lit("B"))
            .otherwise(F.lit("C")))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


#: From here on a double has no digit behind the point.
WHOLE = float(1 << 52)
SPLIT = float((1 << 27) + 1)


def _scaled(x: Column, digits: int) -> tuple[Column, Column]:
    """x · 10^digits as a double, and what rounding that product left out, exactly: the product is taken again of
    the two halves of x, whose parts have no more bits than a double holds."""
    factor = F.lit(float(10 ** digits))
    high = x * SPLIT - (x * SPLIT - x)
    product = x * factor
    return product, (high * factor - product) + (x - high) * factor


def half_even_units(x: Column, digits: int) -> Column:
    """The number of units of 10^-digits nearest to x. What is rounded is the exact value of the double, as in
    Python's formatting: 2.675 lies below the half step, 0.125 on it and goes to the even neighbour."""
    product, rest = _scaled(x, digits)
    low = F.floor(product).cast("double")
    part = product - low
    up = (part > 0.5) | ((part == 0.5) & ((rest > 0) | ((rest == 0) & (low % 2 != 0))))
    return F.when(F.abs(product) >= WHOLE, product).otherwise(low + up.cast("double"))


def round_half_even(x: Column, digits: int) -> Column:
    """``round(x, digits)`` of Python: the exact value, half to even."""
    x = x.cast("double")
    factor = F.lit(float(10 ** digits))
    return F.when(F.abs(x * factor) >= WHOLE, x).otherwise(half_even_units(x, digits) / factor)


def round_table(x: Column, digits: int) -> Column:
    """Rounding of a whole numeric column for display, as array libraries do it: the scaled double, half to even."""
    factor = F.lit(float(10 ** digits))
    return F.rint(x.cast("double") * factor) / factor


def fixed(x: Column, digits: int) -> Column:
    """``f'{x:,.{digits}f}'`` of Python for x >= 0. From 2^52 units on Java's digits are shown."""
    units = half_even_units(x, digits)
    whole = units.cast("long")
    text = F.format_number(F.floor(whole / F.lit(10 ** digits)) if digits else whole, 0)
    if digits:
        text = F.concat(text, F.lit("."), F.lpad((whole % F.lit(10 ** digits)).cast("string"), digits, "0"))
    return F.when(F.abs(x * float(10 ** digits)) >= WHOLE, F.format_string(f"%,.{digits}f", x)).otherwise(text)


def inr(v: Column, decimals: int = 1) -> Column:
    """Indian-convention money text: crore from 1e7, lakh from 1e5, thousands from 1e3; the scaled value is
    rounded half-even by its exact value (``fixed``)."""
    a = F.abs(v.cast("double"))
    sign = F.when(v.cast("double") < 0, F.lit("-")).otherwise(F.lit(""))
    body = (F.when(a >= 1e7, F.concat(F.lit("₹"), fixed(a / 1e7, decimals), F.lit(" cr")))
            .when(a >= 1e5, F.concat(F.lit("₹"), fixed(a / 1e5, decimals), F.lit(" L")))
            .when(a >= 1e3, F.concat(F.lit("₹"), fixed(a / 1e3, 0), F.lit("k")))
            .otherwise(F.concat(F.lit("₹"), fixed(a, 0))))
    return F.concat(sign, body)


def weighted_mean(rate: Column, weight: Column) -> Column:
    """Aggregate: Σ(rate·w)/Σw with NULLs read as 0 in both; NULL when Σw = 0."""
    r = F.coalesce(rate, F.lit(0.0))
    w = F.coalesce(weight, F.lit(0)).cast("double")
    return F.try_divide(F.sum(r * w), F.sum(w))
