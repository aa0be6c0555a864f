"""Exact, engine-independent rounding.

Averages and percentages are reported at a few decimals. Summing doubles is
order-dependent and formatting a raw double differs between engines, so every
reported ratio is computed from integer numerators and denominators and rounded
half-up (away from zero) in integer arithmetic; only the last step divides by a
power of ten, which is correctly rounded everywhere.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Places kept of a value before it is summed: below those of any money or age column.
EXACT_SCALE = 12
EXACT = f"decimal(28,{EXACT_SCALE})"


def to_units(x: Column | str, decimals: int) -> Column:
    """A value with ``decimals`` fractional digits as an exact integer count of units
    (a long: sums stay primitive and codegen'd; ANSI mode raises on overflow rather
    than wrapping, and a long holds 9.2e18 cents)."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x * F.lit(10 ** decimals)).cast("long")


def exact(x: Column | str) -> Column:
    """A numeric column as a decimal of ``EXACT_SCALE`` places, so that a sum does not depend on
    its order and only the reported figure is rounded. NaN counts as missing."""
    x = F.col(x) if isinstance(x, str) else x
    return F.nullif(x.cast("double"), F.lit(float("nan"))).cast(EXACT)


def exact_column(df: DataFrame, name: str) -> Column:
    """``exact`` of a column by its type: only floating columns go through NaN's test."""
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return exact(name) if floating else F.col(name).cast(EXACT)


def rounded_mean(total: Column, count: Column, decimals: int) -> Column:
    """An exact decimal sum / ``count`` rounded half-up at ``decimals`` places, as a double; null
    where nothing was counted."""
    num = F.abs(total.cast(f"decimal(32,{EXACT_SCALE})")) * F.lit(Decimal(2 * 10 ** decimals))
    den = count.cast("decimal(19,0)")
    q = F.signum(total).cast("long") * idiv(num + den, den * F.lit(Decimal(2)))
    return F.when(count > 0, q.cast("double") / F.lit(float(10 ** decimals)))


def rounded_units(total: Column, decimals: int) -> Column:
    """An exact decimal sum as a whole number of 10**-decimals units, rounded half-up once."""
    return F.round(total.cast(f"decimal(34,{EXACT_SCALE})") * F.lit(Decimal(10 ** decimals)), 0).cast("long")


def idiv(a: Column, b: Column) -> Column:
    """Spark's integral division ``a div b`` (truncates; operands here are >= 0)."""
    return F.call_function("div", a, b)


def half_up(num: Column, den: Column) -> Column:
    """round(num / den) half away from zero, for den > 0, as a long."""
    num = num.cast("decimal(38,0)")
    den = den.cast("decimal(38,0)")
    a = (F.abs(num) * 2 + den).cast("decimal(38,0)")
    b = (den * 2).cast("decimal(38,0)")
    return F.signum(num).cast("long") * idiv(a, b)


def rounded_ratio(num: Column, den: Column, decimals: int, num_decimals: int = 0) -> Column:
    """num / den rounded half-up at ``decimals`` places, as a double.

    ``num`` is an exact integer count of 10**-num_decimals units; ``den`` a
    positive integer count. Null when den is 0 or null (no ANSI divide error).
    """
    shift = decimals - num_decimals
    if shift < 0:
        raise ValueError("decimals must be >= num_decimals")
    scaled = num.cast("decimal(38,0)") * F.lit(10 ** shift)
    q = half_up(scaled, den)
    return F.when(den > 0, q.cast("double") / F.lit(float(10 ** decimals)))


def whole_units(x: Column | str, src_decimals: int) -> Column:
    """A value holding ``src_decimals`` exact decimals rounded half-up to a whole
    number (as a double), e.g. dollars-and-cents to whole dollars."""
    return half_up(to_units(x, src_decimals), F.lit(10 ** src_decimals)).cast("double")
