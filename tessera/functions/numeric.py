"""Row-local arithmetic with IEEE results: infinities and NaN where ANSI SQL would raise an error."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def nan() -> Column:
    return F.lit(float("nan"))


def div(a, b) -> Column:
    """``a / b`` as IEEE has it: a/0 is an infinity by the sign of ``a``, 0/0 and NaN/0 are NaN; null if either is null."""
    a, b = lit(a), lit(b)
    zero = F.when(a.isNull(), F.lit(None).cast("double")).when(F.isnan(a) | (a == 0), nan()).when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(b != 0, a / b).when(b == 0, zero)


def ln(x) -> Column:
    """Natural logarithm: -inf at zero, NaN below, NaN of NaN, null of null."""
    x = lit(x)
    return F.when(F.isnan(x), nan()).when(x > 0, F.log(x)).when(x == 0, F.lit(-math.inf)).when(x < 0, nan())


def sign(x) -> Column:
    """1, -1 or 0; 0 for null too."""
    x = lit(x)
    return F.when(x > 0, F.lit(1.0)).when(x < 0, F.lit(-1.0)).otherwise(F.lit(0.0))


def absolute(x) -> Column:
    return F.abs(lit(x))


def where(condition, a, b) -> Column:
    """``a`` where the condition is non-zero, ``b`` where it is zero or null."""
    return F.when(condition != 0, lit(a)).otherwise(lit(b))


def quesval(threshold, x, a, b) -> Column:
    """``a`` where ``threshold < x``, else ``b``; for a constant threshold."""
    return F.when(lit(threshold) < lit(x), lit(a)).otherwise(lit(b))


def quesval2(threshold, x, a, b) -> Column:
    """``a`` where ``x < threshold``, else ``b``; for a threshold that is a feature. The shipped formulas rely on this order."""
    return F.when(lit(x) < lit(threshold), lit(a)).otherwise(lit(b))


def _power(x: Column, e) -> Column:
    return F.pow(x, lit(e))


def pow1(x, e) -> Column:
    """Signed power by a constant: 0 for zero and null."""
    x = lit(x)
    return F.when(x > 0, _power(x, e)).when(x < 0, -_power(-x, e)).otherwise(F.lit(0.0))


def pow2(x, e) -> Column:
    """Signed power by a feature: negative bases only with whole exponents; all else, NaN and null are 0."""
    x, e = lit(x), lit(e)
    out = F.when(x > 0, _power(x, e)).when((x < 0) & (e == F.floor(e)), -_power(-x, e)).otherwise(F.lit(0.0))
    return F.when(F.isnan(out) | out.isNull(), F.lit(0.0)).otherwise(out)


def less(a, b) -> Column:
    return F.least(lit(a), lit(b))


def greater(a, b) -> Column:
    return F.greatest(lit(a), lit(b))


def mix(a, b, weight) -> Column:
    """``a * weight + b * (1 - weight)``."""
    return lit(a) * lit(weight) + lit(b) * (lit(1) - lit(weight))


def finite(x: Column) -> Column:
    """``x``, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(math.inf)), x)


def present(x: Column) -> Column:
    """``x``, or null where it is NaN."""
    return F.when(~F.isnan(x), x)


# Prices on a tick grid.


def _ticks(value, tick) -> Column:
    return lit(value).cast("decimal(38,12)") / F.lit(str(tick)).cast("decimal(20,10)")


def round_to(value, tick: float) -> Column:
    """To the nearest multiple of ``tick``, halves to even."""
    return (F.bround(_ticks(value, tick), 0).cast("double") * float(tick)).cast("decimal(38,10)").cast("double")


def floor_to(value, tick: float) -> Column:
    return (F.floor(_ticks(value, tick)).cast("double") * float(tick)).cast("decimal(38,10)").cast("double")


def ceil_to(value, tick: float) -> Column:
    return (F.ceil(_ticks(value, tick)).cast("double") * float(tick)).cast("decimal(38,10)").cast("double")


def digits(value: str | Column) -> Column:
    """Decimal places of a number's plain text form."""
    text = value if isinstance(value, Column) else F.lit(value)
    return F.length(F.regexp_extract(text.cast("string"), r"\.(\d+)$", 1))


def safe_div(a, b, default: float = 0.0) -> Column:
    """``a / b``, or the default where the divisor is nearly zero or either is missing."""
    a, b = finite(lit(a)), finite(lit(b))
    return F.coalesce(F.when(F.abs(b) >= 1e-12, a / b), F.lit(default))


def clip(x, low: float, high: float) -> Column:
    return F.least(F.greatest(lit(x), lit(low)), lit(high))
