"""Statistics of array columns. Missing and infinite items are left out first; where nothing can be said the result is ``default``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def valid(x: Column) -> Column:
    """Whether a number is there and finite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def clean(xs: Column) -> Column:
    return F.filter(xs.cast("array<double>"), valid)


def clean_pairs(xs: Column, ys: Column) -> Column:
    """Pairs ``(x, y)`` where both are valid, as far as the shorter array goes."""
    pairs = F.zip_with(xs.cast("array<double>"), ys.cast("array<double>"), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.filter(pairs, lambda p: valid(p["x"]) & valid(p["y"]))


def tail(xs: Column, n: int) -> Column:
    return F.when(F.size(xs) > n, F.slice(xs, -n, n)).otherwise(xs)


def _sum(xs: Column, of=lambda v: v) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, v: s + of(v))


def _or(value: Column, default: float) -> Column:
    return F.coalesce(value, F.lit(float(default)))


def _mean(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, _sum(xs) / F.size(xs))


def mean(xs: Column, default: float = 0.0) -> Column:
    return _or(_mean(clean(xs)), default)


def _variance(xs: Column, ddof: int) -> Column:
    middle = _mean(xs)
    return F.when(F.size(xs) > ddof, _sum(xs, lambda v: (v - middle) * (v - middle)) / (F.size(xs) - ddof))


def variance(xs: Column, ddof: int = 0, default: float = 0.0) -> Column:
    return _or(_variance(clean(xs), ddof), default)


def std(xs: Column, ddof: int = 0, default: float = 0.0) -> Column:
    return _or(F.sqrt(_variance(clean(xs), ddof)), default)


def _moments(pairs: Column) -> tuple[Column, Column, Column]:
    n = F.size(pairs)
    x, y = _sum(pairs, lambda p: p["x"]) / n, _sum(pairs, lambda p: p["y"]) / n
    return (
        _sum(pairs, lambda p: (p["x"] - x) * (p["y"] - y)) / n,
        _sum(pairs, lambda p: (p["x"] - x) * (p["x"] - x)) / n,
        _sum(pairs, lambda p: (p["y"] - y) * (p["y"] - y)) / n,
    )


def covariance(xs: Column, ys: Column, default: float = 0.0) -> Column:
    pairs = clean_pairs(xs, ys)
    return _or(F.when(F.size(pairs) > 0, _moments(pairs)[0]), default)


def correlation(xs: Column, ys: Column, default: float = 0.0) -> Column:
    pairs = clean_pairs(xs, ys)
    both, x, y = _moments(pairs)
    return _or(F.when((F.size(pairs) > 1) & (F.sqrt(x * y) > EPS), both / F.sqrt(x * y)), default)


def linear_slope(xs: Column, default: float = 0.0) -> Column:
    """Least-squares slope against the position."""
    c = clean(xs)
    n = F.size(c)
    at = F.transform(c, lambda v, i: F.struct(i.cast("double").alias("x"), v.alias("y")))
    both, x, _ = _moments(at)
    return _or(F.when(n > 1, both / x), default)


def z_score(value: Column, xs: Column, default: float = 0.0) -> Column:
    c = clean(xs)
    dev = F.sqrt(_variance(c, 0))
    return _or(F.when(valid(value) & (dev > EPS), (value - _mean(c)) / dev), default)


def latest_z_score(xs: Column, default: float = 0.0) -> Column:
    c = clean(xs)
    return z_score(F.get(c, F.size(c) - 1), c, default)


def _quantile(c: Column, q: float) -> Column:
    """By linear interpolation, of a clean array."""
    ordered, place = F.array_sort(c), (F.size(c) - 1) * float(q)
    low = F.floor(place).cast("int")
    below, above = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(c) - 1))
    return below + (above - below) * (place - low)


def percentile(xs: Column, q: float, default: float = 0.0) -> Column:
    return _or(_quantile(clean(xs), q), default)


def rank_pct(value: Column, xs: Column, default: float = 0.0) -> Column:
    """Share of the items that are not above ``value``."""
    c = clean(xs)
    return _or(F.when(valid(value) & (F.size(c) > 0), F.size(F.filter(c, lambda v: v <= value)) / F.size(c)), default)


def winsorize(xs: Column, low: float = 0.05, high: float = 0.95) -> Column:
    c = clean(xs)
    bottom, top = _quantile(c, low), _quantile(c, high)
    return F.transform(c, lambda v: F.least(F.greatest(v, bottom), top))


def min_max_scale(xs: Column, default: float = 0.0) -> Column:
    c = clean(xs)
    low, high = F.array_min(c), F.array_max(c)
    return F.transform(c, lambda v: F.when(high - low > EPS, (v - low) / (high - low)).otherwise(F.lit(float(default))))


def pct_change(now: Column, before: Column, default: float = 0.0) -> Column:
    return _or(F.when(valid(now) & valid(before) & (F.abs(before) > EPS), now / before - 1), default)


def log_return(now: Column, before: Column, default: float = 0.0) -> Column:
    return _or(F.when(valid(now) & valid(before) & (now > 0) & (before > 0), F.log(now / before)), default)


def _steps(xs: Column, of) -> Column:
    c = clean(xs)
    return F.when(F.size(c) > 1, F.zip_with(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(1))), F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(1))), lambda now, before: of(now, before))).otherwise(F.array().cast("array<double>"))


def pct_returns(xs: Column) -> Column:
    return _steps(xs, pct_change)


def log_returns(xs: Column) -> Column:
    return _steps(xs, log_return)


def momentum(xs: Column, n: int, default: float = 0.0) -> Column:
    """The change over the last n steps; the default where there are fewer."""
    c = clean(xs)
    return F.when(F.size(c) > n, pct_change(F.get(c, F.size(c) - 1), F.get(c, F.size(c) - 1 - n), default)).otherwise(F.lit(float(default)))


def volatility(xs: Column, ddof: int = 0, default: float = 0.0) -> Column:
    """Deviation of the returns between items."""
    return std(pct_returns(xs), ddof, default)
