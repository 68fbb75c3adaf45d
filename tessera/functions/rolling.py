"""Rolling operators over a symbol's rows in time order. Frames count rows, never time.

Each takes a ``Clock`` (the window of a symbol) and plain columns. Null means no value; NaN is a value. "Full" operators
are null unless the frame holds n values; the others accept what there is.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import numeric as N


@dataclass(frozen=True)
class Clock:
    symbol: str = "vt_symbol"
    time: str = "datetime"
    position: str = "_pos"

    @property
    def order(self) -> WindowSpec:
        return W.partitionBy(self.symbol).orderBy(self.time)

    def last(self, n: int, skip: int = 0) -> WindowSpec:
        """The n rows up to the current one, or up to ``skip`` rows before it."""
        return self.order.rowsBetween(-(n - 1) - skip, -skip)

    def over(self, aggregate: Column, n: int, skip: int = 0) -> Column:
        """The aggregate over the n rows up to the current one."""
        return aggregate.over(self.last(n, skip))

    def before(self, x: Column, n: int) -> Column:
        """The value n rows before; after it where n is negative."""
        return F.lag(x, n).over(self.order)

    @property
    def so_far(self) -> WindowSpec:
        return self.order.rowsBetween(W.unboundedPreceding, W.currentRow)

    def row(self) -> Column:
        """The row number as a column: ``position`` must have been added with ``number()``."""
        return F.col(self.position)

    def number(self) -> Column:
        return F.row_number().over(self.order).cast("double")


@dataclass(frozen=True)
class Shared(Clock):
    """A clock that computes equal aggregates once: they become named columns, ``definitions``, and are used by name."""

    definitions: dict[str, Column] = field(default_factory=dict, compare=False)
    names: dict[tuple, str] = field(default_factory=dict, compare=False)
    prefix: str = "_w"

    def _named(self, key: tuple, made: Column) -> Column:
        if key not in self.names:
            self.names[key] = name = f"{self.prefix}{len(self.names)}"
            self.definitions[name] = made
        return F.col(self.names[key])

    def over(self, aggregate: Column, n: int, skip: int = 0) -> Column:
        return self._named((str(aggregate), n, skip), aggregate.over(self.last(n, skip)))

    def before(self, x: Column, n: int) -> Column:
        return self._named(("before", str(x), n), F.lag(x, n).over(self.order))


def full(c: Clock, x: Column, n: int, out: Column) -> Column:
    return F.when(c.over(F.count(x), n) == n, out)


def delay(c: Clock, x: Column, n: int) -> Column:
    return c.before(x, int(n)) if n else x


def delta(c: Clock, x: Column, n: int) -> Column:
    return x - delay(c, x, n)


def lowest(c: Clock, x: Column, n: int) -> Column:
    return c.over(F.min(x), n)


def highest(c: Clock, x: Column, n: int) -> Column:
    return c.over(F.max(x), n)


def values(c: Clock, x: Column, n: int) -> Column:
    return c.over(F.collect_list(x), n)


def argmax(c: Clock, x: Column, n: int) -> Column:
    """1-based place of the first largest value, counted from the oldest row; full."""
    seen = values(c, x, n)
    return full(c, x, n, F.array_position(seen, F.array_max(seen)).cast("double"))


def argmin(c: Clock, x: Column, n: int) -> Column:
    seen = values(c, x, n)
    return full(c, x, n, F.array_position(seen, F.array_min(seen)).cast("double"))


def rank(c: Clock, x: Column, n: int) -> Column:
    """Mean of the strict and the weak percentile of the last value among the n, in (0, 1]; full."""
    seen = values(c, x, n)
    below, upto = F.size(F.filter(seen, lambda v: v < x)), F.size(F.filter(seen, lambda v: v <= x))
    return full(c, x, n, (below + upto + 1) / F.lit(2.0 * n))


def total(c: Clock, x: Column, n: int) -> Column:
    return full(c, x, n, c.over(F.sum(x), n))


def mean(c: Clock, x: Column, n: int) -> Column:
    """Mean without NaN; NaN if all values are NaN."""
    out = c.over(F.avg(N.present(x)), n)
    return F.when(out.isNull() & (c.over(F.count(x), n) > 0), N.nan()).otherwise(out)


def std(c: Clock, x: Column, n: int) -> Column:
    """Population standard deviation without NaN; NaN if all values are NaN."""
    out = c.over(F.stddev_pop(N.present(x)), n)
    return F.when(out.isNull() & (c.over(F.count(x), n) > 0), N.nan()).otherwise(out)


def _line(c: Clock, x: Column, n: int) -> tuple[Column, Column, Column]:
    """Sum of x, sum of (row number * x), and the row number of the frame's oldest row."""
    return c.over(F.sum(x), n), c.over(F.sum(c.row() * x), n), c.row() - (n - 1)


def slope(c: Clock, x: Column, n: int) -> Column:
    """Least-squares slope against 0..n-1; full."""
    s, weighted, first = _line(c, x, n)
    return full(c, x, n, N.div(weighted - first * s - s * ((n - 1) / 2), n * (n * n - 1) / 12))


def rsquare(c: Clock, x: Column, n: int) -> Column:
    """Share of the variance that the line explains; null where it is not defined; full."""
    b = slope(c, x, n)
    spread = c.over(F.var_pop(x), n)
    return full(c, x, n, N.finite(N.div(b * b * ((n * n - 1) / 12), spread)))


def resi(c: Clock, x: Column, n: int) -> Column:
    """The last value less the line's last value; full."""
    return full(c, x, n, x - (c.over(F.avg(x), n) + slope(c, x, n) * ((n - 1) / 2)))


def quantile(c: Clock, x: Column, n: int, q: float) -> Column:
    """Quantile by linear interpolation; full."""
    return full(c, x, n, c.over(F.percentile(x, F.lit(float(q))), n))


def corr(c: Clock, x: Column, y: Column, n: int) -> Column:
    """Pearson correlation of the rows that have both; NaN where a side is constant, null where infinite."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    # The covariance of x with itself adds up products of the deviations from the old and the new mean, as DuckDB's variance does
    # to the last bit; Spark's own variance does not, and alphas rank what agrees but for that bit.
    spread = lambda v: F.sqrt(c.over(F.covar_pop(v, v), n))
    out = N.div(c.over(F.covar_pop(x, y), n), spread(x) * spread(y))
    return F.when(F.abs(out) == F.lit(float("inf")), F.lit(None).cast("double")).otherwise(out)


def cov(c: Clock, x: Column, y: Column, n: int) -> Column:
    """Defined as correlation times both standard deviations."""
    return corr(c, x, y, n) * std(c, x, n) * std(c, y, n)


def decay(c: Clock, x: Column, n: int, newest_first: bool = False) -> Column:
    """Linearly weighted mean, the oldest row weighing n and the newest 1 (or the other way round); full.

    The terms are added from the newest on: sums by row numbers differ between rows of equal values, and ranks would tell these apart.
    """
    n, seen = int(n), values(c, x, n)
    terms = [F.get(seen, n - 1 - k) * float(n - k if newest_first else k + 1) for k in range(n)]
    return full(c, x, n, reduce(Column.__add__, terms) / (n * (n + 1) / 2))


def product(c: Clock, x: Column, n: int) -> Column:
    return full(c, x, n, c.over(F.product(x), n))
