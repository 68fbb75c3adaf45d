"""Cross-sectional operators: over all symbols of one date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import numeric as N


def rank(date: str, x: Column, pct: bool = False) -> Column:
    """Average rank from 1, NaN largest; null of null. ``pct`` divides by the number of values."""
    here = W.partitionBy(date, x.isNull())
    ties = F.count(F.lit(1)).over(here.orderBy(x).rangeBetween(W.currentRow, W.currentRow))
    out = F.rank().over(here.orderBy(x)) + (ties - 1) / F.lit(2.0)
    return F.when(x.isNotNull(), out / F.count(x).over(here) if pct else out)


def mean(date: str, x: Column) -> Column:
    return F.avg(x).over(W.partitionBy(date))


def std(date: str, x: Column) -> Column:
    """Sample standard deviation; null of one value."""
    return F.stddev_samp(x).over(W.partitionBy(date))


def total(date: str, x: Column) -> Column:
    return F.coalesce(F.sum(x).over(W.partitionBy(date)), F.lit(0.0))


def scale(date: str, x: Column) -> Column:
    """``x`` over the sum of absolute values; 0 where that sum is 0; null of null."""
    s = F.sum(F.abs(x)).over(W.partitionBy(date))
    return F.when(s == 0, F.lit(0.0)).otherwise(N.div(x, s))


def demean(date: str, x: Column, *by: str) -> Column:
    """``x`` less the mean of its group on the date: industry neutralisation."""
    return x - F.avg(x).over(W.partitionBy(date, *by))
