"""Normalisation of feature columns. Null and NaN both count as missing here, and results have nulls only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import cross
from tessera.functions.numeric import present

#: Makes a median absolute deviation comparable with a standard deviation.
MAD_SCALE = 1.4826
CLIP = 3.0
RANK_SCALE = 3.46


def _clean(name: str) -> Column:
    return present(F.col(f"`{name}`").cast("double"))


def _clip(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(-CLIP)), F.lit(CLIP)))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def drop_na(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The rows where all named columns have a value."""
    fine = F.lit(True)
    for n in names:
        fine = fine & _clean(n).isNotNull()
    return df.where(fine)


def fill_na(df: DataFrame, value: float, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: F.coalesce(_clean(n), F.lit(float(value))) for n in names})


def cs_norm(df: DataFrame, names: Sequence[str], method: str = "robust", date: str = "datetime") -> DataFrame:
    """Per date: robust is ``clip((x - median) / MAD / 1.4826, 3)``; any other method is ``(x - mean) / sample deviation``.

    Null where the deviation is zero or not defined.
    """
    day = W.partitionBy(date)
    if method != "robust":
        return df.withColumns({n: _ratio(_clean(n) - F.avg(_clean(n)).over(day), F.stddev_samp(_clean(n)).over(day)) for n in names})
    away = df.withColumns({n: _clean(n) - F.percentile(_clean(n), F.lit(0.5)).over(day) for n in names})
    return away.withColumns({n: _clip(_ratio(F.col(n), F.percentile(F.abs(F.col(n)), F.lit(0.5)).over(day) * MAD_SCALE)) for n in names})


def robust_zscore_norm(df: DataFrame, names: Sequence[str], start, end, clip: bool = True, date: str = "datetime") -> DataFrame:
    """``(x - median) / ((MAD + 1e-12) * 1.4826)`` with median and MAD of all rows dated start..end; clipped at 3."""
    fit = df.where(F.col(date).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    middle = fit.agg(*(F.percentile(_clean(n), F.lit(0.5)).alias(f"_m{i}") for i, n in enumerate(names)))
    spread = fit.crossJoin(F.broadcast(middle)).agg(*(F.percentile(F.abs(_clean(n) - F.col(f"_m{i}")), F.lit(0.5)).alias(f"_s{i}") for i, n in enumerate(names)))
    both = df.crossJoin(F.broadcast(middle)).crossJoin(F.broadcast(spread))  # two one-row tables
    out = {n: (_clean(n) - F.col(f"_m{i}")) / ((F.col(f"_s{i}") + 1e-12) * MAD_SCALE) for i, n in enumerate(names)}
    return both.withColumns({n: _clip(c) if clip else c for n, c in out.items()}).select(*df.columns)


def cs_rank_norm(df: DataFrame, names: Sequence[str], date: str = "datetime") -> DataFrame:
    """``(average rank / rows of the date - 0.5) * 3.46``."""
    n_rows = F.count(F.lit(1)).over(W.partitionBy(date))
    return df.withColumns({n: (cross.rank(date, _clean(n)) / n_rows - 0.5) * RANK_SCALE for n in names})
