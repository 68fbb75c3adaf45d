"""Technical indicators of a bar panel: bounded and cumulative ones as window columns, recursive ones by one pass a symbol.

``add(panel, {"fast": ("ema", 12), "bands": ("boll", 20, 2.0)})`` adds a column for each name, or, for an indicator with
several results, one for each of them: ``bands_up`` and ``bands_down``. By default an indicator sees a symbol's whole
history. With ``size`` it sees the last ``size`` bars only and is null before there are that many.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import rolling as R
from tessera.functions import smoothing as S
from tessera.functions.rolling import Clock


def _c(name: str) -> Column:
    return F.col(name).cast("double")


def _before(k: Clock, x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(k.order)


def _mean(k: Clock, x: Column, n: int) -> Column:
    return R.full(k, x, n, F.avg(x).over(k.last(n)))


def _over(a: Column, b: Column, scale: float = 1.0) -> Column:
    """``scale * a / b``; 0 where ``b`` is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a * scale / b)


def _wma(k, n):
    """Weights 1..n, the newest row weighing most."""
    return R.decay(k, _c("close"), n, newest_first=True)


def _cci(k, n):
    typical = (_c("high") + _c("low") + _c("close")) / 3
    seen, middle = R.values(k, typical, n), _mean(k, typical, n)
    away = F.aggregate(seen, F.lit(0.0), lambda s, v: s + F.abs(v - middle)) / n
    return _over(typical - middle, away * 0.015)


def _range(k):
    c1 = _before(k, _c("close"))
    return F.when(c1.isNotNull(), F.greatest(_c("high") - _c("low"), F.abs(_c("high") - c1), F.abs(_c("low") - c1)))


def _willr(k, n):
    top, bottom = R.full(k, _c("high"), n, R.highest(k, _c("high"), n)), R.lowest(k, _c("low"), n)
    return _over(top - _c("close"), top - bottom, -100.0)


def _ultosc(k, a, b, c):
    c1 = _before(k, _c("close"))
    pressure = F.when(c1.isNotNull(), _c("close") - F.least(_c("low"), c1))
    total = [_over(R.total(k, pressure, n), R.total(k, _range(k), n)) for n in sorted((a, b, c))]
    return (total[0] * 4 + total[1] * 2 + total[2]) * (100 / 7)


def _aroon(k, n):
    """Rows since the latest highest high and lowest low among n + 1 rows, as (up, down)."""
    def place(x, best):
        seen = F.reverse(R.values(k, x, n + 1))
        return R.full(k, x, n + 1, (n - (F.array_position(seen, best(seen)) - 1)) * (100.0 / n))
    return place(_c("high"), F.array_max), place(_c("low"), F.array_min)


def _mfi(k, n):
    typical = (_c("high") + _c("low") + _c("close")) / 3
    before = _before(k, typical)
    flow = typical * _c("volume")
    up = F.when(before.isNotNull(), F.when(typical > before, flow).otherwise(0.0))
    down = F.when(before.isNotNull(), F.when(typical < before, flow).otherwise(0.0))
    return _over(R.total(k, up, n), R.total(k, up, n) + R.total(k, down, n), 100.0)


def _obv(k):
    change = _c("close") - _before(k, _c("close"))
    step = F.when(change.isNull(), _c("volume")).otherwise(N.sign(change) * _c("volume"))
    return F.sum(step).over(k.so_far)


def _ad(k):
    return F.sum(_over((_c("close") - _c("low")) - (_c("high") - _c("close")), _c("high") - _c("low")) * _c("volume")).over(k.so_far)


def _bop(k):
    spread = _c("high") - _c("low")
    return F.when(spread <= 0, 0.0).otherwise((_c("close") - _c("open")) / spread)


def _boll(k, n, dev):
    middle = _mean(k, _c("close"), n)
    width = F.stddev_pop(_c("close")).over(k.last(n)) * float(dev)
    return middle + width, middle - width


def _ma_pair(k, fast, slow):
    fast, slow = sorted((fast, slow))
    return _mean(k, _c("close"), fast), _mean(k, _c("close"), slow)


def _apo(k, fast, slow):
    a, b = _ma_pair(k, fast, slow)
    return a - b


def _ppo(k, fast, slow):
    a, b = _ma_pair(k, fast, slow)
    return _over(a - b, b, 100.0)


#: name: (builder, names of the results).
WINDOWED = {
    "sma": (lambda k, n: _mean(k, _c("close"), n), None),
    "wma": (_wma, None),
    "apo_sma": (_apo, None),
    "ppo_sma": (_ppo, None),
    "mom": (lambda k, n: _c("close") - _before(k, _c("close"), n), None),
    "roc": (lambda k, n: _over(_c("close") - _before(k, _c("close"), n), _before(k, _c("close"), n), 100.0), None),
    "rocp": (lambda k, n: _over(_c("close") - _before(k, _c("close"), n), _before(k, _c("close"), n)), None),
    "rocr": (lambda k, n: _over(_c("close"), _before(k, _c("close"), n)), None),
    "rocr_100": (lambda k, n: _over(_c("close"), _before(k, _c("close"), n), 100.0), None),
    "std": (lambda k, n, dev=1.0: R.full(k, _c("close"), n, F.stddev_pop(_c("close")).over(k.last(n)) * float(dev)), None),
    "obv": (_obv, None),
    "cci": (_cci, None),
    "willr": (_willr, None),
    "ultosc": (_ultosc, None),
    "trange": (_range, None),
    "boll": (_boll, ("up", "down")),
    "donchian": (lambda k, n: (R.full(k, _c("high"), n, R.highest(k, _c("high"), n)), R.full(k, _c("low"), n, R.lowest(k, _c("low"), n))), ("up", "down")),
    "aroon": (_aroon, ("up", "down")),
    "aroonosc": (lambda k, n: _aroon(k, n)[0] - _aroon(k, n)[1], None),
    "mfi": (_mfi, None),
    "ad": (_ad, None),
    "bop": (_bop, None),
}

#: name: (function, input columns, names of the results).
RECURSIVE = {
    "ema": (S.ema, ("close",), None),
    "kama": (S.kama, ("close",), None),
    "cmo": (S.cmo, ("close",), None),
    "rsi": (S.rsi, ("close",), None),
    "trix": (S.trix, ("close",), None),
    "apo": (S.apo, ("close",), None),
    "ppo": (S.ppo, ("close",), None),
    "macd": (S.macd, ("close",), ("line", "signal", "hist")),
    "atr": (S.atr, ("high", "low", "close"), None),
    "natr": (S.natr, ("high", "low", "close"), None),
    "adx": (S.adx, ("high", "low", "close"), None),
    "adxr": (S.adxr, ("high", "low", "close"), None),
    "dx": (S.dx, ("high", "low", "close"), None),
    "plus_di": (S.plus_di, ("high", "low", "close"), None),
    "minus_di": (S.minus_di, ("high", "low", "close"), None),
    "plus_dm": (S.plus_dm, ("high", "low"), None),
    "minus_dm": (S.minus_dm, ("high", "low"), None),
    "keltner": (S.keltner, ("high", "low", "close"), ("up", "down")),
    "adosc": (S.adosc, ("high", "low", "close", "volume"), None),
    "stoch": (S.stoch, ("high", "low", "close"), ("k", "d")),
    "sar": (S.sar, ("high", "low"), None),
}


def add(panel: DataFrame, wanted: Mapping[str, tuple], clock: Clock = Clock(), size: int | None = None) -> DataFrame:
    """See the module. Null and NaN warm-up values are null in the result; rows may come in any order."""
    windowed = {k: v for k, v in wanted.items() if v[0] in WINDOWED and not (size and v[0] in ("obv", "ad"))}
    folded = {k: v for k, v in wanted.items() if k not in windowed}
    unknown = [v[0] for v in folded.values() if v[0] not in RECURSIVE and v[0] not in ("obv", "ad")]
    if unknown:
        raise ValueError(f"no indicator {unknown[0]!r}")
    df = panel
    if windowed:
        columns = {}
        for name, (kind, *params) in windowed.items():
            build, parts = WINDOWED[kind]
            made = build(clock, *params)
            columns |= {f"{name}_{p}": c for p, c in zip(parts, made, strict=True)} if parts else {name: made}
        df = df.withColumn(clock.position, clock.number())
        gate = (lambda c: F.when(F.col(clock.position) >= size, c)) if size else (lambda c: c)
        df = df.select("*", *(gate(c).alias(n) for n, c in columns.items())).drop(clock.position)
    return _fold(df, folded, clock, size) if folded else df


def _cumulative(kind):
    if kind == "ad":
        return S.ad, ("high", "low", "close", "volume"), None
    return (lambda c, v: np.cumsum(np.where(np.r_[True, np.zeros(len(c) - 1, bool)], v, np.sign(np.diff(c, prepend=c[:1])) * v))), ("close", "volume"), None


def _fold(df: DataFrame, folded: Mapping[str, tuple], clock: Clock, size: int | None) -> DataFrame:
    plan, added = [], []
    for name, (kind, *params) in folded.items():
        fn, inputs, parts = RECURSIVE.get(kind) or _cumulative(kind)
        names = [f"{name}_{p}" for p in parts] if parts else [name]
        plan.append((fn, inputs, params, names))
        added += names
    time = clock.time

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(time, kind="stable").reset_index(drop=True)
        for fn, inputs, params, names in plan:
            arrays = [rows[i].to_numpy("float64") for i in inputs]
            if size is None:
                made = fn(*arrays, *params)
                made = made if isinstance(made, tuple) else (made,)
            else:
                made = tuple(np.full(len(rows), np.nan) for _ in names)
                for end in range(size, len(rows) + 1):
                    one = fn(*(a[end - size : end] for a in arrays), *params)
                    for out, values in zip(made, one if isinstance(one, tuple) else (one,), strict=True):
                        out[end - 1] = values[-1]
            for n, values in zip(names, made, strict=True):
                rows[n] = values
        return rows

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", `{n}` double" for n in added)
    out = df.groupBy(clock.symbol).applyInPandas(run, schema)
    return out.select(*df.columns, *(F.when(~F.isnan(n), F.col(n)).alias(n) for n in added))
