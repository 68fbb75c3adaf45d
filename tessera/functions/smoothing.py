"""Recursive indicators over one symbol's rows in time order: each value depends on the one before it.

Inputs and results are float64 arrays of one length; the warm-up is NaN. Wilder smoothing of period n starts from the
plain mean of the first n values. A stretch of NaN at the start of an input is skipped.
"""

from __future__ import annotations

import numpy as np

NAN = float("nan")


def _blank(x):
    return np.full(len(x), NAN)


def _start(*xs) -> int:
    """First place where all inputs have a value; their length if none."""
    fine = np.logical_and.reduce([~np.isnan(x) for x in xs])
    return int(np.argmax(fine)) if fine.any() else len(xs[0])


def _smooth(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    out, at = _blank(x), _start(x)
    if len(x) - at < n:
        return out
    value = x[at : at + n].mean()
    out[at + n - 1] = value
    for i in range(at + n, len(x)):
        value += alpha * (x[i] - value)
        out[i] = value
    return out


def ema(x, n):
    return _smooth(x, n, 2 / (n + 1))


def wilder(x, n):
    return _smooth(x, n, 1 / n)


def sma(x, n):
    out, at = _blank(x), _start(x)
    if len(x) - at >= n:
        sums = np.cumsum(np.r_[0.0, x[at:]])
        out[at + n - 1 :] = (sums[n:] - sums[:-n]) / n
    return out


def average(x, n, kind=0):
    """Moving average: 0 simple, 1 exponential."""
    return ema(x, n) if kind == 1 else sma(x, n)


def _ratio(a, b, scale=1.0):
    return np.divide(scale * a, b, out=np.where(np.isnan(a) | np.isnan(b), NAN, 0.0), where=(b != 0) & ~np.isnan(b))


def true_range(high, low, close):
    before = np.r_[NAN, close[:-1]]
    return np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))


def atr(high, low, close, n):
    return wilder(true_range(high, low, close), n)


def natr(high, low, close, n):
    return _ratio(atr(high, low, close, n), close, 100.0)


def _moves(x, n):
    change = np.r_[NAN, np.diff(x)]
    return wilder(np.maximum(change, 0), n), wilder(np.maximum(-change, 0), n)


def rsi(x, n):
    up, down = _moves(x, n)
    return _ratio(up, up + down, 100.0)


def cmo(x, n):
    up, down = _moves(x, n)
    return _ratio(up - down, up + down, 100.0)


def kama(x, n):
    out = _blank(x)
    if len(x) <= n:
        return out
    step, value = np.abs(np.diff(x)), x[n - 1]
    fast, slow = 2 / 3, 2 / 31
    for i in range(n, len(x)):
        noise = step[i - n : i].sum()
        efficiency = abs(x[i] - x[i - n]) / noise if noise else 1.0
        value += (efficiency * (fast - slow) + slow) ** 2 * (x[i] - value)
        out[i] = value
    return out


def trix(x, n):
    smooth = ema(ema(ema(x, n), n), n)
    before = np.r_[NAN, smooth[:-1]]
    return _ratio(smooth - before, before, 100.0)


def macd(x, fast, slow, signal):
    """MACD line, its signal line and their difference. The fast average starts where the slow one does."""
    if slow < fast:
        fast, slow = slow, fast
    late = np.r_[np.full(min(slow - fast, len(x)), NAN), x[slow - fast :]]
    line = ema(late, fast) - ema(x, slow)
    mark = ema(line, signal)
    line = np.where(np.isnan(mark), NAN, line)
    return line, mark, line - mark


def _directed(high, low):
    up, down = np.r_[NAN, np.diff(high)], np.r_[NAN, -np.diff(low)]
    plus = np.where(np.isnan(up), NAN, np.where((up > down) & (up > 0), up, 0.0))
    minus = np.where(np.isnan(up), NAN, np.where((down > up) & (down > 0), down, 0.0))
    return plus, minus


def _running(x, n, first):
    """Wilder's sum: of the first n - 1 values, then less its nth part plus the new value; given from ``first`` on."""
    out = _blank(x)
    if len(x) < n:
        return out
    value = x[1:n].sum()
    out[n - 1] = value
    for i in range(n, len(x)):
        value += x[i] - value / n
        out[i] = value
    out[:first] = NAN
    return out


def plus_dm(high, low, n):
    return _directed(high, low)[0] if n <= 1 else _running(_directed(high, low)[0], n, n - 1)


def minus_dm(high, low, n):
    return _directed(high, low)[1] if n <= 1 else _running(_directed(high, low)[1], n, n - 1)


def plus_di(high, low, close, n):
    return _ratio(_running(_directed(high, low)[0], n, n), _running(true_range(high, low, close), n, n), 100.0)


def minus_di(high, low, close, n):
    return _ratio(_running(_directed(high, low)[1], n, n), _running(true_range(high, low, close), n, n), 100.0)


def dx(high, low, close, n):
    plus, minus = plus_di(high, low, close, n), minus_di(high, low, close, n)
    return _ratio(np.abs(plus - minus), plus + minus, 100.0)


def adx(high, low, close, n):
    return wilder(dx(high, low, close, n), n)


def adxr(high, low, close, n):
    x = adx(high, low, close, n)
    return (x + np.r_[np.full(min(n - 1, len(x)), NAN), x[: max(0, len(x) - n + 1)]]) / 2


def ad(high, low, close, volume):
    return np.cumsum(_ratio((close - low) - (high - close), high - low) * volume)


def adosc(high, low, close, volume, fast, slow):
    line = ad(high, low, close, volume)
    out = _blank(line)
    if not len(line):
        return out
    a = b = line[0]
    for i in range(len(line)):
        a += 2 / (fast + 1) * (line[i] - a)
        b += 2 / (slow + 1) * (line[i] - b)
        if i >= max(fast, slow) - 1:
            out[i] = a - b
    return out


def keltner(high, low, close, n, dev):
    middle, width = sma(close, n), atr(high, low, close, n)
    return middle + dev * width, middle - dev * width


def stoch(high, low, close, fastk, slowk, slowk_kind, slowd, slowd_kind):
    """Slow %K and %D; both start where %D does."""
    raw = _blank(close)
    for i in range(fastk - 1, len(close)):
        top, bottom = high[i - fastk + 1 : i + 1].max(), low[i - fastk + 1 : i + 1].min()
        raw[i] = 100 * (close[i] - bottom) / (top - bottom) if top != bottom else 0.0
    k = average(raw, slowk, slowk_kind)
    d = average(k, slowd, slowd_kind)
    return np.where(np.isnan(d), NAN, k), d


def apo(x, fast, slow, kind=0):
    return average(x, min(fast, slow), kind) - average(x, max(fast, slow), kind)


def ppo(x, fast, slow, kind=0):
    base = average(x, max(fast, slow), kind)
    return _ratio(average(x, min(fast, slow), kind) - base, base, 100.0)


def sar(high, low, acceleration, maximum):
    """Parabolic stop: follows the trend faster with each new extreme and turns when it is crossed."""
    out = _blank(high)
    if len(high) < 2:
        return out
    plus, minus = _directed(high[:2], low[:2])
    rising = not minus[1] > 0
    extreme, stop = (high[1], low[0]) if rising else (low[1], high[0])
    speed = min(acceleration, maximum)
    before_high, before_low = high[1], low[1]
    for i in range(1, len(high)):
        last_high, last_low = before_high, before_low
        before_high, before_low = high[i], low[i]
        crossed = low[i] <= stop if rising else high[i] >= stop
        if crossed:
            rising = not rising
            stop = min(extreme, last_low, low[i]) if rising else max(extreme, last_high, high[i])
            out[i] = stop
            speed, extreme = min(acceleration, maximum), high[i] if rising else low[i]
        else:
            out[i] = stop
            if (high[i] > extreme) if rising else (low[i] < extreme):
                extreme = high[i] if rising else low[i]
                speed = min(speed + acceleration, maximum)
        stop += speed * (extreme - stop)
        stop = min(stop, last_low, low[i]) if rising else max(stop, last_high, high[i])
    return out
