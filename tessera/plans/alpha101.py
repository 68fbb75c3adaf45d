"""The published collection of 101 formulaic alphas, in the formula language of this package.

Notation: ``adv<n>`` is the mean volume of n rows, ``returns`` the one-row return, ``mid`` the mean of high and low,
``mix(a, b, w)`` is ``a*w + b*(1-w)``, ``rank`` is the average cross-sectional rank from 1, and ``ts_decay_linear`` weighs the
oldest row most. The neutralised alphas are given without neutralisation; ``neutral`` applies one to them. Number 56 needs the
market value and is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from tessera.functions import cross

# The formulas.
FORMULAS = {
    1: "rank(argmax(pow1(where(0 < returns, close, std(returns, 20)), 2), 5)) - 0.5",
    2: "-corr(rank(delta(log(volume), 2)), rank((close - open) / open), 6)",
    3: "-corr(rank(open), rank(volume), 10)",
    4: "-ts_rank(rank(low), 9)",
    5: "rank(open - sum(vwap, 10) / 10) * -abs(rank(close - vwap))",
    6: "-corr(open, volume, 10)",
    7: "where(volume < adv20, -ts_rank(abs(delta(close, 7)), 60) * sign(delta(close, 7)), -1)",
    8: "-rank(delta(sum(open, 5) * sum(returns, 5), 10))",
    9: "where(0 < min(delta(close, 1), 5), delta(close, 1), where(0 < max(delta(close, 1), 5), -delta(close, 1), delta(close, 1)))",
    10: "rank(where(0 < min(delta(close, 1), 4), delta(close, 1), where(0 < max(delta(close, 1), 4), -delta(close, 1), delta(close, 1))))",
    11: "(rank(max(vwap - close, 3)) + rank(min(vwap - close, 3))) * rank(delta(volume, 3))",
    12: "sign(delta(volume, 1)) * -delta(close, 1)",
    13: "-rank(cov(rank(close), rank(volume), 5))",
    14: "-rank(delta(returns, 3)) * corr(open, volume, 10)",
    15: "-sum(rank(corr(rank(high), rank(volume), 3)), 3)",
    16: "-rank(cov(rank(high), rank(volume), 5))",
    17: "-rank(ts_rank(close, 10)) * rank(close - 2 * delay(close, 1) + delay(close, 2)) * rank(ts_rank(volume / adv20, 5))",
    18: "-rank(std(abs(close - open), 5) + (close - open) + corr(close, open, 10))",
    19: "-sign(delta(close, 7) + delta(close, 7)) * (rank(sum(returns, 250) + 1) + 1)",
    20: "-rank(open - delay(high, 1)) * rank(open - delay(close, 1)) * rank(open - delay(low, 1))",
    21: "where(mean(close, 2) < mean(close, 8) + std(close, 8), -1, where(mean(close, 8) - std(close, 8) < mean(close, 2), 1, where(1 < volume / adv20, 1, -1)))",
    22: "-delta(corr(high, volume, 5), 5) * rank(std(close, 20))",
    23: "where(high < mean(high, 20), -delta(high, 2), 0)",
    24: "where(0.05 < delta(sum(close, 100) / 100, 100) / delay(close, 100), -delta(close, 3), -(close - min(close, 100)))",
    25: "rank(-returns * adv20 * vwap * (high - close))",
    26: "-max(corr(ts_rank(volume, 5), ts_rank(high, 5), 5), 3)",
    27: "where(0.5 < rank(mean(corr(rank(volume), rank(vwap), 6), 2)), -1, 1)",
    28: "scale(corr(adv20, low, 5) + mid - close)",
    29: "min(product(rank(rank(scale(log(sum(min(rank(rank(-rank(delta(close - 1, 5)))), 2), 1))))), 1), 5) + ts_rank(delay(-returns, 6), 5)",
    30: "(1 - rank(sign(delta(close, 1)) + sign(delay(close, 1) - delay(close, 2)) + sign(delay(close, 2) - delay(close, 3)))) * sum(volume, 5) / sum(volume, 20)",
    31: "rank(rank(rank(ts_decay_linear(-rank(rank(delta(close, 10))), 10)))) + rank(-delta(close, 3)) + sign(scale(corr(adv20, low, 12)))",
    32: "scale(sum(close, 7) / 7 - close) + 20 * scale(corr(vwap, delay(close, 5), 230))",
    33: "rank(-(1 - open / close))",
    34: "rank(1 - rank(std(returns, 2) / std(returns, 5)) + (1 - rank(delta(close, 1))))",
    35: "ts_rank(volume, 32) * (1 - ts_rank(close + high - low, 16)) * (1 - ts_rank(returns, 32))",
    36: "2.21 * rank(corr(close - open, delay(volume, 1), 15)) + 0.7 * rank(open - close) + 0.73 * rank(ts_rank(delay(-returns, 6), 5)) + rank(abs(corr(vwap, adv20, 6))) + 0.6 * rank((sum(close, 200) / 200 - open) * (close - open))",
    37: "rank(corr(delay(open - close, 1), close, 200)) + rank(open - close)",
    38: "-rank(ts_rank(close, 10)) * rank(close / open)",
    39: "-rank(delta(close, 7) * (1 - rank(ts_decay_linear(volume / adv20, 9)))) * (rank(sum(returns, 250)) + 1)",
    40: "-rank(std(high, 10)) * corr(high, volume, 10)",
    41: "pow1(high * low, 0.5) - vwap",
    42: "rank(vwap - close) / rank(vwap + close)",
    43: "ts_rank(volume / adv20, 20) * ts_rank(-delta(close, 7), 8)",
    44: "-corr(high, rank(volume), 5)",
    45: "-rank(sum(delay(close, 5), 20) / 20) * corr(close, volume, 2) * rank(corr(sum(close, 5), sum(close, 20), 2))",
    46: "where(0.25 < (delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10, -1, where(0 < (delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10, -delta(close, 1), 1))",
    47: "rank(pow1(close, -1)) * volume / adv20 * (high * rank(high - close)) / (sum(high, 5) / 5) - rank(delta(vwap, 5))",
    48: "corr(delta(close, 1), delta(delay(close, 1), 1), 250) * delta(close, 1) / close / sum(pow1(delta(close, 1) / delay(close, 1), 2), 250)",
    49: "where(-0.1 < (delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10, -delta(close, 1), 1)",
    50: "-max(rank(corr(rank(volume), rank(vwap), 5)), 5)",
    51: "where(-0.05 < (delay(close, 20) - delay(close, 10)) / 10 - (delay(close, 10) - close) / 10, -delta(close, 1), 1)",
    52: "(delay(min(low, 5), 5) - min(low, 5)) * rank((sum(returns, 240) - sum(returns, 20)) / 220) * ts_rank(volume, 5)",
    53: "-delta(((close - low) - (high - close)) / (close - low), 9)",
    54: "-((low - close) * pow1(open, 5)) / ((low - high) * pow1(close, 5))",
    55: "-corr(rank((close - min(low, 12)) / (max(high, 12) - min(low, 12))), rank(volume), 6)",
    57: "-((close - vwap) / ts_decay_linear(rank(argmax(close, 30)), 2))",
    58: "-ts_rank(ts_decay_linear(corr(vwap, volume, 4), 8), 6)",
    59: "-ts_rank(ts_decay_linear(corr(mix(vwap, vwap, 0.728317), volume, 4), 16), 8)",
    60: "-(2 * scale(rank(((close - low) - (high - close)) / (high - low) * volume)) - scale(rank(argmax(close, 10))))",
    61: "where(rank(corr(vwap, adv180, 18)) < rank(vwap - min(vwap, 16)), 1, 0)",
    62: "-(rank(corr(vwap, sum(adv20, 22), 10)) < rank((rank(open) + rank(open)) < (rank(mid) + rank(high))))",
    63: "-(rank(ts_decay_linear(delta(close, 2), 8)) - rank(ts_decay_linear(corr(mix(vwap, open, 0.318108), sum(adv180, 37), 14), 12)))",
    64: "-(rank(corr(sum(mix(open, low, 0.178404), 13), sum(adv120, 13), 17)) < rank(delta(mix(mid, vwap, 0.178404), 4)))",
    65: "-(rank(corr(mix(open, vwap, 0.00817205), sum(adv60, 9), 6)) < rank(open - min(open, 14)))",
    66: "-(rank(ts_decay_linear(delta(vwap, 4), 7)) + ts_rank(ts_decay_linear((mix(low, low, 0.96633) - vwap) / (open - mid), 11), 7))",
    67: "-pow2(rank(high - min(high, 2)), rank(corr(vwap, adv20, 6)))",
    68: "-(ts_rank(corr(rank(high), rank(adv15), 9), 14) < rank(delta(mix(close, low, 0.518371), 1)))",
    69: "-pow2(rank(max(delta(vwap, 3), 5)), ts_rank(corr(mix(close, vwap, 0.490655), adv20, 5), 9))",
    70: "-pow2(rank(delta(vwap, 1)), ts_rank(corr(close, adv50, 18), 18))",
    71: "greater(ts_rank(ts_decay_linear(corr(ts_rank(close, 3), ts_rank(adv180, 12), 18), 4), 16), ts_rank(ts_decay_linear(pow1(rank(low + open - (vwap + vwap)), 2), 16), 4))",
    72: "rank(ts_decay_linear(corr(mid, adv40, 9), 10)) / rank(ts_decay_linear(corr(ts_rank(vwap, 4), ts_rank(volume, 19), 7), 3))",
    73: "-greater(rank(ts_decay_linear(delta(vwap, 5), 3)), ts_rank(ts_decay_linear(-delta(mix(open, low, 0.147155), 2) / mix(open, low, 0.147155), 3), 17))",
    74: "-where(rank(corr(rank(mix(high, vwap, 0.0261661)), rank(volume), 11)) < rank(corr(close, sum(adv30, 37), 15)), 1, 0)",
    75: "where(rank(corr(rank(low), rank(adv50), 12)) < rank(corr(vwap, volume, 4)), 1, 0)",
    76: "-greater(rank(ts_decay_linear(delta(vwap, 1), 12)), ts_rank(ts_decay_linear(ts_rank(corr(low, adv81, 8), 20), 17), 19))",
    77: "less(rank(ts_decay_linear(mid + high - (vwap + high), 20)), rank(ts_decay_linear(corr(mid, adv40, 3), 6)))",
    78: "pow2(rank(corr(sum(mix(low, vwap, 0.352233), 20), sum(adv40, 20), 7)), rank(corr(rank(vwap), rank(volume), 6)))",
    79: "where(rank(corr(ts_rank(vwap, 4), ts_rank(adv150, 9), 15)) < rank(delta(mix(close, open, 0.60733), 1)), 1, 0)",
    80: "-pow2(rank(sign(delta(mix(open, high, 0.868128), 4))), ts_rank(corr(high, adv10, 5), 6))",
    81: "-where(rank(corr(rank(vwap), rank(volume), 5)) < rank(log(product(rank(pow1(rank(corr(vwap, sum(adv10, 50), 8)), 4)), 15))), 1, 0)",
    82: "-less(rank(ts_decay_linear(delta(open, 1), 15)), ts_rank(ts_decay_linear(corr(volume, open, 17), 7), 13))",
    83: "rank(delay((high - low) / (sum(close, 5) / 5), 2)) * rank(rank(volume)) / ((high - low) / (sum(close, 5) / 5) / (vwap - close))",
    84: "pow2(ts_rank(vwap - max(vwap, 15), 21), delta(close, 5))",
    85: "pow2(rank(corr(mix(high, close, 0.876703), adv30, 10)), rank(corr(ts_rank(mid, 4), ts_rank(volume, 10), 7)))",
    86: "-where(rank(open + close - (vwap + open)) < ts_rank(corr(close, sum(adv20, 15), 6), 20), 1, 0)",
    87: "-greater(rank(ts_decay_linear(delta(mix(close, vwap, 0.369701), 2), 3)), ts_rank(ts_decay_linear(abs(corr(adv81, close, 13)), 5), 14))",
    88: "less(rank(ts_decay_linear(rank(open) + rank(low) - (rank(high) + rank(close)), 8)), ts_rank(ts_decay_linear(corr(ts_rank(close, 8), ts_rank(adv60, 21), 8), 7), 3))",
    89: "ts_rank(ts_decay_linear(corr(low, adv10, 7), 6), 4) - ts_rank(ts_decay_linear(delta(vwap, 3), 10), 15)",
    90: "-pow2(rank(close - max(close, 5)), ts_rank(corr(adv40, low, 5), 3))",
    91: "-(ts_rank(ts_decay_linear(ts_decay_linear(corr(close, volume, 10), 16), 4), 5) - rank(ts_decay_linear(corr(vwap, adv30, 4), 3)))",
    92: "less(ts_rank(ts_decay_linear(where(low + open < mid + close, 1, 0), 15), 19), ts_rank(ts_decay_linear(corr(rank(low), rank(adv30), 8), 7), 7))",
    93: "ts_rank(ts_decay_linear(corr(vwap, adv81, 17), 20), 8) / rank(ts_decay_linear(delta(mix(close, vwap, 0.524434), 3), 16))",
    94: "-pow2(rank(vwap - min(vwap, 12)), ts_rank(corr(ts_rank(vwap, 20), ts_rank(adv60, 4), 18), 3))",
    95: "where(ts_rank(pow1(rank(corr(sum(mid, 19), sum(adv40, 19), 13)), 5), 12) < rank(open - min(open, 12)), 1, 0)",
    96: "-greater(ts_rank(ts_decay_linear(corr(rank(vwap), rank(volume), 4), 4), 8), ts_rank(ts_decay_linear(argmax(corr(ts_rank(close, 7), ts_rank(adv60, 4), 4), 13), 14), 13))",
    97: "-(rank(ts_decay_linear(delta(mix(low, vwap, 0.721001), 3), 20)) - ts_rank(ts_decay_linear(ts_rank(corr(ts_rank(low, 8), ts_rank(adv60, 17), 5), 19), 16), 7))",
    98: "rank(ts_decay_linear(corr(vwap, sum(adv5, 26), 5), 7)) - rank(ts_decay_linear(ts_rank(argmin(corr(rank(open), rank(adv15), 21), 9), 7), 8))",
    99: "-where(rank(corr(low, volume, 6)) < rank(corr(sum(mid, 20), sum(adv60, 20), 9)), 1, 0)",
    100: "-(1.5 * scale(rank(((close - low) - (high - close)) / (high - low) * volume)) - scale(corr(close, rank(adv20), 5) - rank(argmin(close, 30)))) * (volume / adv20)",
    101: "(close - open) / (high - low + 0.001)",
}
#: Formulas that are published with industry neutralisation.
NEUTRALISED = (48, 58, 59, 63, 67, 69, 70, 76, 79, 80, 82, 87, 89, 90, 91, 93, 97, 100)


def features(neutralised: bool = False) -> dict[str, str]:
    """Name to formula: the 82 plain alphas, and with ``neutralised`` the other 18, without their neutralisation."""
    return {f"alpha{n}": f for n, f in FORMULAS.items() if neutralised or n not in NEUTRALISED}


def neutral(df: DataFrame, *names: str, by: str = "industry", date: str = "datetime") -> DataFrame:
    """The named columns less their mean over the date and group."""
    changed: dict[str, Column] = {n: cross.demean(date, df[n], by) for n in names}
    return df.withColumns(changed)
