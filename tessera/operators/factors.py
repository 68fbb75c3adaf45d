"""The factor catalogue on bars, scores, rule signals and labels. Each function adds columns to a bar panel."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import rolling as R
from tessera.functions.rolling import Clock

K = Clock()


def _rows(n: int, k: Clock = K) -> Column:
    """Whether the symbol has at least n rows up to this one."""
    return F.count(F.lit(1)).over(k.last(n)) == n


def _lag(x, n=1, k: Clock = K) -> Column:
    return F.lag(x, n).over(k.order)


def _change(x: str, n: int = 1) -> Column:
    return F.when(_lag(x, n) != 0, F.col(x) / _lag(x, n) - 1)


def momentum(df: DataFrame, window: int = 5, up: float = 0.001, down: float = -0.001) -> DataFrame:
    """``momentum_ret_1, momentum, momentum_strength, momentum_trend``; UNKNOWN before window + 1 bars or with a price not above 0."""
    seen = K.last(window + 1)
    fine = _rows(window + 1) & (F.min("close").over(seen) > 0)
    ret, spread = _change("close", window), F.max("close").over(seen) - F.min("close").over(seen)
    return df.withColumns({
        "momentum_ret_1": F.when(fine, _change("close")), "momentum": F.when(fine, ret),
        "momentum_strength": F.when(fine, F.when(spread == 0, 0.0).otherwise(ret / spread)),
        "momentum_trend": F.when(~fine, "UNKNOWN").when(ret >= up, "UP").when(ret <= down, "DOWN").otherwise("FLAT"),
    })


def volatility(df: DataFrame, window: int = 20, low: float = 0.005, high: float = 0.02) -> DataFrame:
    """``volatility`` (population deviation of returns), ``volatility_mean, volatility_range, volatility_level``."""
    staged = df.withColumn("_ret", _change("close"))
    fine = F.count("_ret").over(K.last(window)) == window
    dev, bottom = F.stddev_pop("_ret").over(K.last(window)), F.min("close").over(K.last(window + 1))
    return staged.withColumns({
        "volatility": F.when(fine, dev), "volatility_mean": F.when(fine, F.avg("_ret").over(K.last(window))),
        "volatility_range": F.when(fine & (bottom != 0), F.max("close").over(K.last(window + 1)) / bottom - 1),
        "volatility_level": F.when(~fine, "UNKNOWN").when(dev >= high, "HIGH").when(dev <= low, "LOW").otherwise("MEDIUM"),
    }).drop("_ret")


def volume(df: DataFrame, short: int = 5, long: int = 10, high: float = 1.5, low: float = 0.7) -> DataFrame:
    """Means of volume with the current bar, its ratio to the long one, its change and level, and what price and volume did together.

    Means are over as many bars as there are; UNKNOWN on a symbol's first bar and while a close or volume among the last ``long`` bars is null.
    """
    seen, x = K.last(long), F.col("volume")
    fine = _lag("close").isNotNull() & _lag("volume").isNotNull() & (F.count(F.when(F.col("close").isNull() | x.isNull(), 1)).over(seen) == 0)
    mean_s, mean_l = F.avg(x).over(K.last(short)), F.avg(x).over(seen)
    ratio = F.when(mean_l > 0, x / mean_l).otherwise(0.0)
    change = F.when(_lag("volume") > 0, x / _lag("volume") - 1).otherwise(0.0)
    price = F.when(_lag("close") > 0, F.col("close") / _lag("close") - 1).otherwise(0.0)
    up, down = ratio >= high, ratio <= low
    return df.withColumns({
        "volume_ma_short": F.when(fine, mean_s), "volume_ma_long": F.when(fine, mean_l), "volume_ratio": F.when(fine, ratio), "volume_change": F.when(fine, change),
        "volume_level": F.when(~fine, "UNKNOWN").when(up, "HIGH_VOLUME").when(down, "LOW_VOLUME").otherwise("NORMAL_VOLUME"),
        "price_volume_signal": F.when(~fine, "UNKNOWN").when((price > 0) & up, "PRICE_UP_VOLUME_UP").when((price < 0) & up, "PRICE_DOWN_VOLUME_UP")
        .when((price > 0) & down, "PRICE_UP_VOLUME_LOW").when((price < 0) & down, "PRICE_DOWN_VOLUME_LOW").when(change > 1, "VOLUME_SPIKE").otherwise("NORMAL"),
    })


def bollinger(df: DataFrame, window: int = 20, dev: float = 2.0, near: float = 0.8) -> DataFrame:
    """Bands, their width over the middle, the close's place between them (0.5 if flat), and a signal."""
    fine = _rows(window)
    middle, width = F.avg("close").over(K.last(window)), F.stddev_pop("close").over(K.last(window)) * dev
    place = F.when(width == 0, 0.5).otherwise((F.col("close") - (middle - width)) / (2 * width))
    signal = F.when(~fine, "UNKNOWN").when(place > 1, "BREAK_UP").when(place < 0, "BREAK_DOWN").when(place >= near, "NEAR_UPPER").when(place <= 1 - near, "NEAR_LOWER").otherwise("MIDDLE")
    return df.withColumns({"boll_middle": F.when(fine, middle), "boll_up": F.when(fine, middle + width), "boll_down": F.when(fine, middle - width), "boll_width": F.when(fine & (middle != 0), 2 * width / middle), "boll_position": F.when(fine, place), "boll_signal": signal})


def price_volume_reversal(df: DataFrame, window: int = 20, price_edge: float = 0.02, volume_edge: float = 0.2) -> DataFrame:
    """``price_volume_reversal, divergence_signal, divergence_score``.

    The first is minus the correlation of price ratios with log volume ratios, 0 where a side is constant. Signal and score
    compare the changes of price and volume over the window. Null, null and UNKNOWN before window + 1 bars, or where a
    close is not above 0 or a volume that is divided by is 0.
    """
    price = F.when((_lag("close") > 0) & (F.col("close") > 0), F.col("close") / _lag("close"))
    vol = F.when((_lag("volume") > 0) & (F.col("volume") >= 0), F.log(F.col("volume") / _lag("volume") + 1))
    staged = df.withColumns({"_p": price, "_v": vol, "_dp": _change("close", window), "_dv": _change("volume", window)})
    both = F.col("_p").isNotNull() & F.col("_v").isNotNull()
    p, v = F.when(both, F.col("_p")), F.when(both, F.col("_v"))
    seen = K.last(window)
    spread = F.stddev_pop(p).over(seen) * F.stddev_pop(v).over(seen)
    fine = F.count(p).over(seen) == window
    dp, dv = F.col("_dp"), F.col("_dv")
    fall, rise, less, more = dp <= -price_edge, dp >= price_edge, dv <= -volume_edge, dv >= volume_edge
    signal = F.when(~fine, "UNKNOWN").when(fall & more, "BULLISH_DIVERGENCE").when(rise & less, "BEARISH_DIVERGENCE").when(fall & less, "SELLING_EXHAUSTION").when(rise & more, "TREND_CONFIRMATION").otherwise("NEUTRAL")
    points = F.when(fall & more, dv - dp).when(rise & less, dv - dp).when(fall & less, (-dp - dv) * 0.5).when(rise & more, dp + dv * 0.25).otherwise(0.0)
    return staged.withColumns({
        "price_volume_reversal": F.when(fine, F.when(spread > 0, -F.covar_pop(p, v).over(seen) / spread).otherwise(0.0)),
        "divergence_signal": signal, "divergence_score": F.when(fine, points),
    }).drop("_p", "_v", "_dp", "_dv")


def intraday_fade(df: DataFrame, window: int = 20, rise: float = 0.02, fall: float = 0.01, ratio: float = 0.6, burst: float = 1.5, single: bool = False) -> DataFrame:
    """``fade_score, fade_signal``: rise to the high, fall from it, the fall's share of the range, and a burst of volume.

    Over n bars against the n before, or one bar (``single``) against the mean of the n before; volumes of 0 are left out of
    what is compared with. Null and false before there are 2 n (n + 1) bars, without a range or without earlier volume.
    """
    n = 1 if single else window
    known = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("open", "high", "low", "close", "volume")}
    seen, before = K.last(n), K.last(window, skip=n)
    start = F.first(known["open"]).over(seen) if n > 1 else known["open"]
    top, bottom, last = F.max(known["high"]).over(seen), F.min(known["low"]).over(seen), known["close"]
    base = (F.avg if single else F.sum)(F.when(F.col("volume") > 0, F.col("volume"))).over(before)
    up, back, share, vol = (top - start) / start, (top - last) / top, (top - last) / (top - bottom), F.sum(known["volume"]).over(seen) / base
    fine = _rows(window + n) & (start > 0) & (top > bottom) & (bottom > 0) & (last > 0) & (base > 0)
    signal = (up >= rise) & (back >= fall) & (share >= ratio) & (vol >= burst)
    return df.withColumns({"fade_score": F.when(fine, up * back * share * vol), "fade_signal": F.coalesce(fine & signal, F.lit(False))})


def confirmed(df: DataFrame, signal: str = "fade_signal", times: int = 3) -> DataFrame:
    """``confirmed``: the signal has been true ``times`` bars running."""
    return df.withColumn("confirmed", F.sum(F.col(signal).cast("int")).over(K.last(times)) == times)


def volume_stall(df: DataFrame, window: int = 20, burst: float = 1.5, stall: float = 1.0) -> DataFrame:
    """Volume ratio times ``0.7 * (1 - place in the range) + 0.3 * upper shadow share``."""
    spread = F.col("high") - F.col("low")
    place = F.when(spread > 0, (F.col("close") - F.col("low")) / spread).otherwise(0.5)
    shadow = F.when(spread > 0, (F.col("high") - F.greatest("open", "close")) / spread).otherwise(0.0)
    base = F.avg("volume").over(K.last(window, skip=1))
    vol = F.when((base > 0) & (F.count("volume").over(K.last(window, skip=1)) == window), F.col("volume") / base)
    score = vol * (0.7 * (1 - place) + 0.3 * shadow)
    return df.withColumns({"stall_score": score, "stall_signal": F.coalesce((vol >= burst) & (score >= stall), F.lit(False))})


def style_momentum(df: DataFrame, styles: DataFrame, returns: DataFrame, edge: float = 0.02) -> DataFrame:
    """Joins ``styles(vt_symbol, style)`` and ``returns(style, style_momentum)``; STRONG, WEAK or NEUTRAL by the style's return."""
    out = df.join(styles, "vt_symbol", "left").join(returns, "style", "left")
    m = F.coalesce("style_momentum", F.lit(0.0))
    return out.withColumn("style_level", F.when(m >= edge, "STRONG").when(m <= -edge, "WEAK").otherwise("NEUTRAL"))


def order_book(df: DataFrame, levels: int = 5) -> DataFrame:
    """``voi1, voi2, oir, mpb`` of book snapshots ``(bid_price_i, ask_price_i, bid_volume_i, ask_volume_i, last_price)``.

    Volume order imbalance at the first level and over all of them, order imbalance ratio, and the last price less the
    mean of the current and previous mid price. Null for a symbol's first snapshot where the previous one is needed.
    """
    def change(side: str, i: int) -> Column:
        p, v = F.col(f"{side}_price_{i}"), F.col(f"{side}_volume_{i}")
        p1, v1 = _lag(p), _lag(v)
        better = p > p1 if side == "bid" else p < p1
        return F.when(p1.isNull(), None).when(p == p1, v - v1).when(better, v).otherwise(0.0)

    voi = [change("bid", i) - change("ask", i) for i in range(1, levels + 1)]
    total = lambda side: sum((F.col(f"{side}_volume_{i}") for i in range(2, levels + 1)), F.col(f"{side}_volume_1"))
    mid = (F.col("bid_price_1") + F.col("ask_price_1")) / 2
    return df.withColumns({
        "voi1": voi[0], "voi2": sum(voi[1:], voi[0]), "oir": F.when(total("bid") + total("ask") > 0, (total("bid") - total("ask")) / (total("bid") + total("ask"))),
        "mpb": F.col("last_price") - (mid + _lag(mid)) / 2,
    })


def future_return(df: DataFrame, horizon: int = 5) -> DataFrame:
    """``future_ret_<h>``: the return h bars ahead; null at the end and where the close is not above 0."""
    later = F.lead("close", horizon).over(K.order)
    return df.withColumn(f"future_ret_{horizon}", F.when(F.col("close") > 0, later / F.col("close") - 1))


def long_form(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """``(symbol, factor_name, value, trade_date)`` from columns: ``names`` maps factor name to column."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("factor_name"), F.col(c).cast("double").alias("value")) for n, c in names.items()))).alias("_f")
    return df.select(F.col("vt_symbol").alias("symbol"), F.col("datetime").alias("trade_date"), pairs).select("symbol", "_f.factor_name", "_f.value", "trade_date")


def score(df: DataFrame, weights: Mapping[str, float], min_score: float = 0.0, normalise: bool = True) -> DataFrame:
    """``total_score``: each named column clipped to 0..1, weighted and summed (to 100 if normalised); rows below the minimum go."""
    if not weights or any(w < 0 for w in weights.values()) or not sum(weights.values()):
        raise ValueError("weights must be non-negative and not all zero")
    missing = [n for n in weights if n not in df.columns]
    if missing:
        raise ValueError(f"no score column {missing[0]!r}")
    scale = 100 / sum(weights.values()) if normalise else 1.0
    total = sum((N.clip(F.coalesce(F.col(n), F.lit(0.0)), 0, 1) * (w * scale) for n, w in weights.items()), F.lit(0.0))
    return df.withColumn("total_score", total).where(F.col("total_score") >= min_score)


def ml_signal(df: DataFrame) -> DataFrame:
    """BUY, SELL or HOLD of a factor sample; BUY comes first."""
    buy = (F.col("momentum_trend") == "UP") & (F.col("momentum") >= 0.001) & ((F.col("volume_ratio") >= 1.2) | (F.col("volume_level") == "HIGH_VOLUME")) & (F.col("volatility") <= 0.03)
    sell = ((F.col("momentum_trend") == "DOWN") & (F.col("momentum") <= -0.001)) | (F.col("price_volume_signal") == "PRICE_DOWN_VOLUME_UP")
    return df.withColumn("signal", F.when(buy, "BUY").when(sell, "SELL").otherwise("HOLD"))


def position_signal(df: DataFrame) -> DataFrame:
    """LONG on BUY and FLAT on SELL; HOLD rows give no position signal and go."""
    return df.where(F.col("signal").isin("BUY", "SELL")).withColumn("target", F.when(F.col("signal") == "BUY", "LONG").otherwise("FLAT"))


def inflection_sample(df: DataFrame, high_window: int = 120, low_window: int = 20, recent: int = 10, hold: int = 5, surge: float = 0.08, burst: float = 2.5) -> DataFrame:
    """What ``inflection_entry`` looks at, from bars with a ``macd`` column; each is null or false where bars lack.

    ``drawdown_120`` is the fall from the highest close of ``high_window`` bars, ``return_1d`` the bar's return,
    ``volume_ratio_10`` the volume over the mean of the ten bars before, ``distance_from_low`` the rise from the least low of
    ``low_window`` bars. ``macd_bottom_divergence``: the least close of the last ``recent`` bars is below, their least macd above
    that of the ``low_window`` bars before. ``support_hold_after_surge``: the close is not below the open of the last bar, among
    ``hold``, that rose by ``surge`` on ``burst`` times the usual volume.
    """
    base, late, early = F.avg("volume").over(K.last(10, skip=1)), K.last(recent), K.last(low_window, skip=recent)
    fall = 1 - F.col("close") / F.max("close").over(K.last(high_window))
    staged = df.withColumns({"return_1d": _change("close"), "volume_ratio_10": F.when(base > 0, F.col("volume") / base), "drawdown_120": fall, "distance_from_low": F.col("close") / F.min("low").over(K.last(low_window)) - 1})
    support = F.last(F.when((F.col("return_1d") >= surge) & (F.col("volume_ratio_10") >= burst), F.col("open")), True).over(K.last(hold))
    diverges = _rows(low_window + recent) & (F.min("close").over(late) < F.min("close").over(early)) & (F.min("macd").over(late) > F.min("macd").over(early))
    return staged.withColumns({"macd_bottom_divergence": F.coalesce(diverges, F.lit(False)), "support_hold_after_surge": F.coalesce(F.col("close") >= support, F.lit(False))})


def inflection_entry(df: DataFrame, drawdown: float = 0.45, rise: float = 0.08, burst: float = 2.5, distance: float = 0.15) -> DataFrame:
    """``entry``: deep below the high, a divergence of MACD, a strong up bar on much volume, still near the low, and support holds."""
    rule = (F.col("drawdown_120") >= drawdown) & F.col("macd_bottom_divergence") & (F.col("return_1d") >= rise) & (F.col("volume_ratio_10") >= burst) & (F.col("distance_from_low") <= distance) & F.col("support_hold_after_surge")
    return df.withColumn("entry", F.coalesce(rule, F.lit(False)))


def inflection_signals(df: DataFrame, stop_loss: float = 0.025, take_profit: float = 0.05) -> DataFrame:
    """``(datetime, vt_symbol, direction, score, close)``: LONG on an ``entry`` while out, FLAT on a later bar at the stop or the profit.

    One pass over a symbol's bars in order; bars without a close never change the position.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        out, paid = [], None
        for when, symbol, close, entry in rows.sort_values("datetime", kind="stable").itertuples(index=False):
            if pd.isna(close):
                continue
            if paid is None and entry:
                paid = close
                out.append((when, symbol, "LONG", 1.0, close))
            elif paid is not None and not paid * (1 - stop_loss) < close < paid * (1 + take_profit):
                paid = None
                out.append((when, symbol, "FLAT", 0.0, close))
        return pd.DataFrame(out, columns=["datetime", "vt_symbol", "direction", "score", "close"])

    own = df.select("datetime", "vt_symbol", "close", "entry")
    kind = dict(own.dtypes)
    return own.groupBy("vt_symbol").applyInPandas(one, f"datetime {kind['datetime']}, vt_symbol {kind['vt_symbol']}, direction string, score double, close {kind['close']}")


def bar_alert(df: DataFrame, burst: float = 2.0, move: float = 0.01) -> DataFrame:
    """``alert``: VOLUME_UP, VOLUME_DOWN, MEANS_UP, MEANS_DOWN or NORMAL; ``push``: whether it, the return or the volume is worth a message.

    Up is a close over its 5-bar mean and that over the 10-bar one, down the reverse; volume bursts if it is ``burst`` times its
    5-bar mean, the bar included. Null before ten bars.
    """
    ma5, ma10, base = F.avg("close").over(K.last(5)), F.avg("close").over(K.last(10)), F.avg("volume").over(K.last(5))
    loud = F.when(base > 0, F.col("volume") / base).otherwise(0.0) >= burst
    up, down = (F.col("close") > ma5) & (ma5 > ma10), (F.col("close") < ma5) & (ma5 < ma10)
    moved = F.abs(F.when(_lag("close") > 0, F.col("close") / _lag("close") - 1).otherwise(0.0)) >= move
    kind = F.when(up & loud, "VOLUME_UP").when(down & loud, "VOLUME_DOWN").when(up, "MEANS_UP").when(down, "MEANS_DOWN").otherwise("NORMAL")
    return df.withColumns({"alert": F.when(_rows(10), kind), "push": F.when(_rows(10), up | down | moved | loud)})


def daily_selection(bars: DataFrame, universe: DataFrame, top: int = 10, min_amount: float = 0.0) -> DataFrame:
    """Ranks symbols on their last day by momentum over 20 and 60 rows: ``rank, code, …, total_score``.

    Symbols that do not trade, are under special treatment, lack 61 rows or trade too little on average are left out.
    """
    k = Clock("code", "date")
    staged = bars.withColumns({
        "momentum_20": F.col("close") / F.lag("close", 20).over(k.order) - 1, "momentum_60": F.col("close") / F.lag("close", 60).over(k.order) - 1,
        "average_amount_20": F.avg("amount").over(k.last(20)), "_last": F.row_number().over(W.partitionBy("code").orderBy(F.desc("date"))),
    })
    last = staged.where((F.col("_last") == 1) & (F.col("tradestatus").cast("string") == "1") & (F.col("isST").cast("string") == "0") & F.col("momentum_60").isNotNull() & (F.col("average_amount_20") >= min_amount))
    scored = last.withColumn("total_score", F.col("momentum_20") * 0.5 + F.col("momentum_60") * 0.5).join(universe, "code")
    ranked = scored.withColumn("rank", F.row_number().over(W.orderBy(F.desc("total_score"), "code")))  # a row a symbol
    return ranked.where(F.col("rank") <= top).select("rank", "code", "code_name", "industry", F.col("date").alias("trade_date"), "momentum_20", "momentum_60", "average_amount_20", "total_score")
