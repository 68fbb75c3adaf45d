"""Bars from ticks, longer bars from shorter ones, and a regular grid with missing bars filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER = ("datetime", "event_id")


def _ohlc(first: Column, high: Column, low: Column, last: Column, by: Column) -> list[Column]:
    return [F.min_by(first, by).alias("open"), F.max(high).alias("high"), F.min(low).alias("low"), F.max_by(last, by).alias("close")]


def tick_steps(ticks: DataFrame, sequence: str = "event_id", unpriced: bool = False) -> DataFrame:
    """Ticks with a price, and ``dv``: the rise of cumulative volume since the symbol's previous tick, not below 0; 0 for the first.

    The previous tick is the last one with a price, so what ticks without one traded goes to the next; with ``unpriced``
    it is the last one of any price, so it goes to no bar.
    """
    order = W.partitionBy("vt_symbol").orderBy("datetime", sequence)
    step = F.coalesce(F.greatest(F.col("volume") - F.lag("volume").over(order), F.lit(0.0)), F.lit(0.0))
    if unpriced:
        return ticks.withColumn("dv", step).where("last_price > 0")
    return ticks.where("last_price > 0").withColumn("dv", step)


def bars_from_ticks(ticks: DataFrame, minutes: int = 1, sequence: str = "event_id", unpriced: bool = False) -> DataFrame:
    """Bars of whole minutes; ``unpriced`` is as in ``tick_steps``. A session high or low column, where the ticks have one, widens the bar when it improves."""
    steps = tick_steps(ticks, sequence, unpriced)
    order = W.partitionBy("vt_symbol").orderBy("datetime", sequence)
    high = low = F.col("last_price")
    if "high_price" in ticks.columns:
        high = F.when(F.col("high_price") > F.lag("high_price").over(order), F.greatest("high_price", "last_price")).otherwise(high)
    if "low_price" in ticks.columns:
        low = F.when(F.col("low_price") < F.lag("low_price").over(order), F.least("low_price", "last_price")).otherwise(low)
    steps = steps.withColumns({"_high": high, "_low": low})
    start = F.window(F.col("datetime").cast("timestamp"), f"{minutes} minutes").start.cast("timestamp_ntz")
    return steps.groupBy("vt_symbol", start.alias("datetime_")).agg(
        *_ohlc(F.col("last_price"), F.col("_high"), F.col("_low"), F.col("last_price"), F.struct("datetime", sequence)), F.sum("dv").alias("volume"), F.count("*").alias("n_ticks")
    ).withColumnRenamed("datetime_", "datetime")


def longer_bars(bars: DataFrame, unit: str = "minute", n: int = 1) -> DataFrame:
    """Bars of n minutes, hours or days from shorter ones, on the clock; volume and ticks add up."""
    if unit == "minute":
        start = F.window(F.col("datetime").cast("timestamp"), f"{n} minutes").start.cast("timestamp_ntz")
    else:
        start = F.date_trunc(unit, "datetime").cast("timestamp_ntz")
    extra = [F.sum(c).alias(c) for c in ("volume", "turnover", "n_ticks") if c in bars.columns]
    out = bars.groupBy("vt_symbol", start.alias("_t")).agg(*_ohlc(F.col("open"), F.col("high"), F.col("low"), F.col("close"), F.col("datetime")), *extra).withColumnRenamed("_t", "datetime")
    if unit == "minute" or n == 1:
        return out
    nth = F.ceil(F.row_number().over(W.partitionBy("vt_symbol").orderBy("datetime")) / n)  # every n finished bars
    numbered = out.withColumn("_g", nth)
    extra = [F.sum(c).alias(c) for c in ("volume", "turnover", "n_ticks") if c in bars.columns]
    return numbered.groupBy("vt_symbol", "_g").agg(F.min("datetime").alias("_t"), *_ohlc(F.col("open"), F.col("high"), F.col("low"), F.col("close"), F.col("datetime")), *extra).drop("_g").withColumnRenamed("_t", "datetime")


def minutes_merged(bars: DataFrame, n: int) -> DataFrame:
    """N-minute bars that close only when the closing minute is there: a window that misses it runs on into the next."""
    order = W.partitionBy("vt_symbol").orderBy("datetime")
    closing = ((F.minute("datetime") + 1) % n == 0).cast("int")
    group = F.coalesce(F.sum(closing).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return bars.withColumn("_g", group).groupBy("vt_symbol", "_g").agg(
        F.min("datetime").alias("start"), *_ohlc(F.col("open"), F.col("high"), F.col("low"), F.col("close"), F.col("datetime")), F.sum("volume").alias("volume"), F.max(closing).alias("closed")
    ).drop("_g")


def session_bars(bars: DataFrame, session_end: str) -> DataFrame:
    """Daily bars of sessions that end at ``session_end`` (HH:mm): a later minute belongs to the next day."""
    hours, minutes = map(int, session_end.split(":"))
    late = F.hour("datetime") * 60 + F.minute("datetime") > hours * 60 + minutes
    day = F.date_add(F.to_date("datetime"), F.when(late, 1).otherwise(0))
    return bars.groupBy("vt_symbol", day.alias("date")).agg(*_ohlc(F.col("open"), F.col("high"), F.col("low"), F.col("close"), F.col("datetime")), F.sum("volume").alias("volume"))


def fill_bars(bars: DataFrame) -> DataFrame:
    """A bar for each symbol at each time of the panel from its first bar on; missing ones stand still at the last close.

    Filled bars have volume 0 and ``filled`` true.
    """
    times = bars.select("datetime").distinct()
    spans = bars.groupBy("vt_symbol").agg(F.min("datetime").alias("_from"))
    grid = spans.join(times, F.col("datetime") >= F.col("_from")).select("vt_symbol", "datetime")
    full = grid.join(bars, ["vt_symbol", "datetime"], "left")
    last = F.last("close", ignorenulls=True).over(W.partitionBy("vt_symbol").orderBy("datetime").rowsBetween(W.unboundedPreceding, W.currentRow))
    held = full.withColumns({"_last": last, "filled": F.col("close").isNull()})
    prices = {c: F.coalesce(c, "_last") for c in ("open", "high", "low", "close")}
    return held.withColumns(prices | {"volume": F.coalesce("volume", F.lit(0.0))}).select("vt_symbol", "datetime", "open", "high", "low", "close", "volume", "filled")
