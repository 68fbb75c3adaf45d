"""Portfolio backtests: matching as one state machine a portfolio, profit and loss and statistics as plain relations."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRADES = "portfolio string, datetime timestamp_ntz, vt_symbol string, direction string, price double, volume double"


@dataclass(frozen=True)
class Rotation:
    """Hold the best ``top`` symbols by signal: each bar at most ``drop`` of the worst held go after ``min_days`` bars.

    Held symbols without a signal go too. As many are bought as were to go, though some of these may be too young to.
    """

    top: int = 10
    drop: int = 2
    min_days: int = 3
    cash_ratio: float = 0.95
    min_volume: float = 100.0
    price_add: float = 0.05
    capital: float = 1_000_000.0
    limit: float = 0.1
    long_rate: float = 0.0005
    short_rate: float = 0.0015
    min_commission: float = 5.0
    size: float = 1.0
    pricetick: float = 0.01


def to_tick(price: float, tick: float) -> float:
    """The nearest multiple of the tick, halves to even."""
    step = Decimal(str(tick))
    return float((Decimal(str(price)) / step).to_integral_value(ROUND_HALF_EVEN) * step)


class Book:
    """One portfolio on its way through the bars: ``day`` takes those of one time and returns the trades they bring.

    Orders made on a bar are matched on the next ones: a buy fills whole at ``min(order, open)`` if it is not below the
    low and the low is under the upper price limit; a sale mirrors that. A symbol without a bar keeps its last close and
    does not trade. Open orders are cancelled before new ones are made. Of symbols neither held nor ordered nothing is kept.
    """

    def __init__(self, rule: Rotation):
        self.rule, self.cash, self.held, self.age, self.last, self.orders = rule, rule.capital, {}, {}, {}, []

    def day(self, when, symbols: list[str], bars: Mapping[str, np.ndarray]) -> list[tuple]:
        """``symbols`` in ascending order, ``bars`` their open, high, low, close and signal; of a symbol twice the last counts."""
        rule, held, age, last = self.rule, self.held, self.age, self.last
        now = {s: i for i, s in enumerate(symbols)}
        rest, trades = [], []
        for symbol, side, price, volume in self.orders:
            i, before = now.get(symbol), last.get(symbol)
            if i is None or before is None:
                rest.append((symbol, side, price, volume))
                continue
            opened, high, low = (float(bars[c][i]) for c in ("open", "high", "low"))
            up, down = to_tick(before * (1 + rule.limit), rule.pricetick), to_tick(before * (1 - rule.limit), rule.pricetick)
            if side == "LONG" and 0 < low <= price and low < up:
                paid, rate, sign = min(price, opened), rule.long_rate, 1
            elif side == "SHORT" and 0 < price <= high and high > down:
                paid, rate, sign = max(price, opened), rule.short_rate, -1
            else:
                rest.append((symbol, side, price, volume))
                continue
            value = paid * volume * rule.size
            self.cash -= sign * value + value * rate
            held[symbol] = held.get(symbol, 0.0) + sign * volume
            if held[symbol] <= 0:
                held.pop(symbol)
                age.pop(symbol, None)
            trades.append((when, symbol, side, float(paid), float(volume)))
        last |= {s: float(bars["close"][now[s]]) for s in (*held, *(o[0] for o in rest)) if s in now}
        for symbol in held:
            age[symbol] = age.get(symbol, 0) + 1

        alone = np.fromiter(now.values(), "int64", len(now))
        alone = alone[~np.isnan(bars["signal"][alone])]
        ranked = alone[np.argsort(-bars["signal"][alone], kind="stable")]
        place = np.full(len(symbols), -1, "int64")
        place[ranked] = np.arange(len(ranked))
        at = {s: int(place[now[s]]) for s in held if s in now and place[now[s]] >= 0}
        union = sorted({*at.values(), *range(min(rule.top, len(ranked)))})
        worst = set(union[max(0, len(union) - rule.drop) :])
        sell = [s for s in held if s not in at or at[s] in worst]
        wanted = max(0, rule.top + len(sell) - len(held))
        buy = list(itertools.islice((s for s in (symbols[i] for i in ranked) if s not in held), wanted))
        self.orders, free = [], self.cash
        for symbol in sell:
            if symbol in now and age[symbol] >= rule.min_days:
                self.orders.append((symbol, "SHORT", to_tick(last[symbol] * (1 - rule.price_add), rule.pricetick), held[symbol]))
                value = last[symbol] * held[symbol] * rule.size
                free += value - max(value * rule.short_rate, rule.min_commission)
        for symbol in buy:
            price = last[symbol] = float(bars["close"][now[symbol]])
            if price > 0 and (volume := to_tick(free * rule.cash_ratio / len(buy) / (price * rule.size), rule.min_volume)) > 0:
                self.orders.append((symbol, "LONG", to_tick(price * (1 + rule.price_add), rule.pricetick), volume))
        wanted_still = {*held, *(o[0] for o in self.orders)}
        self.last = {s: c for s, c in last.items() if s in wanted_still}
        return trades


def simulate(rows: pd.DataFrame, rule: Rotation) -> list[tuple]:
    """Trades ``(datetime, vt_symbol, direction, price, volume)`` of one portfolio over bars with a ``signal`` column."""
    book, trades = Book(rule), []
    for when, bars in rows.sort_values(["datetime", "vt_symbol"], kind="stable").groupby("datetime", sort=True):
        trades += book.day(when, bars["vt_symbol"].tolist(), {c: bars[c].to_numpy("float64", na_value=np.nan) for c in VALUES})
    return trades


VALUES = ("open", "high", "low", "close", "signal")


def _times(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """``(portfolio, datetime, symbols, values)`` for each portfolio and time of batches in their order, one at a time in memory."""
    key, parts = None, []

    def whole():
        both = pa.Table.from_batches(parts)
        values = {c: both[c].to_numpy() for c in VALUES}
        return *key, both["vt_symbol"].to_pylist(), values

    for batch in batches:
        if not batch.num_rows:
            continue
        portfolio = batch["portfolio"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        time = batch["datetime"].cast(pa.int64()).to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(portfolio) != 0) | (np.diff(time) != 0)) + 1).tolist(), batch.num_rows]
        for begin, end in itertools.pairwise(cuts):
            here = (batch["portfolio"][begin].as_py(), batch["datetime"][begin].as_py())
            if parts and here != key:
                yield whole()
                parts = []
            key = here
            parts.append(batch.slice(begin, end - begin))
    if parts:
        yield whole()


def run(bars: DataFrame, rule: Rotation = Rotation(), portfolio: str | None = None) -> DataFrame:
    """Trades of each portfolio over ``bars(datetime, vt_symbol, open, high, low, close, signal[, portfolio])``.

    A portfolio is one sequential task; many of them, as in a parameter search, run side by side. Bars come in sorted by
    Spark, which spills; in memory are the bars of one time and what is held or ordered.
    """
    data = bars if portfolio else bars.withColumn("portfolio", F.lit("main"))
    data = data.select(F.col(portfolio or "portfolio").cast("string").alias("portfolio"), F.col("datetime").cast("timestamp_ntz").alias("datetime"), "vt_symbol", *(F.col(c).cast("double").alias(c) for c in VALUES))
    data = data.where("datetime is not null").repartition("portfolio").sortWithinPartitions("portfolio", "datetime", "vt_symbol")
    schema = pa.schema([("portfolio", pa.string()), ("datetime", pa.timestamp("us")), ("vt_symbol", pa.string()), ("direction", pa.string()), ("price", pa.float64()), ("volume", pa.float64())])

    def trade(batches):
        name = book = None
        for portfolio, when, symbols, values in _times(batches):
            if book is None or portfolio != name:
                name, book = portfolio, Book(rule)
            if trades := book.day(when, symbols, values):
                columns = [[portfolio] * len(trades), *zip(*trades, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return data.mapInArrow(trade, TRADES)


def daily_result(bars: DataFrame, trades: DataFrame, contracts: DataFrame) -> DataFrame:
    """``(date, trade_count, turnover, commission, trading_pnl, holding_pnl, total_pnl, net_pnl)`` by mark to market.

    ``bars(datetime, vt_symbol, close)`` are daily, ``trades(datetime, vt_symbol, direction, price, volume)``,
    ``contracts(vt_symbol, long_rate, short_rate, size)``. A symbol without a bar on a day is valued at its last close.
    """
    signed = F.when(F.col("direction") == "LONG", F.col("volume")).otherwise(-F.col("volume"))
    close = bars.select(F.to_date("datetime").alias("date"), "vt_symbol", "close")
    dates = close.select("date").distinct()
    deals = trades.join(contracts, "vt_symbol").withColumns({"date": F.to_date("datetime"), "q": signed, "value": F.col("price") * F.col("volume") * F.col("size")})
    by_day = deals.groupBy("date", "vt_symbol").agg(
        F.count("*").alias("n"), F.sum("q").alias("q"), F.sum("value").alias("turnover"), F.sum(F.col("q") * F.col("price")).alias("cost"),
        F.sum(F.col("value") * F.when(F.col("direction") == "LONG", F.col("long_rate")).otherwise(F.col("short_rate"))).alias("commission"),
    )
    symbols = trades.select("vt_symbol").distinct()
    grid = dates.join(symbols, how="cross").join(close, ["date", "vt_symbol"], "left").join(by_day, ["date", "vt_symbol"], "left").join(contracts.select("vt_symbol", "size"), "vt_symbol")
    order = W.partitionBy("vt_symbol").orderBy("date")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    grid = grid.withColumn("close", F.coalesce(F.last("close", True).over(so_far), F.lit(0.0))).fillna(0, ["n", "q", "turnover", "cost", "commission"])
    grid = grid.withColumns({"end": F.sum("q").over(so_far), "before": F.lag("close").over(order)})
    grid = grid.withColumns({
        "holding": F.when(F.col("before") > 0, (F.col("end") - F.col("q")) * (F.col("close") - F.col("before")) * F.col("size")).otherwise(0.0),
        "trading": (F.col("q") * F.col("close") - F.col("cost")) * F.col("size"),
    })
    total = grid.groupBy("date").agg(F.sum("n").cast("long").alias("trade_count"), *(F.sum(c).alias(n) for c, n in (("turnover", "turnover"), ("commission", "commission"), ("trading", "trading_pnl"), ("holding", "holding_pnl"))))
    return total.withColumn("total_pnl", F.col("trading_pnl") + F.col("holding_pnl")).withColumn("net_pnl", F.col("total_pnl") - F.col("commission"))


def balances(daily: DataFrame, capital: float) -> DataFrame:
    """Adds ``balance, ret, highlevel, drawdown, ddpercent``: one row a day, so one ordered pass."""
    so_far = W.orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = daily.withColumn("balance", F.sum("net_pnl").over(so_far) + float(capital))
    before = F.lag("balance").over(W.orderBy("date"))
    out = out.withColumns({"ret": F.coalesce(F.when(before != 0, F.col("balance") / before - 1), F.lit(0.0)), "highlevel": F.max("balance").over(so_far)})
    return out.withColumn("drawdown", F.col("balance") - F.col("highlevel")).withColumn("ddpercent", F.when(F.col("highlevel") != 0, F.col("drawdown") / F.col("highlevel") * 100))


def statistics(daily: DataFrame, capital: float = 1_000_000.0, risk_free: float = 0.0, annual_days: int = 240) -> DataFrame:
    """One row of 24 figures. A portfolio whose balance ever falls to 0 has zeros in place of the figures on returns."""
    b = balances(daily, capital)
    one = b.agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("total_days"),
        F.count_if(F.col("net_pnl") > 0).alias("profit_days"), F.count_if(F.col("net_pnl") < 0).alias("loss_days"),
        F.max_by("balance", "date").alias("end_balance"), F.min("balance").alias("_least"), F.min("drawdown").alias("max_drawdown"), F.min("ddpercent").alias("max_ddpercent"),
        F.min_by("date", F.struct("drawdown", "date")).alias("_trough"), F.sum("net_pnl").alias("total_net_pnl"), F.sum("commission").alias("total_commission"),
        F.sum("turnover").alias("total_turnover"), F.sum("trade_count").alias("total_trade_count"), F.avg("ret").alias("_mean"), F.stddev_samp("ret").alias("_dev"),
    )
    peak = b.join(F.broadcast(one.select("_trough")), F.col("date") <= F.col("_trough")).agg(F.max_by("date", F.struct("balance", F.negative(F.datediff("date", F.lit("1970-01-01"))))).alias("_peak"))
    both = one.crossJoin(F.broadcast(peak))
    alive = F.col("_least") > 0
    safe = lambda c: F.coalesce(F.when(alive & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c), F.lit(0.0))
    days = F.col("total_days")
    total = (F.col("end_balance") / float(capital) - 1) * 100
    daily_free = risk_free / annual_days**0.5
    sharpe = F.when(F.col("_dev") > 0, (F.col("_mean") * 100 - daily_free) / (F.col("_dev") * 100) * annual_days**0.5)
    return both.select(
        "start_date", "end_date", "total_days", "profit_days", "loss_days", F.lit(float(capital)).alias("capital"), safe(F.col("end_balance")).alias("end_balance"),
        safe(F.col("max_drawdown")).alias("max_drawdown"), safe(F.col("max_ddpercent")).alias("max_ddpercent"),
        F.when(alive, F.datediff("_trough", "_peak")).otherwise(0).alias("max_drawdown_duration"),
        *(x for name, c in (("net_pnl", "total_net_pnl"), ("commission", "total_commission"), ("turnover", "total_turnover"), ("trade_count", "total_trade_count"))
          for x in (safe(F.col(c).cast("double")).alias(f"total_{name}"), safe(F.col(c) / days).alias(f"daily_{name}"))),
        safe(total).alias("total_return"), safe(total / days * annual_days).alias("annual_return"), safe(F.col("_mean") * 100).alias("daily_return"), safe(F.col("_dev") * 100).alias("return_std"),
        safe(sharpe).alias("sharpe_ratio"), safe(F.when(F.col("max_drawdown") != 0, -F.col("total_net_pnl") / F.col("max_drawdown"))).alias("return_drawdown_ratio"),
    )


def performance(daily: DataFrame, benchmark: DataFrame, capital: float) -> DataFrame:
    """``(date, cum_return, cum_cost, bench_return, excess, drawdown, excess_drawdown)`` against ``benchmark(date, close)``."""
    so_far = W.orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = balances(daily, capital).join(benchmark, "date")
    out = joined.select("date", (F.col("balance") / float(capital) - 1).alias("cum_return"), (F.sum("commission").over(so_far) / float(capital)).alias("cum_cost"), (F.col("close") / F.first("close").over(so_far) - 1).alias("bench_return"), (F.col("ddpercent") / 100).alias("drawdown"))
    out = out.withColumn("excess", F.col("cum_return") - F.col("bench_return"))
    return out.withColumn("excess_drawdown", F.col("excess") - F.max("excess").over(so_far))


# Parameter search.


def grid(axes: Mapping[str, tuple[float, float, float]]) -> list[dict[str, float]]:
    """All settings of the axes ``start, end, step``, ends included, steps added up as floats."""
    def steps(start, end, step):
        out, value = [], start
        while value <= end:
            out.append(value)
            value += step
        return out

    return [dict(zip(axes, values, strict=True)) for values in itertools.product(*(steps(*a) for a in axes.values()))]


def search(spark: SparkSession, bars: DataFrame, settings: list[dict[str, float]], target: Callable[[pd.DataFrame, dict], float]) -> DataFrame:
    """``(param_id, setting, value)``, best first: ``target`` sees all bars, one setting a task."""
    table = spark.createDataFrame([(i, {k: float(v) for k, v in s.items()}) for i, s in enumerate(settings)], "param_id int, setting map<string,double>")
    rows = bars.crossJoin(F.broadcast(table)) if len(settings) <= 10_000 else bars.join(table, how="cross")

    def one(key, part):
        setting = dict(part["setting"].iloc[0])
        return pd.DataFrame([(int(key[0]), setting, float(target(part.drop(columns=["setting", "param_id"]), setting)))], columns=["param_id", "setting", "value"])

    return rows.groupBy("param_id").applyInPandas(one, "param_id int, setting map<string,double>, value double").orderBy(F.desc("value"), "param_id")


def evolve(evaluate: Callable[[list[dict]], list[float]], axes: Mapping[str, tuple[float, float, float]], population: int = 20, generations: int = 10, seed: int = 0, mutation: float = 0.2) -> list[tuple[dict, float]]:
    """Genetic search: each generation's new settings are evaluated together (one Spark job), the best survive; best first."""
    rng, choices = random.Random(seed), {k: [s[k] for s in grid({k: a})] for k, a in axes.items()}
    known: dict[tuple, float] = {}

    def value(people):
        new = [p for p in dict.fromkeys(people) if p not in known]
        known.update(zip(new, evaluate([dict(zip(choices, p, strict=True)) for p in new]), strict=True) if new else ())
        return sorted(dict.fromkeys(people), key=lambda p: (-known[p], p))

    people = value([tuple(rng.choice(c) for c in choices.values()) for _ in range(population)])
    for _ in range(generations):
        parents = people[: max(2, population // 2)]
        children = []
        for _ in range(population):
            a, b = rng.choice(parents), rng.choice(parents)
            child = [rng.choice(pair) for pair in zip(a, b, strict=True)]
            children.append(tuple(rng.choice(c) if rng.random() < mutation else x for x, c in zip(child, choices.values(), strict=True)))
        people = value(people + children)[:population]
    return [(dict(zip(choices, p, strict=True)), known[p]) for p in people]
