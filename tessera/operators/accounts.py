"""Orders, positions and risk: latest states, today's and yesterday's holdings, and rules in order of priority."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Order states in which an order can still trade.
ACTIVE = ("SUBMITTING", "NOTTRADED", "PARTTRADED")


def latest(changes: DataFrame, key: str, order: Sequence[str] = ("datetime", "seq")) -> DataFrame:
    """The last change of each key."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, *(f"_r.{c}" for c in rest))


def active_orders(changes: DataFrame, key: str = "vt_orderid") -> DataFrame:
    return latest(changes, key).where(F.col("status").isin(*ACTIVE))


POSITIONS = "vt_symbol string, long_pos double, long_td double, long_yd double, short_pos double, short_td double, short_yd double, long_cash_frozen double, short_cash_frozen double"


def holdings(trades: DataFrame, closes: DataFrame | None = None, today_first: Sequence[str] = ("SHFE", "INE")) -> DataFrame:
    """Positions by symbol from ``trades(seq, vt_symbol, direction, offset, volume)``, with today's and yesterday's parts.

    A close takes yesterday's part first; on the ``today_first`` exchanges a plain close takes yesterday's part only and
    CLOSETODAY today's. ``closes(vt_symbol, direction, volume)`` are open closing orders, whose volume is frozen.
    """
    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        part = {("LONG", "td"): 0.0, ("LONG", "yd"): 0.0, ("SHORT", "td"): 0.0, ("SHORT", "yd"): 0.0}
        exchange = key[0].rpartition(".")[2]
        for t in rows.sort_values("seq").itertuples():
            side = t.direction
            if t.offset == "OPEN":
                part[side, "td"] += t.volume
                continue
            other = "SHORT" if side == "LONG" else "LONG"
            if t.offset == "CLOSETODAY":
                part[other, "td"] -= t.volume
            elif t.offset == "CLOSEYESTERDAY" or exchange in today_first:
                part[other, "yd"] -= t.volume
            else:
                used = min(part[other, "yd"], t.volume)
                part[other, "yd"] -= used
                part[other, "td"] -= t.volume - used
        return pd.DataFrame([(key[0], *(x for s in ("LONG", "SHORT") for x in (part[s, "td"] + part[s, "yd"], part[s, "td"], part[s, "yd"])))], columns=["vt_symbol", "long_pos", "long_td", "long_yd", "short_pos", "short_td", "short_yd"])

    schema = "vt_symbol string, long_pos double, long_td double, long_yd double, short_pos double, short_td double, short_yd double"
    out = trades.groupBy("vt_symbol").applyInPandas(one, schema)
    if closes is None:
        return out
    frozen = closes.groupBy("vt_symbol").agg(F.sum(F.when(F.col("direction") == "SHORT", F.col("volume")).otherwise(0.0)).alias("long_frozen"), F.sum(F.when(F.col("direction") == "LONG", F.col("volume")).otherwise(0.0)).alias("short_frozen"))
    return out.join(frozen, "vt_symbol", "left").fillna(0.0, ["long_frozen", "short_frozen"])


def split_close(requests: DataFrame, positions: DataFrame, mode: str = "yesterday_first") -> DataFrame:
    """Closing requests ``(id, vt_symbol, direction, volume)`` as ``(id, offset, volume)`` parts that the position allows.

    ``yesterday_first`` splits into CLOSEYESTERDAY and CLOSETODAY; ``lock`` opens the other side while today's part is not
    empty and else closes yesterday's; ``net`` closes what there is and opens the rest. Requests beyond the position give nothing.
    """
    held = requests.join(positions, "vt_symbol")
    side = lambda c: F.when(F.col("direction") == "SHORT", F.col(f"long_{c}")).otherwise(F.col(f"short_{c}"))
    pos, td, yd, need = side("pos"), side("td"), side("yd"), F.col("volume")
    if mode == "lock":
        parts = F.when(td > 0, F.array(F.struct(F.lit("OPEN").alias("offset"), need.alias("volume")))).otherwise(
            F.array(F.struct(F.lit("CLOSEYESTERDAY").alias("offset"), F.least(yd, need).alias("volume")), F.struct(F.lit("OPEN").alias("offset"), (need - F.least(yd, need)).alias("volume"))))
    elif mode == "net":
        parts = F.array(F.struct(F.lit("CLOSE").alias("offset"), F.least(pos, need).alias("volume")), F.struct(F.lit("OPEN").alias("offset"), (need - F.least(pos, need)).alias("volume")))
    else:
        held = held.where(need <= pos)
        parts = F.array(F.struct(F.lit("CLOSEYESTERDAY").alias("offset"), F.least(yd, need).alias("volume")), F.struct(F.lit("CLOSETODAY").alias("offset"), (need - F.least(yd, need)).alias("volume")))
    return held.select("id", F.explode(parts).alias("_p")).select("id", "_p.offset", "_p.volume").where("volume > 0")


def risk_check(requests: DataFrame, rules: Sequence[tuple[int, str, str, Column]]) -> DataFrame:
    """``rule, action`` of the first rule, by priority, that hits; warnings pass on to later rules.

    ``rules`` are ``(priority, name, action, condition)``; ``passed`` is false if a rule other than a WARNING hits.
    """
    rule = action = None
    warned = F.array_compact(F.array(*(F.when(c, F.lit(n)) for _, n, a, c in sorted(rules, key=lambda r: r[0]) if a == "WARNING"))) if any(r[2] == "WARNING" for r in rules) else F.array().cast("array<string>")
    for _, name, act, condition in sorted((r for r in rules if r[2] != "WARNING"), key=lambda r: r[0]):
        rule = F.when(condition, name) if rule is None else rule.when(condition, name)
        action = F.when(condition, act) if action is None else action.when(condition, act)
    none = F.lit(None).cast("string")
    rule, action = (none if rule is None else rule), (none if action is None else action)
    return requests.withColumns({"rule": rule, "action": action, "warnings": warned, "passed": rule.isNull()})


def active_count(changes: DataFrame, by: str = "account", key: str = "vt_orderid") -> DataFrame:
    """Orders of each account that can still trade, for a limit on them."""
    return active_orders(changes, key).groupBy(by).agg(F.count("*").alias("n_active"))


class Pool:
    """A subscription pool: ``symbols(symbol, name, sector, tier, enabled, tags array<string>)``."""

    def __init__(self, symbols: DataFrame):
        self.symbols = symbols

    def enabled(self) -> DataFrame:
        return self.symbols.where("enabled")

    def of_sector(self, *sectors: str) -> DataFrame:
        return self.enabled().where(F.col("sector").isin(*sectors))

    def of_tier(self, tier: int) -> DataFrame:
        return self.enabled().where(F.col("tier") == tier)

    def sectors(self) -> DataFrame:
        return self.symbols.select("sector").distinct()

    def listed(self) -> DataFrame:
        """One row: all enabled symbols in order, joined by commas."""
        return self.enabled().agg(F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("symbols"))

    def set_enabled(self, symbols: Sequence[str], on: bool) -> Pool:
        return Pool(self.symbols.withColumn("enabled", F.when(F.col("symbol").isin(*symbols), F.lit(on)).otherwise(F.col("enabled"))))

    def add(self, symbols: DataFrame) -> Pool:
        from tessera.operators.relational import upsert

        return Pool(upsert(self.symbols, symbols, ["symbol"]))

    def remove(self, *symbols: str) -> Pool:
        return Pool(self.symbols.where(~F.col("symbol").isin(*symbols)))

    @staticmethod
    def latest_day(listing: DataFrame, day, look_back: int = 7) -> DataFrame:
        """``listing(date, …)`` of the last day that has rows, up to ``look_back`` days before ``day``."""
        span = listing.where(F.col("date").between(F.date_sub(F.lit(day).cast("date"), look_back), F.lit(day).cast("date")))
        return span.withColumn("_last", F.max("date").over(W.partitionBy())).where("date = _last").drop("_last")


def dispatch(strategies: DataFrame, events: DataFrame) -> DataFrame:
    """``(strategy, event_id)``: events ``(event_id, symbol, factors array)`` to strategies ``(strategy, symbols array, required array,
    active)`` whose symbols hold the event's, or ``*``, and whose required factors the event all brings."""
    wide = F.broadcast(strategies.where("active")) if strategies.count() <= 10_000 else strategies.where("active")
    hit = (F.array_contains("symbols", F.col("symbol")) | F.array_contains("symbols", "*")) & (F.array_contains("required", "*") | (F.size(F.array_except("required", "factors")) == 0))
    return events.join(wide, hit).select("strategy", "event_id")
