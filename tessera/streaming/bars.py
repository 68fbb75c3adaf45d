"""Structured Streaming: bars from ticks, the last bars of each symbol with factors and labels, alerts with a cooldown."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How late a tick may be; later ones are dropped.
LATENESS = "2 minutes"


def minute_bars(ticks: DataFrame, minutes: int = 1, lateness: str = LATENESS) -> DataFrame:
    """Bars of a tick stream ``(datetime, vt_symbol, last_price, event_id, dv)``, given out when the watermark passes them.

    ``dv`` is the traded volume of the tick; ``traded`` derives it from a cumulative volume.
    """
    at = F.struct("datetime", "event_id")
    bars = ticks.where("last_price > 0").withColumn("event_time", F.col("datetime").cast("timestamp")).withWatermark("event_time", lateness)
    bars = bars.groupBy("vt_symbol", F.window("event_time", f"{minutes} minutes").alias("w")).agg(
        F.min_by("last_price", at).alias("open"), F.max("last_price").alias("high"), F.min("last_price").alias("low"), F.max_by("last_price", at).alias("close"),
        F.sum("dv").alias("volume"), F.count("*").alias("n_ticks"),
    )
    return bars.select("vt_symbol", F.col("w.start").cast("timestamp_ntz").alias("datetime"), "open", "high", "low", "close", "volume", "n_ticks")


def traded(ticks: DataFrame) -> DataFrame:
    """Adds ``dv``: the rise of cumulative volume since the symbol's previous tick, kept across batches; 0 for the first tick."""
    schema = "datetime timestamp_ntz, vt_symbol string, last_price double, event_id long, dv double"

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["datetime", "event_id"])
        before = state.get[0] if state.exists else None
        volumes = rows["volume"].to_numpy("float64")
        first = volumes[0] if before is None else before
        rows["dv"] = np.maximum(np.diff(volumes, prepend=first), 0.0)
        state.update((float(volumes[-1]),))
        yield rows[["datetime", "vt_symbol", "last_price", "event_id", "dv"]]

    return ticks.groupBy("vt_symbol").applyInPandasWithState(step, schema, "last double", "append", GroupStateTimeout.NoTimeout)


def last_bars(bars: DataFrame, n: int, calculate: Callable[[pd.DataFrame], dict[str, float]], outputs: str, min_bars: int = 21) -> DataFrame:
    """Factors of each new bar from the symbol's last ``n`` bars, kept across batches; a bar of the same time replaces the old one.

    Nothing is given out before a symbol has ``min_bars``. ``calculate`` sees the bars in order of arrival time and
    returns the columns of ``outputs`` ("name double, ...").
    """
    names = [c.split()[0] for c in outputs.split(",")]
    schema = f"vt_symbol string, datetime timestamp_ntz, {outputs}"
    fields = ("open", "high", "low", "close", "volume")
    state_schema = "times array<long>, " + ", ".join(f"{f} array<double>" for f in fields)

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = dict(zip(("datetime", *fields), state.get, strict=True)) if state.exists else {c: [] for c in ("datetime", *fields)}
        kept = pd.DataFrame({"datetime": pd.to_datetime(pd.Series(kept["datetime"], dtype="int64"), unit="us"), **{f: pd.Series(kept[f], dtype="float64") for f in fields}})
        out = []
        for bar in pd.concat(list(parts)).sort_values("datetime", kind="stable")[["datetime", *fields]].itertuples(index=False):
            kept = kept[kept["datetime"] != bar.datetime]
            kept = pd.concat([kept, pd.DataFrame([bar])], ignore_index=True).tail(n)
            if len(kept) >= min_bars:
                values = calculate(kept)
                out.append((key[0], bar.datetime, *(values[c] for c in names)))
        micros = kept["datetime"].astype("datetime64[us]").astype("int64").tolist()
        state.update((micros, *(kept[f].astype(float).tolist() for f in fields)))
        yield pd.DataFrame(out, columns=["vt_symbol", "datetime", *names])

    return bars.groupBy("vt_symbol").applyInPandasWithState(step, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def cooled(alerts: DataFrame, seconds: int = 60) -> DataFrame:
    """The alerts ``(vt_symbol, datetime, alert)`` that come at least ``seconds`` of event time after the symbol's last one given out."""

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(parts)).sort_values("datetime")[["vt_symbol", "datetime", "alert"]].itertuples(index=False):
            now = pd.Timestamp(row.datetime).value // 1000
            if last is None or now - last >= seconds * 1_000_000:
                out.append(row)
                last = now
        if last is not None:
            state.update((int(last),))
        yield pd.DataFrame(out, columns=["vt_symbol", "datetime", "alert"])

    return alerts.groupBy("vt_symbol").applyInPandasWithState(step, "vt_symbol string, datetime timestamp_ntz, alert string", "last long", "append", GroupStateTimeout.NoTimeout)


class Bus:
    """Events to handlers: one streaming query feeds each topic's handlers, then the general ones, batch by batch.

    A handler that fails is reported to ``on_error`` and the others still run.
    """

    def __init__(self, on_error: Callable[[str, Exception], None] | None = None):
        self.handlers: dict[str, list[Callable[[DataFrame, int], None]]] = {}
        self.general: list[Callable[[DataFrame, int], None]] = []
        self.on_error = on_error

    def subscribe(self, handler: Callable[[DataFrame, int], None], topic: str | None = None) -> Bus:
        (self.general if topic is None else self.handlers.setdefault(topic, [])).append(handler)
        return self

    def batch(self, events: DataFrame, batch_id: int) -> None:
        events = events.persist()
        try:
            for topic, handlers in self.handlers.items():
                for h in handlers:
                    self._call(topic, h, events.where(F.col("event_type") == topic), batch_id)
            for h in self.general:
                self._call("*", h, events, batch_id)
        finally:
            events.unpersist()

    def _call(self, topic, handler, events, batch_id):
        try:
            handler(events, batch_id)
        except Exception as e:  # a handler's failure must not end the stream
            if self.on_error is None:
                raise
            self.on_error(topic, e)

    def start(self, events: DataFrame, checkpoint: str, once: bool = False):
        writer = events.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
